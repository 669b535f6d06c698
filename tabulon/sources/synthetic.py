"""Synthetic columns for tests and timings: small ones as arrays, large ones made by the executors."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.types import KEY, spark_type
from ..operators.table import ROW, Table, open_table, session, table_of
from .formats import create


def _kinds(cols: int, dtype: str | Sequence[str], names: Sequence[str] | None) -> dict[str, np.dtype]:
    """The dtype of each column by name; a sequence of dtypes repeats."""
    if cols < 1:
        raise ValueError("there is one column at least")
    names = [f"c{i}" for i in range(cols)] if names is None else list(names)
    if len(names) != cols or len(set(names)) != cols:
        raise ValueError(f"{cols} different names are needed")
    kinds = [np.dtype(d) for d in ([dtype] if isinstance(dtype, str) else dtype)]
    if not kinds:
        raise ValueError("no dtype given")
    for k in kinds:
        if k.kind not in "fiu":
            raise ValueError(f"dtype {k}: floats and integers can be generated")
    return dict(zip(names, itertools.cycle(kinds)))  # noqa: B905  dtypes repeat without end


def _range(kind: np.dtype) -> tuple[int, int]:
    """The central half of an integer type: from here, to before there."""
    ends = np.iinfo(kind)
    return ends.min // 2, ends.max // 2


def make_columns(rows: int, cols: int, *, dtype: str | Sequence[str] = "float64", seed: int = 0, names: Sequence[str] | None = None, rng: np.random.Generator | None = None) -> dict[str, np.ndarray]:
    """Arrays by name: standard normal floats, integers from the central half of their type; ``rng`` takes the seed's place."""
    if rows < 0:
        raise ValueError("rows can't be negative")
    kinds = _kinds(cols, dtype, names)
    rng = np.random.default_rng(seed) if rng is None else rng
    return {n: (rng.standard_normal(rows) if k.kind == "f" else rng.integers(*_range(k), rows)).astype(k) for n, k in kinds.items()}


def make_table(rows: int, cols: int, *, dtype: str | Sequence[str] = "float64", seed: int = 0, names: Sequence[str] | None = None, partitions: int | None = None, spark: SparkSession | None = None) -> Table:
    """A lazy table of the same kind of columns, made where its partitions are; the values are others than ``make_columns``'s.

    A value depends on the seed, its column and its row only, so that neither partitions nor lost executors change it.
    """
    if rows < 0:
        raise ValueError("rows can't be negative")
    kinds = _kinds(cols, dtype, names)
    unit = lambda *salt: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(F.lit, salt), F.col(ROW)), 11) + 0.5) / float(1 << 53)
    df = (spark or session()).range(0, rows, 1, partitions).withColumnRenamed("id", ROW)
    out = []
    for i, (n, k) in enumerate(kinds.items()):
        if k.kind == "f":
            value = F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * np.pi * unit(i, 1))
        else:
            low, high = _range(k)
            value = F.floor(F.lit(float(low)) + unit(i, 0) * float(high - low))
        out.append(value.cast(spark_type(k)).alias(n, metadata={KEY: k.str}))
    return table_of(df.select(*out, ROW))


def uniform_record_rows(total: int, records: int) -> list[int]:
    """Rows of each of ``records`` records: equal shares, the last with what is left over."""
    if records < 1 or total < 0:
        raise ValueError("there is one record at least, and no negative number of rows")
    share, rest = divmod(total, records)
    return [share] * (records - 1) + [share + rest]


def write_columns(path: Any, columns: dict[str, np.ndarray], *, records: int | Sequence[int] = 1) -> Table:
    """Write arrays as a new table of ``records`` records (a number, or the rows of each) and open it."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) != 1:
        raise ValueError("columns of one length are needed")
    total = sizes.pop()
    cuts = uniform_record_rows(total, records) if isinstance(records, int) else list(records)
    if min(cuts, default=0) < 0 or sum(cuts) != total:
        raise ValueError(f"the records' rows add up to {sum(cuts)}, not {total}")
    with create(path) as w:
        for end, n in zip(itertools.accumulate(cuts), cuts, strict=True):
            w.write({name: v[end - n : end] for name, v in columns.items()})
    return open_table(path)


def make_store(path: Any, *, rows: int, cols: int = 1, records: int | Sequence[int] = 1, dtype: str | Sequence[str] = "float64", seed: int = 0) -> Table:
    """Write ``make_columns`` as a new table and open it."""
    return write_columns(path, make_columns(rows, cols, dtype=dtype, seed=seed), records=records)
