"""Reading record files: a checked header, then records whose columns lie one after the other.

The driver reads headers only; record bodies are read by executors, a bounded slice of rows at a time and only the columns
asked for. Paths must be ones that all executors see.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import field
from ..operators.table import ROW, Table, arrow_of, from_memory

#: The format's magic bytes, its version, and the alignment of the first record and of record bodies.
MAGIC, RECORD_MAGIC, VERSION, ALIGN, BODY_ALIGN = b"CSTORE\x00\x01", b"REC\x01", 1, 64, 8
#: Rows that a task holds at once.
ROWS_AT_ONCE = 1 << 18


class DamagedFile(ValueError):
    """A file that isn't of this format, or isn't whole."""


def _checked(ok: bool, path: str, what: str) -> None:
    if not ok:
        raise DamagedFile(f"{path}: {what}")


def layout(path: str) -> tuple[dict[str, np.dtype], list[tuple[int, int]]]:
    """The dtypes of a file's columns, and (offset of the body, rows) of each record; DamagedFile if a check fails."""
    with open(path, "rb") as f:
        head = f.read(80)
        _checked(len(head) == 80 and head[:8] == MAGIC, path, "not a record file")
        n_records, rows, _, crc = struct.unpack_from("<qqqI", head, 8)
        _checked(zlib.crc32(head[8:32]) == crc, path, "the counters don't have their checksum")
        size = struct.unpack_from("<Q", head, 72)[0]
        try:
            manifest = json.loads(f.read(size))
        except ValueError as e:
            raise DamagedFile(f"{path}: the manifest isn't JSON") from e
        _checked(manifest.get("format_version") == VERSION, path, "an unknown version")
        listed = json.dumps({"columns": manifest["columns"]}, sort_keys=True).encode()
        _checked(manifest.get("manifest_crc32") in (None, zlib.crc32(listed)), path, "the manifest doesn't have its checksum")
        kinds = {c["name"]: np.dtype(c["dtype"]) for c in manifest["columns"]}
        width, at, found = sum(k.itemsize for k in kinds.values()), -(-(80 + size) // ALIGN) * ALIGN, []
        for i in range(n_records):
            f.seek(at)
            head = f.read(32)
            _checked(len(head) == 32 and head[:4] == RECORD_MAGIC, path, f"no record {i} at {at}")
            index, n, _, crc = struct.unpack_from("<qqqI", head, 4)
            _checked(index == i and zlib.crc32(head[:28]) == crc, path, f"record {i} has a damaged header")
            found.append((at + 32, n))
            at += 32 + -(-n * width // BODY_ALIGN) * BODY_ALIGN
        _checked(at <= os.fstat(f.fileno()).st_size or not found, path, "the last record isn't whole")
        _checked(sum(n for _, n in found) == rows, path, "the records don't have the rows that the counters say")
    return kinds, found


def slices(found: list[tuple[int, int]], at_once: int = ROWS_AT_ONCE) -> list[tuple[int, int, int, int, int]]:
    """(offset, rows of the record, first row in it, rows to read, first row of the table) for pieces of bounded size."""
    out, first = [], 0
    for offset, n in found:
        out += [(offset, n, a, min(at_once, n - a), first + a) for a in range(0, n, at_once)]
        first += n
    return out


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> Table:
    """A record file as a table; KeyError for a column that it doesn't have. A file without rows gives an empty table."""
    kinds, found = layout(path)
    before, width = {}, 0
    for name, kind in kinds.items():
        before[name] = width
        width += kind.itemsize
    kinds = {c: kinds[c] for c in columns} if columns is not None else kinds
    pieces = slices(found)
    if not pieces:
        return from_memory({c: np.zeros(0, k) for c, k in kinds.items()}, spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for offset, n, a, count, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    got = {}
                    for c, k in kinds.items():
                        f.seek(offset + before[c] * n + a * k.itemsize)
                        got[c] = np.frombuffer(f.read(count * k.itemsize), k)
                    t = arrow_of(got).append_column(ROW, pa.array(np.arange(first, first + count)))
                    yield from t.replace_schema_metadata(None).combine_chunks().to_batches()

    fields = [field(c, k) for c, k in kinds.items()]
    dealt: DataFrame = spark.createDataFrame(pieces, "at long, n long, a long, count long, first long").repartition(min(len(pieces), 10_000), "first")
    rows = dealt.mapInArrow(read, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{ROW}` long"]))
    rows = rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in fields), ROW)
    return Table(rows.drop(ROW), kinds, None, rows)
