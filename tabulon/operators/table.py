"""Tables over files in order: lazy column and row selection, predicates, materialisers.

A table is a DataFrame and, only where a position is asked for, a dense global row id: in-file row index plus the file's
offset, from the files' row counts. Positions that are known pick the files that are read. Nothing that doesn't need
positions pays for them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.expr import Col, Expr, as_expr, col
from ..functions.lower import lower
from ..functions.query import check_predicate, parse
from ..functions.types import field, numpy_type
from ..sources import paths
from . import rows as R

ROW = "__row_id"
#: Index rows up to which a positional selection is broadcast (16 bytes each).
BROADCAST_ROWS = 2_000_000
#: Files up to which offsets are broadcast, and up to which a position range names the files that it meets.
BROADCAST_FILES, NAMED_FILES = 100_000, 1_000
#: Bytes of held columns that a union gathers; more go to the folder in ``spark.checkpoint.dir``, so many at a time.
GATHERED_BYTES = 8 << 20


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def shared_folder() -> str | None:
    return session().conf.get("spark.checkpoint.dir", None)


def columns_of(data: Any) -> dict[str, np.ndarray]:
    """One-dimensional arrays of a dict, structured array or pandas frame; TypeError for objects, ValueError for ragged columns."""
    if isinstance(data, np.ndarray):
        if data.dtype.names is None:
            raise TypeError("a plain array has no column names")
        data = {n: data[n] for n in data.dtype.names}
    elif hasattr(data, "columns") and hasattr(data, "iloc"):
        data = {str(c): _from_pandas(data[c]) for c in data.columns}
    elif isinstance(data, Table | View):
        data = data.dict()
    out = {str(k): np.asarray(v) for k, v in data.items()}
    if not out:
        raise ValueError("no columns")
    for k, v in out.items():
        if v.ndim != 1:
            raise ValueError(f"column {k!r} has {v.ndim} dimensions")
        if v.dtype.kind not in "fiubmMSU":
            raise TypeError(f"column {k!r}: dtype {v.dtype} can't be stored")
    if len({len(v) for v in out.values()}) > 1:
        raise ValueError("columns of different lengths")
    return out


def _from_pandas(s: Any) -> np.ndarray:
    v = s.to_numpy()
    if v.dtype.kind == "O":
        if len(v) and all(isinstance(x, str) for x in v):
            return v.astype("U")
        raise TypeError(f"column {s.name!r} holds objects")
    return v


def arrow_of(columns: dict[str, np.ndarray]) -> pa.Table:
    """Arrow columns of the storage types; exact dtypes go to the schema's field metadata."""
    out = {}
    for k, v in columns.items():
        if v.dtype.kind == "S":
            out[k] = pa.array(v.tolist(), pa.binary())
        elif v.dtype.kind == "U":
            out[k] = pa.array(v.tolist(), pa.string())
        elif v.dtype.kind == "M":
            out[k] = pa.array(v.astype("M8[D]" if v.dtype == np.dtype("M8[D]") else "M8[us]"))
        elif v.dtype.kind == "m":
            out[k] = pa.array(v.astype("m8[us]"))
        elif v.dtype == np.dtype("f2"):
            out[k] = pa.array(v.astype("f4"))
        elif v.dtype.kind == "u":
            out[k] = pa.array(v.astype({1: "i2", 2: "i4", 4: "i8"}[v.dtype.itemsize])) if v.dtype.itemsize < 8 else pa.array(v.tolist(), pa.decimal128(20, 0))
        else:
            out[k] = pa.array(v.astype(v.dtype.newbyteorder("=")))
    return pa.table(out)


def typed(df: DataFrame, dtypes: dict[str, np.dtype]) -> DataFrame:
    """``df`` with each column's exact dtype in its metadata."""
    return df.select(*(F.col(f"`{n}`").alias(n, metadata=field(n, t).metadata) for n, t in dtypes.items()))


def numpy_of(table: pa.Table, dtypes: dict[str, np.dtype]) -> dict[str, np.ndarray]:
    out = {}
    for n, t in dtypes.items():
        c = table.column(n)
        if c.null_count and t.kind in "biuSU":
            raise TypeError(f"column {n!r} has nulls, for which {t} has no value")
        if t.kind in "SU":
            out[n] = np.array(c.to_pylist(), dtype=t if t.itemsize or not len(c) else None)
            if not len(c):
                out[n] = out[n].astype(t)
        elif t == np.dtype("u8"):
            out[n] = np.array([int(x) for x in c.to_pylist()], t)
        else:
            out[n] = np.asarray(c.to_numpy()).astype(t)
    return out


class Selectable:
    """What tables and views share: rows, columns, predicates, materialisers."""

    _table: Table
    _rows: slice | np.ndarray | None = None
    _predicate: Expr | None = None
    _names: list[str]
    _single = False

    # -- shape and schema
    @property
    def columns(self) -> list[str]:
        return list(self._names)

    @property
    def dtypes(self) -> dict[str, np.dtype]:
        return {n: self._table._dtypes[n] for n in self._names}

    @property
    def n_columns(self) -> int:
        return len(self._names)

    @property
    def n_rows(self) -> int:
        return self.df.count() if self._predicate is not None else R.length(self._rows, self._table._count())

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.n_rows,) if self._single else (self.n_rows, self.n_columns)

    def __len__(self) -> int:
        return self.n_rows

    def count(self) -> int:
        return self.n_rows

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __contains__(self, name: object) -> bool:
        return name in self._names

    # -- selection
    def _view(self, rows: Any = None, names: list[str] | None = None, predicate: Expr | None = None, single: bool = False) -> View:
        if predicate is not None and self._predicate is not None:
            predicate = self._predicate & predicate
        if predicate is not None and self._rows is not None:
            raise TypeError("a predicate applies before rows are picked by position; use edit() for more steps")
        base = self._rows
        if rows is not None:
            if (predicate or self._predicate) is not None:
                return self.evaluate()._view(rows, names, None, single)
            base = R.compose(self._rows, rows, self._table._count())
        return View(self._table, base, predicate if predicate is not None else self._predicate, names or list(self._names), single)

    def __getitem__(self, key: Any) -> View:
        if isinstance(key, str):
            return self._view(names=self._known([key]), single=True)
        if isinstance(key, list) and key and all(isinstance(k, str) for k in key):
            return self._view(names=self._known(key))
        if isinstance(key, Expr):
            return self.where(key)
        if isinstance(key, tuple):
            if len(key) != 2:
                raise IndexError("rows and columns, no more")
            rows, names = key
            names, single = ([names], True) if isinstance(names, str) else (list(names), False)
            if isinstance(rows, Expr):
                return self.where(rows)._view(names=self._known(names), single=single)
            return self._view(rows, self._known(names), single=single)
        return self._view(key, single=self._single)

    def _known(self, names: list[str]) -> list[str]:
        for n in names:
            if n not in self._names:
                raise KeyError(n)
        return list(names)

    def select(self, *names: str) -> View:
        if not names or len(set(names)) < len(names):
            raise ValueError("select takes different names, one at least")
        return self._view(names=self._known(list(names)))

    def drop(self, *names: str) -> View:
        self._known(list(names))
        if not (left := [n for n in self._names if n not in names]):
            raise ValueError("no column would be left")
        return self._view(names=left)

    def where(self, predicate: Expr) -> View:
        return self._view(predicate=check_predicate(predicate, self._table._dtypes))

    def query(self, text: str, *, columns: Any = None, params: dict[str, Any] | None = None, lazy: bool = True) -> View:
        out = self._view(predicate=check_predicate(parse(text, list(self._table._dtypes), params), self._table._dtypes))
        if columns is not None:
            out = out[columns]
        return out if lazy else out.evaluate()

    def evaluate(self) -> View:
        """The rows of a predicate found now, as positions; columns stay lazy."""
        if self._predicate is None:
            return self._view(single=self._single)
        ids = self._table._with_rows().where(lower(self._predicate, self._table._dtypes)).select(ROW).toArrow().column(0).to_numpy()
        return View(self._table, np.sort(ids), None, list(self._names), self._single)

    def head(self, n: int = 10) -> View:
        return self[: max(0, n)]

    def tail(self, n: int = 10) -> View:
        return self[max(0, self.n_rows - n) :]

    # -- plans
    def _ordered(self) -> DataFrame:
        """Selected rows with ``__pos``, the place in the result."""
        t = self._table
        if self._rows is None:
            out = t._with_rows() if self._predicate is None else t._with_rows().where(lower(self._predicate, t._dtypes))
            return out.withColumn("__pos", F.col(ROW))
        if isinstance(self._rows, slice):
            r = range(self._rows.start, self._rows.stop, self._rows.step)
            if not len(r):
                return t._with_rows().where(F.lit(False)).withColumn("__pos", F.col(ROW))
            low, high, step = min(r[0], r[-1]), max(r[0], r[-1]), abs(r.step)
            out = t._with_rows(np.array([low, high]), True).where(F.col(ROW).between(low, high))
            if step > 1:
                out = out.where((F.col(ROW) - low) % step == 0)
            return out.withColumn("__pos", F.col(ROW) if r.step > 0 else -F.col(ROW))
        index = t.spark.createDataFrame(pa.table({"__pos": np.arange(len(self._rows)), "__at": self._rows.astype(np.int64)}))
        if len(self._rows) <= BROADCAST_ROWS:
            index = F.broadcast(index)
        out = t._with_rows(self._rows)
        return out.join(index, out[ROW] == index["__at"]).drop("__at")

    @property
    def df(self) -> DataFrame:
        """The selection as a plain DataFrame, in no particular order."""
        t = self._table
        if self._rows is None:
            out = t._df if self._predicate is None else t._df.where(lower(self._predicate, t._dtypes))
        else:
            out = self._ordered()
        return out.select(*(f"`{n}`" for n in self._names))

    # -- materialisers
    def arrow(self) -> pa.Table:
        return self._ordered().select("__pos", *(f"`{n}`" for n in self._names)).orderBy("__pos").drop("__pos").toArrow()

    def dict(self, copy: bool = True) -> dict[str, np.ndarray]:
        if not copy:
            raise ValueError("Spark holds no memory to point into; call with copy=True")
        return numpy_of(self.arrow(), self.dtypes)

    def array(self, name: str | None = None, copy: bool = True) -> np.ndarray:
        if isinstance(name, bool):
            name, copy = None, name
        if name is None and len(self._names) != 1:
            raise ValueError("array() of several columns; name one")
        return self._view(names=self._known([name or self._names[0]])).dict(copy)[name or self._names[0]]

    def recarray(self) -> np.recarray:
        got = self.dict()
        out = np.empty(len(next(iter(got.values()))), [(n, v.dtype) for n, v in got.items()])
        for n, v in got.items():
            out[n] = v
        return out.view(np.recarray)

    def frame(self, copy: bool = True) -> Any:
        import pandas as pd

        return pd.DataFrame(self.dict(copy))

    def to(self, kind: str) -> Any:
        return {"arrow": self.arrow, "pandas": self.frame, "dict": self.dict, "recarray": self.recarray}[kind]()

    def __arrow_c_stream__(self, requested_schema: Any = None) -> Any:
        return self.arrow().__arrow_c_stream__(requested_schema)

    def __array__(self, dtype: Any = None, copy: bool | None = None) -> np.ndarray:
        if copy is False:
            raise ValueError("Spark holds no memory to point into")
        out = self.array() if self._single else np.asarray(self.recarray())
        return out if dtype is None else out.astype(dtype)

    def edit(self) -> Any:
        """A deferred frame over this selection."""
        from .frame import Frame

        return Frame(self._table, rows=self._rows, predicate=self._predicate, names=list(self._names))

    def saveas(self, dest: Any, *, format: str | None = None, **how: Any) -> Any:
        from ..sources import formats

        return formats.save(self, dest, format, **how)

    def __repr__(self) -> str:
        from ..plans.preview import text

        return text(self)

    def _repr_html_(self) -> str:
        from ..plans.preview import html

        return html(self)


def _reduction(name: str) -> Any:
    def method(self: Any, *a: Any, **k: Any) -> Any:
        axis = k.pop("axis", None)
        ddof = k.pop("ddof", 0) if name in ("var", "std") else None
        if any(v is not None and v is not np._NoValue for v in k.values()) or axis not in (None, 0):
            raise TypeError(f"{name}() of a column takes no {', '.join(k) or 'axis'}")
        f = self.edit()
        return getattr(f, name)(self._names[0], **({} if ddof is None else {"ddof": ddof}))

    method.__name__ = name
    return method


class View(Selectable):
    """A lazy selection of a table's rows and columns; single-column views compute and reduce."""

    def __init__(self, table: Table, rows: Any, predicate: Expr | None, names: list[str], single: bool):
        self._table, self._rows, self._predicate, self._names, self._single = table, rows, predicate, names, single

    @property
    def dtype(self) -> np.dtype:
        return self.dtypes[self._names[0]]

    sum, mean, min, max, var, std = map(_reduction, ("sum", "mean", "min", "max", "var", "std"))

    def _eager(self, build: Any) -> np.ndarray:
        if not self._single:
            raise TypeError("arithmetic needs a single column")
        return self.edit().assign(__out=build(col(self._names[0]))).array("__out")

    def isin(self, values: Any) -> np.ndarray:
        return self._eager(lambda c: c.isin(values))

    def __array_ufunc__(self, ufunc: np.ufunc, method: str, *inputs: Any, **kwargs: Any) -> Any:
        if method != "__call__" or kwargs:
            raise TypeError(f"{ufunc.__name__}.{method} isn't supported on columns")
        others = [x for x in inputs if x is not self]
        if all(np.ndim(x) == 0 and not isinstance(x, Selectable) for x in others):
            return self._eager(lambda c: ufunc(*(c if x is self else x for x in inputs)))
        return ufunc(*(np.asarray(x) if isinstance(x, Selectable) else x for x in inputs))

    def __array_function__(self, func: Any, types: Any, args: tuple, kwargs: dict) -> Any:
        short = {np.sum: "sum", np.mean: "mean", np.min: "min", np.max: "max", np.var: "var", np.std: "std"}
        if func in short and args and args[0] is self:
            return getattr(self, short[func])(**kwargs)
        swap = lambda x: np.asarray(x) if isinstance(x, Selectable) else x
        return func(*map(swap, args), **{k: swap(v) for k, v in kwargs.items()})


for _n, _u in {"add": np.add, "sub": np.subtract, "mul": np.multiply, "truediv": np.true_divide, "floordiv": np.floor_divide, "mod": np.remainder, "pow": np.power, "and": np.bitwise_and, "or": np.bitwise_or, "xor": np.bitwise_xor}.items():
    setattr(View, f"__{_n}__", lambda a, b, u=_u: u(a, b))
    setattr(View, f"__r{_n}__", lambda a, b, u=_u: u(b, a))
for _n, _u in {"lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal, "eq": np.equal, "ne": np.not_equal}.items():
    setattr(View, f"__{_n}__", lambda a, b, u=_u: u(a, b))
for _n, _u in {"neg": np.negative, "pos": np.positive, "abs": np.absolute, "invert": np.invert}.items():
    setattr(View, f"__{_n}__", lambda a, u=_u: u(a))


class Table(Selectable):
    """Files, or a DataFrame, as one table in a defined row order."""

    _single = False

    def __init__(self, df: DataFrame | None, dtypes: dict[str, np.dtype], files: list[str] | None = None, rows: DataFrame | None = None, held: pa.Table | None = None, n: int | None = None):
        self._dtypes, self._files, self._row_df, self._n, self._places, self._held = dtypes, files or [], rows, n, None, held
        self._names, self._table, self.closed = list(dtypes), self, False
        if df is not None:
            self._df = df

    @cached_property
    def _df(self) -> DataFrame:
        """Held columns go to Spark once a plan asks for them."""
        return self._with_rows().drop(ROW)

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def paths(self) -> list[str]:
        return list(self._files)

    def _count(self) -> int:
        self._open()
        if self._n is None:
            self._n = sum(n for _, _, n in self._pieces()) if self._files and self._row_df is None else self._df.count()
        return self._n

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the table is closed")

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Table:
        self._open()
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def _pieces(self) -> list[tuple[str, int, int]]:
        """(path, first row, rows) of each file, in order; counting rows by file reads footers, no columns."""
        if self._places is None:
            rows = {r["p"]: r["n"] for r in self._df.groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
            known = {_plain(p): (p, n) for p, n in rows.items()}
            self._places, at = [], 0
            for f in self._files:
                mine = [known[_plain(f)]] if _plain(f) in known else sorted((v for k, v in known.items() if k.startswith(_plain(f).rstrip("/") + "/")), key=lambda v: paths.natural(v[0]))
                for p, n in mine:
                    self._places.append((p, at, n))
                    at += n
        return self._places

    def _with_rows(self, asked: np.ndarray | None = None, between: bool = False) -> DataFrame:
        """The table's rows with their global position: all, or those of the files that the positions ``asked`` (or what lies ``between`` two) meet."""
        self._open()
        if self._row_df is None and not self._files:
            self._row_df = in_order(self._df) if self._held is None else _passed(self._held, self._dtypes)
        if self._row_df is not None:
            return self._row_df
        pieces = self._pieces()
        if asked is not None and len(asked):
            starts = np.array([at for _, at, _ in pieces])
            hit = np.searchsorted(starts, asked, "right") - 1
            met = np.arange(hit.min(), hit.max() + 1) if between else np.unique(hit)
            pieces = [pieces[i] for i in met] if len(met) <= NAMED_FILES else pieces
        raw = self._df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__index"))
        if len(pieces) < len(self._pieces()):
            raw = raw.where(F.col("_metadata.file_path").isin([p for p, _, _ in pieces]))
        if len(pieces) == 1:
            return raw.withColumn(ROW, F.col("__index") + F.lit(pieces[0][1])).drop("__path", "__index")
        offsets = self.spark.createDataFrame(pa.table({"__of": pa.array([p for p, _, _ in pieces], pa.string()), "__start": pa.array([s for _, s, _ in pieces], pa.int64())}))
        offsets = F.broadcast(offsets) if len(pieces) <= BROADCAST_FILES else offsets
        out = raw.join(offsets, F.col("__path") == F.col("__of")).withColumn(ROW, F.col("__start") + F.col("__index")).drop("__path", "__index", "__of", "__start")
        if len(pieces) == len(self._pieces()):
            self._row_df = out
        return out

    def append(self, source: Any, on_mismatch: str = "strict") -> Table:
        """The table grown in place by another one; unchanged if the schemas don't fit."""
        grown = union([self, open_table(source, on_mismatch=on_mismatch)], on_mismatch)
        self.__dict__ = grown.__dict__ | {"_table": self}
        return self

    def __or__(self, other: Any) -> Table:
        return union([self, open_table(other)])

    def __ior__(self, other: Any) -> Table:
        return self.append(other)


def _plain(path: str) -> str:
    return re.sub(r"^file:/*", "/", path).replace("%20", " ")


def table_of(df: DataFrame, files: list[str] | None = None) -> Table:
    """A table over a DataFrame; without files its order is that of ``__row_id``, or its own if it has none (see ``in_order``)."""
    dtypes = {f.name: numpy_type(f) for f in df.schema if f.name != ROW}
    rows = df if ROW in df.columns else None
    return Table(df.drop(ROW), dtypes, files, rows)


def from_memory(data: Any, spark: SparkSession | None = None) -> Table:
    columns = columns_of(data)
    arrow, dtypes = arrow_of(columns), {n: v.dtype for n, v in columns.items()}
    df = _passed(arrow, dtypes, spark=spark)
    return Table(df.drop(ROW), dtypes, None, df, n=len(arrow))


def hold(columns: dict[str, np.ndarray]) -> Table:
    """A table of arrays that nobody changes. They stay as Arrow columns here until a plan asks for them, and a union takes many at once."""
    arrow = arrow_of(columns_of(columns))
    return Table(None, {n: v.dtype for n, v in columns.items()}, held=arrow, n=len(arrow))


def _passed(arrow: pa.Table, dtypes: dict[str, np.dtype], start: int = 0, spark: SparkSession | None = None) -> DataFrame:
    """Arrow columns as a DataFrame with row ids from ``start`` on."""
    df = (spark or session()).createDataFrame(arrow.append_column(ROW, pa.array(np.arange(start, start + len(arrow)))))
    return df.select(*(F.col(f"`{n}`").alias(n, metadata=field(n, t).metadata) for n, t in dtypes.items()), ROW)


def open_table(source: Any, *, on_mismatch: str = "strict", spark: SparkSession | None = None, **_ignored: Any) -> Table:
    """A path, a glob, a folder of shards, a DataFrame, arrays, or a list of these, as one table (hardware options are ignored)."""
    spark = spark or session()
    if isinstance(source, Table):
        return source
    if isinstance(source, DataFrame):
        return table_of(source)
    if isinstance(source, dict) or hasattr(source, "iloc") or isinstance(source, np.ndarray):
        return from_memory(source, spark)
    if isinstance(source, (list, tuple)):
        parts = [open_table(s, on_mismatch=on_mismatch, spark=spark) for s in source]
        return union(parts, on_mismatch) if len(parts) != 1 else parts[0]
    files = paths.resolve(source)
    if not files:
        return Table(spark.createDataFrame([], "__none int").drop("__none"), {}, [])
    schemas = [spark.read.parquet(f).schema for f in files] if len(files) > 1 else [spark.read.parquet(files[0]).schema]
    kinds = [{f.name: numpy_type(f) for f in s} for s in schemas]
    names = _common(kinds, on_mismatch)
    df = spark.read.parquet(*files) if len(files) == 1 else spark.read.schema(schemas[0]).parquet(*files)
    return Table(df.select(*(f"`{n}`" for n in names)), names, files)


def _common(kinds: list[dict[str, np.dtype]], on_mismatch: str) -> dict[str, np.dtype]:
    """Columns of a union: all alike (in any order), or with ``drop`` those that all have under one dtype."""
    if on_mismatch not in ("strict", "drop"):
        raise ValueError("on_mismatch is 'strict' or 'drop'")
    kinds = [k for k in kinds if k] or kinds
    same = {n: _widest([k[n] for k in kinds]) for n, t in kinds[0].items() if all(n in k and k[n].kind == t.kind and (t.kind in "SU" or k[n] == t) for k in kinds)}
    if on_mismatch == "strict" and any(set(k) != set(same) for k in kinds):
        raise ValueError("the tables have different columns or dtypes")
    if not same:
        raise ValueError("the tables have no column in common")
    if any(set(k) != set(same) for k in kinds):
        import warnings

        warnings.warn("columns that not all tables share are left out", RuntimeWarning, stacklevel=3)
    return same


def _widest(same: list[np.dtype]) -> np.dtype:
    """The dtype that holds text of all; a width of 0 is any width."""
    return min(same, key=lambda t: t.itemsize) if not all(t.itemsize for t in same) else max(same, key=lambda t: t.itemsize)


def union(parts: Iterable[Table], on_mismatch: str = "strict") -> Table:
    """All rows of all parts, in order; positions run on. Held columns are gathered as they come."""
    parts = list(_gathered(parts))
    if not parts:
        return Table(session().createDataFrame([], "__none int").drop("__none"), {}, [])
    names = _common([p._dtypes for p in parts], on_mismatch)
    parts = [p for p in parts if p._dtypes]
    plain, numbered, at = [], [], 0
    for p in parts:
        made = [F.col(f"`{n}`") if p._dtypes[n] == t else F.col(f"`{n}`").alias(n, metadata=field(n, t).metadata) for n, t in names.items()]
        plain.append(p._df.select(*made))
        numbered.append(p._with_rows().select(*made, (F.col(ROW) + at).alias(ROW)))
        at += p._count()
    return Table(_stacked(plain), names, [f for p in parts for f in p._files], _stacked(numbered), n=at)


def _stacked(frames: list[DataFrame]) -> DataFrame:
    """Rows of all, in order; two and two, since every union analyses the plan below it."""
    while len(frames) > 1:
        frames = [frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i] for i in range(0, len(frames), 2)]
    return frames[0]


def _gathered(parts: Iterable[Table]) -> Iterator[Table]:
    """The parts, with neighbours that hold columns of the same dtypes as one table."""
    run = None
    for p in parts:
        if run is not None and not run.takes(p):
            yield run.table()
            run = None
        if p._held is None:
            yield p
        else:
            run = run or _Run()
            run.add(p)
    if run is not None:
        yield run.table()


class _Run:
    """Held tables in a row: kept as Arrow columns up to ``GATHERED_BYTES``; beyond that stored with their row ids, if a shared folder is set."""

    def __init__(self) -> None:
        self.dtypes: dict[str, np.dtype] = {}
        self.held: list[pa.Table] = []
        self.bytes, self.stored, self.path, self.schema = 0, 0, None, None

    def takes(self, p: Table) -> bool:
        return p._held is not None and p._dtypes.keys() == self.dtypes.keys() and all(t.kind == p._dtypes[n].kind and (t.kind in "SU" or t == p._dtypes[n]) for n, t in self.dtypes.items())

    def add(self, p: Table) -> None:
        p._open()
        self.dtypes = {n: _widest([t, p._dtypes[n]]) for n, t in (self.dtypes or p._dtypes).items()}
        self.held.append(p._held.select(list(self.dtypes)))
        self.bytes += self.held[-1].nbytes
        if self.bytes > GATHERED_BYTES and (shared := shared_folder()):
            self.path = self.path or f"{shared.rstrip('/')}/union-{uuid.uuid4().hex}"
            self.store()

    def store(self) -> None:
        """One file of the rows at hand. They travel as one value of bytes: as rows of a plan they would take many times that of the driver's heap."""
        from pyspark.sql.pandas.types import _check_arrow_table_timestamps_localize, to_arrow_schema

        def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in parts:
                for b in p.column(0):
                    yield from pa.ipc.open_stream(b.as_buffer())

        spark, arrow, sink = session(), pa.concat_tables(self.held).combine_chunks(), pa.BufferOutputStream()
        self.schema = _passed(arrow.slice(0, 0), self.dtypes).schema
        arrow = arrow.append_column(ROW, pa.array(np.arange(self.stored, self.stored + len(arrow))))
        arrow = _check_arrow_table_timestamps_localize(arrow, self.schema, True, spark.conf.get("spark.sql.session.timeZone")).cast(to_arrow_schema(self.schema))
        with pa.ipc.new_stream(sink, arrow.schema) as w:
            w.write_table(arrow, max_chunksize=10_000)
        packed = spark.createDataFrame(pa.table({"part": pa.array([sink.getvalue().to_pybytes()], pa.binary())}))
        packed.mapInArrow(unpack, self.schema).write.mode("append").parquet(self.path)
        self.held, self.bytes, self.stored = [], 0, self.stored + len(arrow)

    def table(self) -> Table:
        if self.path is None:
            arrow = pa.concat_tables(self.held).combine_chunks()
            return Table(None, self.dtypes, held=arrow, n=len(arrow))
        if self.held:
            self.store()
        df = session().read.schema(self.schema).parquet(self.path)
        return Table(df.drop(ROW), self.dtypes, None, df, n=self.stored)


def in_order(df: DataFrame) -> DataFrame:
    """``df`` with dense ``__row_id`` in its own order: that of its partitions, and of rows in them.

    A plan with a shuffle may deal rows otherwise on each run, so its result is kept (in memory and on disk) once numbered.
    """
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    part, inside = F.call_function("shiftright", "__at", F.lit(33)).cast("int"), F.col("__at") % (1 << 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))  # a row a partition
    return placed.withColumn("__in", part).join(F.broadcast(sizes), F.col("__in") == F.col("__part")).withColumn(ROW, F.col("__before") + inside).drop("__at", "__in", "__part", "__before")


__all__ = ["Table", "View", "as_expr", "from_memory", "open_table", "table_of", "union", "Col"]
