"""Reading and writing: a small registry of formats over Spark, Arrow and NumPy, and what is built on it.

Parquet goes through Spark on both ways. Single-file formats that Spark doesn't write (Feather, NPZ, JSON arrays, HDF5, ROOT)
stream ordered batches to the driver, one partition after the other.
"""

from __future__ import annotations

import glob

import os
import shutil
import uuid
import warnings
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import KEY
from ..operators.table import ROW, Table, columns_of, from_memory, numpy_of, open_table, session, typed, union
from . import paths


class DataFormat:
    """A format by name; subclasses say how files are read and written."""

    name = ""
    extensions: tuple[str, ...] = ()

    def write(self, source: Any, dest: str, **how: Any) -> None:
        raise NotImplementedError(f"{self.name} can't be written")

    def read(self, path: str, columns: list[str] | None = None, **how: Any) -> Table:
        raise NotImplementedError(f"{self.name} can't be read")


FileFormat = DataFormat
_formats: dict[str, DataFormat] = {}


def register(fmt: DataFormat) -> DataFormat:
    """Add a format; a name or extension that is taken is a ValueError."""
    for f in _formats.values():
        if f.name != fmt.name and set(f.extensions) & set(fmt.extensions):
            raise ValueError(f"{fmt.name}: {f.name} has its extension")
    _formats[fmt.name] = fmt
    return fmt


def get(name: str) -> DataFormat:
    if name not in _formats:
        raise ValueError(f"no format {name!r}; there are {', '.join(sorted(_formats))}")
    return _formats[name]


def data_formats() -> list[str]:
    return sorted(_formats)


file_formats = data_formats


def for_path(path: Any, format: str | None = None) -> DataFormat:
    if format:
        return get(format)
    suffix = Path(str(path)).suffix.lower()
    for f in _formats.values():
        if suffix in f.extensions:
            return f
    raise ValueError(f"no format for {str(path)!r}")


def _ordered(source: Any) -> DataFrame:
    """Rows in their order, with ``__pos``."""
    if hasattr(source, "_plan"):
        return source._plan(position=True)
    return source._ordered().select(*(f"`{n}`" for n in source.columns), "__pos")


def as_source(data: Any) -> Any:
    if hasattr(data, "_plan") or hasattr(data, "_ordered"):
        return data
    return open_table(data) if isinstance(data, (DataFrame, str, os.PathLike)) else from_memory(data)


def _publish(source: Any, path: str) -> None:
    """The rows as Parquet files in order of position, written by executors: a range of positions meets few of them."""
    if not source.columns:
        raise ValueError("no columns to write")
    ordered = _ordered(source)
    df = typed(ordered, source.dtypes | {"__pos": np.dtype("i8")})
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    try:
        df.repartitionByRange(F.col("__pos")).sortWithinPartitions("__pos").drop("__pos").write.parquet(tmp)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)
        os.replace(tmp, path)
    finally:
        shutil.rmtree(tmp, ignore_errors=True)


def store(data: Any, path: Any, *, mode: str = "create", statistics: bool = False, batch_size: Any = "auto", show_progress: bool = True) -> Table:
    """Write once and open; ``create`` refuses what exists, ``recreate`` replaces it when the new one is complete."""
    if mode not in ("create", "recreate"):
        raise ValueError("mode is 'create' or 'recreate'")
    path = os.fspath(path)
    if mode == "create" and os.path.exists(path):
        raise FileExistsError(path)
    _publish(as_source(data), path)
    return open_table(path)


def save(source: Any, dest: Any, format: str | None = None, **how: Any) -> str:
    """A selection or frame to a file of the format its extension names; what is there is replaced."""
    if not source.columns:
        raise ValueError("no columns to write")
    for_path(dest, format).write(source, os.fspath(dest), **how)
    return os.fspath(dest)


def batches(source: Any, batch_size: Any = None) -> Iterator[pa.Table]:
    """Ordered Arrow tables; an empty selection gives one typed empty table. Columns travel as such, a partition after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from .sizes import batch_rows

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part"])

    rows, ordered = batch_rows(batch_size, source.dtypes), _ordered(source).orderBy("__pos").drop("__pos")
    schema, held, some = to_arrow_schema(ordered.schema), [], False
    for r in ordered.mapInArrow(pack, "part binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(r.part).read_all().cast(schema))
        while sum(map(len, held)) >= rows:
            whole = pa.concat_tables(held)
            yield whole.slice(0, rows).combine_chunks()
            held, some = [whole.slice(rows)] if len(whole) > rows else [], True
    if held or not some:
        yield pa.concat_tables(held).combine_chunks() if held else schema.empty_table()


def without_nulls(t: Table) -> Table:
    """``t``, checked in one aggregation: a column of nulls only becomes NaN, one with some nulls is a TypeError."""
    foreign = [f.name for f in t._df.schema if KEY not in (f.metadata or {})]
    if not foreign:
        return t
    n, *nulls = t._df.agg(F.count(F.lit(1)), *(F.count_if(F.col(f"`{c}`").isNull()) for c in foreign)).first()
    if some := [c for c, k in zip(foreign, nulls, strict=True) if 0 < k < n]:
        raise TypeError(f"column {some[0]!r} has nulls")
    gone = {c for c, k in zip(foreign, nulls, strict=True) if k and k == n}
    if not gone:
        return t
    made = lambda c: F.lit(float("nan")).alias(c) if c in gone else F.col(f"`{c}`")
    kinds = {c: np.dtype("f8") if c in gone else k for c, k in t._dtypes.items()}
    return Table(t._df.select(*map(made, kinds)), kinds, None, t._with_rows().select(*map(made, kinds), ROW))


class Parquet(DataFormat):
    name, extensions = "parquet", (".parquet", ".pq")

    def write(self, source: Any, dest: str, single: bool = True, batch_size: Any = None, **how: Any) -> None:
        """One file (a row group per batch), or a folder of part files written by all executors."""
        if not single:
            return _publish(source, dest)
        import pyarrow.parquet as pq

        tmp, writer = f"{dest}.tmp-{uuid.uuid4().hex}", None
        for t in batches(source, batch_size):
            t = t.cast(pa.schema([f.with_nullable(False).with_metadata({KEY: source.dtypes[f.name].str}) for f in t.schema]))
            writer = writer or pq.ParquetWriter(tmp, t.schema, **how)
            writer.write_table(t)
        writer.close()
        os.replace(tmp, dest)

    def read(self, path: str, columns: list[str] | None = None, **how: Any) -> Table:
        out = open_table(path, **how)
        out = out if columns is None else Table(out._df.select(*columns), {n: out._dtypes[n] for n in columns}, out._files)
        return without_nulls(out)


class Feather(DataFormat):
    name, extensions = "feather", (".feather", ".arrow", ".ipc")

    def write(self, source: Any, dest: str, batch_size: Any = None, compression: str | None = "lz4", **how: Any) -> None:
        with pa.OSFile(dest, "wb") as f:
            writer = None
            for t in batches(source, batch_size):
                writer = writer or pa.ipc.new_file(f, t.schema.with_metadata({f"np:{n}": k.str for n, k in source.dtypes.items()}), options=pa.ipc.IpcWriteOptions(compression=compression))
                writer.write_table(t)
            writer.close()

    def read(self, path: str, columns: list[str] | None = None, **how: Any) -> Table:
        with pa.memory_map(path) as f:
            t = pa.ipc.open_file(f).read_all()
        kinds = {k.decode()[3:]: np.dtype(v.decode()) for k, v in (t.schema.metadata or {}).items() if k.startswith(b"np:")}
        return from_memory(_arrays(t.select(columns) if columns else t, kinds))


def _arrays(t: pa.Table, kinds: dict[str, np.dtype] | None = None) -> dict[str, np.ndarray]:
    """Arrow columns as storable arrays: all-null is NaN, other nulls, nested and zoned columns are TypeErrors."""
    out = {}
    for f, c in zip(t.schema, t.columns, strict=True):
        if kinds and f.name in kinds:
            out[f.name] = numpy_of(pa.table({f.name: c}), {f.name: kinds[f.name]})[f.name]
            continue
        if pa.types.is_nested(f.type) or pa.types.is_timestamp(f.type) and f.type.tz or pa.types.is_decimal(f.type):
            raise TypeError(f"column {f.name!r}: {f.type} can't be stored")
        if c.null_count and c.null_count == len(c):
            out[f.name] = np.full(len(c), np.nan)
        elif c.null_count:
            raise TypeError(f"column {f.name!r} has nulls")
        elif pa.types.is_string(f.type) or pa.types.is_large_string(f.type):
            out[f.name] = np.array(c.to_pylist(), "U") if len(c) else np.zeros(0, "U1")
        elif pa.types.is_binary(f.type):
            out[f.name] = np.array(c.to_pylist(), "S") if len(c) else np.zeros(0, "S1")
        else:
            out[f.name] = np.asarray(c.to_numpy())
    return out


class Json(DataFormat):
    name, extensions = "json", (".json",)

    def write(self, source: Any, dest: str, orient: str = "records", lines: bool = False, **how: Any) -> None:
        if lines:
            source.df.write.mode("overwrite").json(dest)
        else:
            source.frame().to_json(dest, orient=orient, **how)

    def read(self, path: str, columns: list[str] | None = None, orient: str = "records", **how: Any) -> Table:
        import pandas as pd

        df = pd.read_json(path, orient=orient, dtype=False, convert_dates=False, **how)
        return from_memory(df[columns] if columns else df)


class Npz(DataFormat):
    name, extensions = "npz", (".npz",)

    def write(self, source: Any, dest: str, compress: bool = False, **how: Any) -> None:
        (np.savez_compressed if compress else np.savez)(dest, **source.dict())

    def read(self, path: str, columns: list[str] | None = None, **how: Any) -> Table:
        with np.load(path, allow_pickle=False) as z:
            return from_memory({n: z[n] for n in columns or z.files})


class Hdf5(DataFormat):
    """One dataset a column under a group; needs h5py."""

    name, extensions = "hdf5", (".h5", ".hdf5", ".hdf")

    def write(self, source: Any, dest: str, key: str = "data", **how: Any) -> None:
        h5py = _need("h5py")
        with h5py.File(dest, "w", track_order=True) as f:
            g = f.create_group(key, track_order=True)
            for n, v in source.dict().items():
                d = g.create_dataset(n, data=np.char.encode(v, "utf-8") if v.dtype.kind == "U" else v.view("i8") if v.dtype.kind in "Mm" else v)
                d.attrs[KEY] = v.dtype.str

    def read(self, path: str, columns: list[str] | None = None, key: str | None = None, **how: Any) -> Table:
        h5py = _need("h5py")
        with h5py.File(path, "r") as f:
            g = f[key or next(iter(f))]
            out = {}
            for n in columns or list(g):
                v, kind = g[n][()], np.dtype(g[n].attrs.get(KEY, g[n].dtype.str if g[n].dtype.kind != "O" else "U"))
                out[n] = v.view(kind) if kind.kind in "Mm" else np.char.decode(v.astype("S"), "utf-8") if kind.kind == "U" else v
        return from_memory(out)


class Root(DataFormat):
    """Flat branches of a tree; needs uproot."""

    name, extensions = "root", (".root",)

    def write(self, source: Any, dest: str, treename: str = "events", **how: Any) -> None:
        uproot = _need("uproot")
        with uproot.recreate(dest) as f:
            f[treename] = {"".join(c if c.isalnum() or c == "_" else "_" for c in n): v for n, v in source.dict().items()}

    def read(self, path: str, columns: list[str] | None = None, treename: str | None = None, keep_valid_only: bool = True, **how: Any) -> Table:
        uproot = _need("uproot")
        path, _, tree = str(path).partition(".root:")
        with uproot.open(path + ".root" if tree else path) as f:
            t = f[tree or treename or next(iter(f.keys()))]
            got = t.arrays(columns, library="np")
        good = {n: v for n, v in got.items() if v.dtype.kind in "fiubSU" and v.ndim == 1}
        if len(good) < len(got) and not keep_valid_only:
            raise TypeError("the tree has branches that aren't flat")
        return from_memory(good)


def _need(module: str) -> Any:
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"this format needs {module}") from e


class Records(DataFormat):
    """Record files, read only; told by ``format="records"``, not by extension."""

    name = "records"

    def read(self, path: str, columns: list[str] | None = None, **how: Any) -> Table:
        from . import records

        return records.scan(session(), path, columns)


for _f in (Parquet(), Feather(), Json(), Npz(), Hdf5(), Root(), Records()):
    register(_f)


# -- ingest


def read(path: Any, format: str | None = None, columns: list[str] | None = None, dtypes: dict[str, Any] | None = None, **how: Any) -> Table:
    """A foreign file as a table; ``dtypes`` override columns, missing floats becoming the new type's zero."""
    out = for_path(path, format).read(os.fspath(path), columns, **how)
    if not dtypes:
        return out
    for n in dtypes:
        if n not in out.columns:
            raise KeyError(n)
    from ..functions.expr import Cast, col
    from ..functions.lower import lower

    kinds = {n: np.dtype(dtypes.get(n, t)) for n, t in out._dtypes.items()}
    cast = [lower(Cast(col(n), kinds[n]), out._dtypes).alias(n) if n in dtypes else F.col(f"`{n}`") for n in kinds]
    return Table(out._df.select(*cast), kinds, out._files, out._with_rows().select(*cast, ROW))


def convert(source: Any, dest: Any = None, *, format: str | None = None, columns: list[str] | None = None, dtypes: dict[str, Any] | None = None, batch_size: Any = None, compact: bool = True, rename: Any = None, output_dir: Any = None, overwrite: bool = False, on_mismatch: str = "strict", max_workers: Any = None, dry_run: bool = False) -> Any:
    """Convert files: one to one, many to one (``dest`` a file), or each into ``output_dir``; N files as N Spark jobs at once."""
    many = isinstance(source, (list, tuple)) or paths.has_magic(source)
    files = [str(p) for s in (source if isinstance(source, (list, tuple)) else [source]) for p in (paths.expand(s) if paths.has_magic(s) else [os.fspath(s)])]
    if many and dest is not None and "{" not in str(dest):
        plan = [(files, os.fspath(dest))]
    else:
        plan = [([f], _named(f, i, dest, format, rename, output_dir)) for i, f in enumerate(files)]
    targets = [d for _, d in plan]
    if len(set(targets)) < len(targets):
        raise ValueError("two files would have one name")
    for d in targets:
        if os.path.exists(d) and not overwrite:
            raise FileExistsError(d)
    if dry_run:
        return [(s, d) for s, d in plan]

    def one(job: tuple[list[str], str]) -> str:
        parts = [read(f, None, columns, dtypes) for f in job[0]]
        whole = parts[0] if len(parts) == 1 else union(parts, on_mismatch)
        fmt = for_path(job[1], format)
        fmt.write(whole, job[1], **({"batch_size": batch_size} if batch_size and fmt.name in ("parquet", "feather") else {}))
        return job[1]

    workers = resolve_workers(max_workers, len(plan))
    done = list(map(one, plan)) if workers == 1 else list(ThreadPoolExecutor(workers).map(one, plan))
    return done if many and len(plan) != 1 or isinstance(source, (list, tuple)) and dest is None else done[0]


def _named(f: str, i: int, dest: Any, format: str | None, rename: Any, output_dir: Any) -> str:
    p = Path(f)
    if dest is not None:
        name = str(dest).format(index=i, stem=p.stem, name=p.name, parent=p.parent.name) if "{" in str(dest) else os.fspath(dest)
    else:
        suffix = get(format).extensions[0] if format else paths.EXTENSION
        stem = rename(p.stem) if callable(rename) else rename.get(p.stem, p.stem) if isinstance(rename, dict) else p.stem
        name = str(Path(output_dir or p.parent) / f"{stem}{suffix}")
    return str(Path(output_dir) / name) if output_dir and dest is not None else name


def resolve_workers(n: Any, jobs: int) -> int:
    from ..plans.config import get_convert_auto_workers

    if n is None:
        return 1
    if n == "auto":
        return max(1, min(get_convert_auto_workers(), jobs))
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("max_workers is None, 'auto' or a positive int")
    return n


def _importer(name: str) -> Any:
    def fn(source: Any, dest: Any = None, **how: Any) -> Table:
        if dest is None:
            return read(source, name, **how)
        return store(read(source, name, **{k: how.pop(k) for k in list(how) if k in ("columns", "dtypes", "key", "orient", "treename", "keep_valid_only")}), dest, mode="recreate" if how.pop("overwrite", False) else "create")

    fn.__name__ = f"from_{name}"
    fn.__doc__ = f"A {name} file as a table, written to ``dest`` if given."
    return fn


from_npz, from_parquet, from_feather, from_json, from_hdf, from_root = (_importer(n) for n in ("npz", "parquet", "feather", "json", "hdf5", "root"))


# -- datasets of shards


def concat(sources: list[Any], *, out: Any = None, on_mismatch: str = "strict", memory_budget: Any = None) -> Table:
    """All sources one after the other; written to ``out``, which is none of them, if given."""
    whole = open_table(list(sources), on_mismatch=on_mismatch)
    if out is None:
        return whole
    if any(os.path.abspath(str(s)) == os.path.abspath(os.fspath(out)) for s in whole.paths):
        raise ValueError("the result can't replace one of its sources")
    return store(whole, out)


def compact(path: Any, *, out: Any = None, show_progress: bool = True) -> Path:
    """All part files of a table as one sorted file; in place, or to ``out``."""
    import pyarrow.parquet as pq

    path = os.fspath(path)
    parts = paths.shards(path) if os.path.isdir(path) else [path]
    if out is None and len(parts) <= 1 and all(pq.ParquetFile(p).num_row_groups <= 1 for p in parts):
        return Path(path)
    t = open_table(path)
    if out is None and os.path.isdir(path) and not paths.is_spark_output(path):
        target = os.path.join(path, f".compact-{uuid.uuid4().hex}{paths.EXTENSION}")
        Parquet().write(t, target, batch_size=1 << 30)
        for p in parts:
            os.remove(p)
        os.replace(target, parts[0])
        return Path(path)
    target = os.fspath(out) if out is not None else f"{path}.compact"
    Parquet().write(t, target, batch_size=1 << 30)
    if out is None:
        shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        os.replace(target, path)
        target = path
    return Path(target)


def append(directory: Any, data: Any, *, name: str = "shard_{index:05d}.parquet", statistics: bool = False, batch_size: Any = "auto", show_progress: bool = True) -> Path:
    """One more shard, whole or not at all; its columns are those of the shards that are there."""
    directory = os.fspath(directory)
    os.makedirs(directory, exist_ok=True)
    if isinstance(data, (str, os.PathLike)) and os.path.abspath(data) == os.path.abspath(directory):
        raise ValueError("a dataset can't be appended to itself")
    source, there = as_source(data), paths.shards(directory)
    if there:
        have = open_table(there[0])._dtypes
        same = lambda a, b: a == b or a.kind == b.kind and a.kind in "SU"
        if list(have) != source.columns or not all(same(have[n], t) for n, t in source.dtypes.items()):
            raise ValueError("the shard has other columns or dtypes than the dataset")
    used = [int("".join(c for c in os.path.splitext(os.path.basename(p))[0].rpartition("_")[2] if c.isdigit()) or -1) for p in there]
    file = name.format(index=max(used, default=-1) + 1)
    if not file.endswith(paths.EXTENSION) or os.sep in file:
        raise ValueError(f"a shard's name ends with {paths.EXTENSION}")
    target = os.path.join(directory, file)
    if os.path.exists(target):
        raise FileExistsError(target)
    Parquet().write(source, target)
    return Path(target)


class Appender:
    """Buffers columns and writes a shard whenever ``shard_size`` (rows or bytes) is reached, on flush and on close."""

    def __init__(self, directory: Any, *, name: str = "shard_{index:05d}.parquet", shard_size: Any = None, statistics: bool = False):
        self.directory, self.name, self.size, self.n_shards, self.pending_rows, self._held, self._kinds = os.fspath(directory), name, shard_size, 0, 0, [], None

    def write(self, data: Any) -> None:
        if isinstance(data, dict) and not data:
            return
        columns = columns_of(data)
        kinds = {n: (v.dtype.kind if v.dtype.kind in "SU" else v.dtype) for n, v in columns.items()}
        if self._kinds not in (None, kinds):
            raise ValueError("other columns or dtypes than before")
        self._kinds = kinds
        self._held.append(columns)
        self.pending_rows += len(next(iter(columns.values())))
        if self.size is not None:
            from .sizes import batch_rows

            if self.pending_rows >= batch_rows(self.size, {n: v.dtype for n, v in columns.items()}):
                self.flush()

    def flush(self) -> None:
        if self.pending_rows:
            append(self.directory, {n: np.concatenate([c[n] for c in self._held]) for n in self._held[0]}, name=self.name)
            self.n_shards += 1
        self._held, self.pending_rows = [], 0

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Appender:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None:
            self.close()


def appender(directory: Any, **how: Any) -> Appender:
    return Appender(directory, **how)


class Writer:
    """A record stream into one table: a part file a write, published together on close, under a lock."""

    def __init__(self, path: Any, mode: str):
        import fcntl

        self.path, self._kinds, self._n, self.closed = os.fspath(path), None, 0, True
        if mode == "create" and os.path.exists(self.path):
            raise FileExistsError(self.path)
        self._lock = open(f"{self.path}.lock", "w")  # noqa: SIM115
        try:
            fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            self._lock.close()
            raise RuntimeError(f"{self.path} is being written") from None
        self._tmp = f"{self.path}.tmp"
        shutil.rmtree(self._tmp, ignore_errors=True)  # what a crash left
        os.makedirs(self._tmp)
        self.closed = False
        if mode == "update" and os.path.exists(self.path):
            for i, p in enumerate(paths.shards(self.path) if os.path.isdir(self.path) else [self.path]):
                shutil.copy(p, os.path.join(self._tmp, f"part_{i:06d}.parquet"))
                self._n = i + 1
            self._kinds = {n: t for n, t in open_table(self.path)._dtypes.items()}

    def write(self, columns: Any) -> None:
        if self.closed:
            raise ValueError("the writer is closed")
        if isinstance(columns, dict) and not columns:
            return
        import pyarrow.parquet as pq

        got = columns_of(columns)
        kinds = {n: v.dtype for n, v in got.items()}
        same = lambda a, b: a == b or a.kind == b.kind and a.kind in "SU"
        if self._kinds is not None and (list(self._kinds) != list(kinds) or not all(same(self._kinds[n], kinds[n]) for n in kinds)):
            raise ValueError("other columns or dtypes than the first record's")
        from ..operators.table import arrow_of

        self._kinds = self._kinds or kinds
        t = arrow_of(got)
        t = t.cast(pa.schema([f.with_metadata({KEY: kinds[f.name].str}) for f in t.schema]))
        pq.write_table(t, os.path.join(self._tmp, f"part_{self._n:06d}.parquet"))
        self._n += 1

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        try:
            if self._n:
                if os.path.isdir(self.path):
                    shutil.rmtree(self.path)
                elif os.path.exists(self.path):
                    os.remove(self.path)
                os.replace(self._tmp, self.path)
        finally:
            shutil.rmtree(self._tmp, ignore_errors=True)
            self._lock.close()
            if os.path.exists(f"{self.path}.lock"):
                os.remove(f"{self.path}.lock")

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def __del__(self) -> None:
        if not getattr(self, "closed", True):
            warnings.warn("a writer was not closed", ResourceWarning, stacklevel=2)
            self.close()


def create(path: Any, *, statistics: bool = False) -> Writer:
    return Writer(path, "create")


def recreate(path: Any, *, statistics: bool = False) -> Writer:
    return Writer(path, "recreate")


def update(path: Any, *, statistics: bool = False) -> Writer:
    return Writer(path, "update")


# -- introspection


def info(path: Any) -> dict[str, Any]:
    """Rows, records (row groups), columns and bytes of a table, from footers only."""
    import pyarrow.parquet as pq

    files = [f for p in paths.resolve(path) for f in (glob.glob(os.path.join(p, "*.parquet")) if os.path.isdir(p) else [p])]
    metas = [pq.ParquetFile(f).metadata for f in files]
    records = sum(m.num_row_groups for m in metas)
    return {"path": os.fspath(path), "n_rows": sum(m.num_rows for m in metas), "n_records": records, "columns": schema(path), "file_size": sum(os.path.getsize(f) for f in files), "needs_compaction": records > 1}


def schema(path: Any) -> dict[str, np.dtype]:
    return open_table(path)._dtypes


