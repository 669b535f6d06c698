"""Registered queries that go through files, memory, batches and reports, with the SQL that says the same.

What is written goes to a folder of its own in the one that the cluster shares; see ``folder``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import QueryError, col
from ..operators.table import Table, from_memory, open_table, union
from ..sources import formats
from . import config, preview
from .catalog import ORACLES, QUERIES, table


def folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, on a single machine only, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = os.path.join((shared or tempfile.gettempdir()).removeprefix("file://"), f"roundtrip-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def query(name: str, source: str, sql: str) -> Callable:
    """Register ``f(table, folder) -> selection, DataFrame or dict of columns``."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(table(spark, sf_dir, source), folder(spark))
            if isinstance(out, dict):
                out = from_memory({k: np.asarray(v) for k, v in out.items()}, spark)
            return out if isinstance(out, DataFrame) else out.df

        QUERIES[name], ORACLES[name] = run, sql
        return f

    return add


def _shards(t: Table, path: str, names: tuple[str, ...] = ("run_1", "run_2", "run_10")) -> list[str]:
    """The first 90 rows in three files."""
    return [formats.save(t[30 * i : 30 * i + 30], os.path.join(path, f"{n}.parquet")) for i, n in enumerate(names)]


_FIRST = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 90"
_AT = "SELECT o_orderkey FROM orders WHERE o_orderkey >= 25 AND o_orderkey < 70"
_KEYS = ["o_orderkey", "o_totalprice"]

# sources
query("open_list", "orders", _FIRST)(lambda t, p: open_table(_shards(t, p)).select(*_KEYS))
query("open_list_positions", "orders", _AT)(lambda t, p: open_table(_shards(t, p))[25:70, ["o_orderkey"]])
query("open_glob_natural_order", "orders", _AT)(lambda t, p: (_shards(t, p), open_table(f"{p}/run_*.parquet"))[1][25:70, ["o_orderkey"]])
query("open_folder", "orders", _AT)(lambda t, p: (_shards(t, p), open_table(p))[1][25:70, ["o_orderkey"]])
query("open_mixed", "orders", f"{_FIRST} UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 5")(lambda t, p: open_table([_shards(t, p), t[:5].df]).select(*_KEYS))
query("open_dataframe_slice", "orders", _AT)(lambda t, p: open_table(t.df)[25:70, ["o_orderkey"]])
query("open_dataframe_shuffled", "orders", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")(lambda t, p: open_table(t.df.repartition(7))[::-1].df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s")))
query("open_ignores_options", "region", "SELECT * FROM region")(lambda t, p: open_table(t.paths[0], backend="mmap", numa_policy="interleave", madvise="random"))
query("open_empty_folder", "region", "SELECT 0 AS n_rows, 0 AS n_columns")(lambda t, p: {"n_rows": [np.int32(open_table(p).n_rows)], "n_columns": [np.int32(open_table(p).n_columns)]})
query("grow_in_place", "orders", _AT)(lambda t, p: (s := _shards(t, p), open_table(s[0]).append(s[1]).append(s[2]))[1][25:70, ["o_orderkey"]])
query("read_parquet_checked", "supplier", "SELECT * FROM supplier")(lambda t, p: formats.from_parquet(t.paths[0]))
query("from_memory", "nation", "SELECT n_nationkey, n_name FROM nation")(lambda t, p: from_memory(t.select("n_nationkey", "n_name").dict()))
query("from_pandas", "nation", "SELECT n_nationkey, n_name FROM nation")(lambda t, p: from_memory(t.select("n_nationkey", "n_name").frame()))
for _n, _e in {"feather": ".feather", "json": ".json", "npz": ".npz", "parquet": ".pq"}.items():
    query(f"{_n}_round_trip", "customer", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 9")(
        lambda t, p, e=_e: formats.read(t.query("c_nationkey < 9").select("c_custkey", "c_acctbal", "c_mktsegment").saveas(f"{p}/x{e}")))
query("json_lines", "nation", "SELECT * FROM nation")(lambda t, p: (formats.get("json").write(t, f"{p}/x", lines=True), t.spark.read.schema(t.df.schema).json(f"{p}/x"))[1])


# sinks
def _written(t: Table, path: str, mode: str = "create", rows: int = 40) -> Table:
    """The first 120 rows as a stream of records."""
    with getattr(formats, mode)(f"{path}/w.parquet") as w:
        for a in range(0, 120, rows):
            w.write(t[a : a + rows].select(*_KEYS).dict())
    return open_table(f"{path}/w.parquet")


_W = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 120"
query("store_create", "orders", "SELECT * FROM orders")(lambda t, p: formats.store(t, f"{p}/a.parquet"))
query("store_recreate", "orders", _AT)(lambda t, p: (formats.store(t[:9], f"{p}/a.parquet"), formats.store(t, f"{p}/a.parquet", mode="recreate"))[1][25:70, ["o_orderkey"]])
query("write_records", "orders", _W)(lambda t, p: _written(t, p))
query("append_record", "orders", f"{_W} UNION ALL {_W}")(lambda t, p: (_written(t, p), _written(t, p, "update"))[1])


def _crashed(t: Table, p: str) -> Table:
    os.makedirs(f"{p}/w.parquet.tmp")  # what a writer that died leaves
    with open(f"{p}/w.parquet.tmp/part_000000.parquet", "wb") as f:
        f.write(b"half a file")
    return _written(t, p)


query("write_after_crash", "orders", _W)(_crashed)
query("frame_write", "lineitem", "SELECT l_orderkey, l_quantity * 2 AS q FROM lineitem WHERE l_tax > 0.07")(lambda t, p: t.edit().where("l_tax > 0.07").assign(q=col("l_quantity") * 2).select("l_orderkey", "q").write(f"{p}/f.parquet"))
query("frame_write_keeps_order", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 5 AND o_orderkey <= 94 AND o_orderkey % 2 = 0")(lambda t, p: t[100::-1].edit().where("o_orderkey % 2 == 0").write(f"{p}/f.parquet")[3:48, ["o_orderkey"]])
query("save_columns", "part", "SELECT p_size, p_partkey FROM part WHERE p_partkey < 50")(lambda t, p: open_table(t[:50, ["p_size", "p_partkey"]].saveas(f"{p}/s.parquet")))
query("append_shards", "orders", _AT)(lambda t, p: ([formats.append(f"{p}/d", t[30 * i : 30 * i + 30]) for i in range(3)], open_table(f"{p}/d"))[1][25:70, ["o_orderkey"]])


def _appended(t: Table, p: str) -> Any:
    with formats.appender(f"{p}/d", shard_size=50) as a:
        for i in range(0, 120, 20):
            a.write(t[i : i + 20].select(*_KEYS).dict())
    return open_table(f"{p}/d").df.withColumn("shards", F.lit(len(os.listdir(f"{p}/d"))))


query("appender", "orders", "SELECT o_orderkey, o_totalprice, 2 AS shards FROM orders WHERE o_orderkey < 120")(_appended)
query("compact_shards", "orders", _AT)(lambda t, p: ([formats.append(f"{p}/d", t[30 * i : 30 * i + 30]) for i in range(3)], formats.compact(f"{p}/d"), open_table(f"{p}/d"))[2][25:70, ["o_orderkey"]])
query("concat_to_file", "orders", _AT)(lambda t, p: formats.concat(_shards(t, p), out=f"{p}/all.parquet")[25:70, ["o_orderkey"]])
query("convert_one", "nation", "SELECT * FROM nation")(lambda t, p: formats.read(formats.convert(t.saveas(f"{p}/n.npz"), f"{p}/n.feather")))
query("convert_many", "orders", _FIRST)(lambda t, p: (formats.convert(_shards(t, p), output_dir=p, format="feather", max_workers="auto"), union([formats.read(f"{p}/run_{i}.feather") for i in (1, 2, 10)]))[1].select(*_KEYS))
query("convert_command", "nation", "SELECT * FROM nation")(lambda t, p: (_command(["convert", t.saveas(f"{p}/n.npz"), "-o", f"{p}/n.parquet"]), open_table(f"{p}/n.parquet"))[1])
query("import_to_file", "nation", "SELECT n_nationkey FROM nation")(lambda t, p: formats.from_npz(t.saveas(f"{p}/n.npz"), f"{p}/n.parquet", columns=["n_nationkey"]))
query("dtype_override", "orders", "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_totalprice AS BIGINT) AS o_totalprice FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey < 50)")(
    lambda t, p: formats.read(t[:50, _KEYS].saveas(f"{p}/x.npz"), dtypes={"o_orderkey": "i4", "o_totalprice": "i8"}))


def _command(args: list[str]) -> int:
    import contextlib
    import io

    from ..__main__ import main

    with contextlib.redirect_stdout(io.StringIO()):
        return main(args)


class _Csv(formats.DataFormat):
    name, extensions = "plain-csv", (".csv",)

    def write(self, source: Any, dest: str, **how: Any) -> None:
        source.frame().to_csv(dest, index=False)

    def read(self, path: str, columns: list[str] | None = None, **how: Any) -> Table:
        import pandas as pd

        return from_memory(pd.read_csv(path, usecols=columns))


query("custom_format", "nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")(lambda t, p: (formats.register(_Csv()), formats.read(t.saveas(f"{p}/x.csv"), columns=["n_nationkey", "n_name"]))[1])

# memory and batches
_L = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45"
_big = lambda t: t.edit().where("l_quantity > 45").select("l_orderkey", "l_quantity")
query("iter_batches", "lineitem", _L)(lambda t, p: union(b._table for b in _big(t).iter_batches(1000)))
query("export_batches", "lineitem", _L)(lambda t, p: t.spark.createDataFrame(pa.concat_tables(formats.batches(_big(t), "8 KiB"))))
query("to_arrow", "supplier", "SELECT * FROM supplier")(lambda t, p: t.spark.createDataFrame(pa.table(t.to("arrow"))))
query("to_recarray", "supplier", "SELECT * FROM supplier")(lambda t, p: from_memory(t.recarray()))
query("to_array", "part", "SELECT p_size FROM part WHERE p_partkey % 3 = 1")(lambda t, p: {"p_size": np.asarray(t[1::3]["p_size"])})
query("eager_column", "part", "SELECT p_size * 2 + 1 AS x FROM part")(lambda t, p: {"x": t["p_size"] * 2 + np.asarray(np.int32(1))})
query("column_reductions", "orders", "SELECT CAST(sum(o_custkey) AS BIGINT) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS m, round(stddev_pop(o_custkey), 6) AS sd FROM orders")(
    lambda t, p: {"s": [np.sum(t["o_custkey"])], "lo": [t["o_totalprice"].min()], "hi": [np.max(t["o_totalprice"])], "m": [round(float(np.mean(t["o_totalprice"])), 4)], "sd": [round(float(t["o_custkey"].std()), 6)]})

# expressions
_E = "event_id, value"
query("derive_signs", "events", f"SELECT {_E}, -value AS n, abs(value) AS a, CAST(sign(value) AS DOUBLE) AS s FROM events")(lambda t, p: t.edit().select("event_id", "value").assign(n=-col("value"), a=np.fabs(col("value")), s=np.sign(col("value"))))
query("derive_half_even", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS r FROM lineitem")(lambda t, p: t.edit().assign(r=np.rint(col("l_quantity") / 2)).select("l_orderkey", "l_linenumber", "r"))
query("derive_nan_extremes", "events", "SELECT event_id, greatest(value, 40.0) AS a, least(value, 40.0) AS b FROM events")(lambda t, p: t.edit().assign(a=np.fmax(col("value"), np.where(col("event_id") > -1, 40.0, np.nan)), b=np.fmin(col("value"), 40.0)).select("event_id", "a", "b"))
query("derive_logs", "events", "SELECT event_id, round(log2(abs(value) + 1), 9) AS a, round(log10(abs(value) + 1), 9) AS b, round(ln(1 + abs(value)), 9) AS c, round(exp(value / 1000) - 1, 9) AS d, round(pow(2, value / 1000), 9) AS e, round(cbrt(value), 9) AS f FROM events")(
    lambda t, p: t.edit().assign(a=np.log2(np.abs(col("value")) + 1), b=np.log10(np.abs(col("value")) + 1), c=np.log1p(np.abs(col("value"))), d=np.expm1(col("value") / 1000), e=np.exp2(col("value") / 1000), f=np.cbrt(col("value"))).df.select("event_id", *(F.round(c, 9).alias(c) for c in "abcdef")))
query("derive_trigonometry", "lineitem", "SELECT l_orderkey, l_linenumber, round(cos(l_tax), 9) AS a, round(tan(l_tax), 9) AS b, round(asin(l_tax), 9) AS c, round(acos(l_tax), 9) AS d, round(atan(l_quantity), 9) AS e, round(atan2(l_tax, l_quantity), 9) AS f, round(sqrt(l_tax * l_tax + l_quantity * l_quantity), 9) AS g, round(degrees(l_tax), 9) AS h, round(radians(l_quantity), 9) AS i FROM lineitem")(
    lambda t, p: t.edit().assign(a=np.cos(col("l_tax")), b=np.tan(col("l_tax")), c=np.arcsin(col("l_tax")), d=np.arccos(col("l_tax")), e=np.arctan(col("l_quantity")), f=np.arctan2(col("l_tax"), col("l_quantity")), g=np.hypot(col("l_tax"), col("l_quantity")), h=np.degrees(col("l_tax")), i=np.radians(col("l_quantity"))).df.select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(c) for c in "abcdefghi")))
query("derive_float_tests", "nation", "SELECT n_nationkey, n_nationkey = 0 AND n_regionkey = 0 AS nan, n_nationkey > 0 AND n_regionkey = 0 AS inf, n_regionkey <> 0 AS fin FROM nation")(
    lambda t, p: t.edit().assign(q=col("n_nationkey") / col("n_regionkey")).assign(nan=np.isnan(col("q")), inf=np.isinf(col("q")), fin=np.isfinite(col("q"))).select("n_nationkey", "nan", "inf", "fin"))
query("derive_rare_ufuncs", "part", "SELECT p_partkey, CAST(gcd(p_size, 12) AS INTEGER) AS g, CAST(bit_count(p_size) AS SMALLINT) AS b, CASE WHEN p_size > 20 THEN 1.0 WHEN p_size = 20 THEN 0.5 ELSE 0.0 END AS h, round(ln(exp(p_size / 10.0) + exp(2.0)), 9) AS l FROM part")(
    lambda t, p: t.edit().assign(g=np.gcd(col("p_size"), 12), b=np.bitwise_count(col("p_size")), h=np.heaviside(col("p_size") - 20.0, 0.5), l=np.logaddexp(col("p_size") / 10.0, 2.0)).df.select("p_partkey", "g", "b", "h", F.round("l", 9).alias("l")))
_SHIP = np.datetime64("1995-01-01", "us")
query("derive_dates", "lineitem", "SELECT l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '1995-01-01' AS early, l_shipdate + INTERVAL 2 DAY AS later FROM lineitem")(lambda t, p: t.edit().assign(early=col("l_shipdate") < _SHIP, later=col("l_shipdate") + np.timedelta64(2, "D")).select("l_orderkey", "l_linenumber", "early", "later"))
query("derive_strings", "part", "SELECT p_partkey, CAST(length(p_brand) AS BIGINT) AS n, upper(p_name) AS u, starts_with(p_type, 'S') AS s FROM part")(
    lambda t, p: (f := t.edit()).assign(n=np.strings.str_len(col("p_brand")).astype("i8"), u=f.apply(np.char.upper, "p_name", out_dtype="U"), s=np.strings.startswith(col("p_type"), "S", 0, 99)).select("p_partkey", "n", "u", "s"))
query("filter_bool_column", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")(lambda t, p: t.edit().assign(big=col("o_totalprice") > 150000).where("big").select("o_orderkey"))
query("filter_at_in_text", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey < 9 AND o_orderstatus <> 'a@b'")(lambda t, p: t.query("o_orderkey < @n and o_orderstatus != 'a@b'", params={"n": 9}).select("o_orderkey"))
query("view_to_frame", "orders", "SELECT o_orderkey, o_totalprice / 2 AS h FROM orders WHERE o_totalprice > 200000")(lambda t, p: t.query("o_totalprice > 200000").edit().assign(h=col("o_totalprice") / 2).select("o_orderkey", "h"))
query("rows_to_frame", "orders", "SELECT o_orderkey, o_custkey + 1 AS c FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 90 AND o_orderkey % 5 = 0 AND o_custkey > 20")(lambda t, p: t[10:90:5].edit().where("o_custkey > 20").assign(c=col("o_custkey") + 1).select("o_orderkey", "c"))
query("frame_copy", "region", "SELECT r_regionkey FROM region")(lambda t, p: (f := t.edit().select("r_regionkey"), f.copy().assign(x=1, inplace=True), f)[2])
query("other_frame_column", "region", "SELECT r_regionkey, r_regionkey * 3 AS x FROM region")(lambda t, p: t.edit().select("r_regionkey").assign(x=from_memory({"k": t["r_regionkey"].array()}).edit().assign(y=col("k") * 3)["y"]))

# unions, cutflows
query("union_other_order", "nation", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")(lambda t, p: union([t.select("n_nationkey", "n_name").edit().write(f"{p}/a.parquet"), t.select("n_name", "n_nationkey").edit().write(f"{p}/b.parquet")]))


def _dropped(t: Table, p: str) -> Table:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return union([t, t.drop("n_name").edit().assign(n_nationkey=col("n_nationkey") * 1.0).write(f"{p}/b.parquet")], "drop")


query("union_common_columns", "nation", "SELECT n_regionkey FROM nation UNION ALL SELECT n_regionkey FROM nation")(_dropped)


def _weighted(t: Table, p: str) -> dict:
    r = t.edit().where("l_quantity > 20", "big", weight="l_quantity").where("l_returnflag == 'N'", "kept").report().records()
    return {k: [x[k] for x in r] for k in ("label", "entering", "passing", "weighted_entering", "weighted_passing")} | {"eff": [round(x["efficiency"], 9) for x in r], "weff": [round(x["weighted_efficiency"], 9) for x in r]}


query(
    "cutflow_weighted", "lineitem",
    "WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_quantity > 20) AS a, count(*) FILTER (l_quantity > 20 AND l_returnflag = 'N') AS b, sum(l_quantity) AS w, sum(l_quantity) FILTER (l_quantity > 20) AS wa, sum(l_quantity) FILTER (l_quantity > 20 AND l_returnflag = 'N') AS wb FROM lineitem) "
    "SELECT 'big' AS label, n AS entering, a AS passing, w AS weighted_entering, wa AS weighted_passing, round(a / n, 9) AS eff, round(wa / w, 9) AS weff FROM c UNION ALL SELECT 'kept', a, b, wa, wb, round(b / a, 9), round(wb / wa, 9) FROM c",
)(_weighted)


# what is refused, and introspection
def _raised(f: Callable[[], Any]) -> str:
    try:
        f()
    except Exception as e:  # noqa: BLE001  the outcome is the result
        return type(e).__name__
    return "nothing"


def _refused(t: Table, p: str) -> dict:
    _shards(t, p)
    nulls = formats.store(t[:3], f"{p}/n.parquet")._df.select(F.when(F.col("o_orderkey") > 0, F.col("o_orderkey")).alias("k"))
    nulls.write.parquet(f"{p}/nulls.parquet")
    t.df.limit(1).select(F.array("o_orderkey").alias("k")).write.parquet(f"{p}/nested.parquet")
    t.df.limit(1).select(F.lit(datetime(2020, 1, 1)).alias("k")).write.parquet(f"{p}/zoned.parquet")
    with formats.create(f"{p}/locked.parquet") as w:
        w.write({"a": np.arange(2)})
        locked = _raised(lambda: formats.recreate(f"{p}/locked.parquet"))
    cases: dict[str, Callable] = {
        "unknown column": lambda: t.query("nope > 1"), "no predicate": lambda: t.query("o_orderkey + 1"), "truth value": lambda: bool(col("a") > 1), "reduction of an expression": lambda: np.add.reduce(col("a")),
        "rows of a frame": lambda: t.edit()[3], "no copy": lambda: t.dict(copy=False), "row out of range": lambda: t[10**9].dict(), "file exists": lambda: formats.store(t, f"{p}/run_1.parquet"), "no match": lambda: open_table(f"{p}/x*.parquet"),
        "other schema": lambda: union([t, t.drop("o_custkey").edit().write(f"{p}/d.parquet")]), "nulls": lambda: formats.from_parquet(f"{p}/nulls.parquet"), "nulls in memory": lambda: open_table(f"{p}/nulls.parquet").dict(),
        "nested": lambda: open_table(f"{p}/nested.parquet"), "zoned": lambda: open_table(f"{p}/zoned.parquet"), "closed": lambda: _closed(t), "workers": lambda: formats.resolve_workers(0, 3), "sum of text": lambda: t.edit().sum("o_orderstatus"),
    }
    got = {k: _raised(f) for k, f in cases.items()} | {"locked": locked}
    return {"refused": list(got), "with": list(got.values())}


def _closed(t: Table) -> Any:
    with open_table(t.paths[0]) as closed:
        pass
    return closed[0].dict()


_OUTCOMES = {
    "unknown column": QueryError, "no predicate": QueryError, "truth value": TypeError, "reduction of an expression": TypeError, "rows of a frame": TypeError, "no copy": ValueError, "row out of range": IndexError, "file exists": FileExistsError,
    "no match": FileNotFoundError, "other schema": ValueError, "nulls": TypeError, "nulls in memory": TypeError, "nested": TypeError, "zoned": TypeError, "closed": ValueError, "workers": ValueError, "sum of text": TypeError, "locked": RuntimeError,
}
query("refusals", "orders", "SELECT * FROM (VALUES {}) v(refused, \"with\")".format(", ".join(f"('{k}', '{e.__name__}')" for k, e in _OUTCOMES.items())))(_refused)
query("counts", "orders", "SELECT count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS f, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey >= 5 AND o_orderkey % 2 = 1) AS s, CAST(6 AS BIGINT) AS c FROM orders")(
    lambda t, p: {"n": [len(t)], "f": [t.query("o_totalprice > 100000").count()], "s": [t[5::2].n_rows], "c": [t.shape[1]]})
query("info_of_shards", "orders", "SELECT CAST(90 AS BIGINT) AS n_rows, CAST(3 AS BIGINT) AS n_records, CAST(6 AS BIGINT) AS n_columns, true AS needs_compaction")(
    lambda t, p: (_shards(t, p), i := formats.info(p), {"n_rows": [i["n_rows"]], "n_records": [i["n_records"]], "n_columns": [len(i["columns"])], "needs_compaction": [i["needs_compaction"]]})[2])
query("schema_of_file", "part", "SELECT * FROM (VALUES ('p_partkey', '<i8'), ('p_name', '<U0'), ('p_brand', '<U0'), ('p_type', '<U0'), ('p_size', '<i4'), ('p_retailprice', '<f8')) v(name, dtype)")(lambda t, p: {"name": list(s := formats.schema(t.paths[0])), "dtype": [k.str for k in s.values()]})


def _previewed(t: Table, p: str) -> dict:
    rows = config.get_preview_rows()
    config.set_preview_rows(2)
    try:
        lines = preview.text(t.select("r_regionkey")).split("\n")
    finally:
        config.set_preview_rows(rows)
    return {"place": np.arange(len(lines)), "line": [x.strip() for x in lines]}


query("preview_rows", "region", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'r_regionkey'), (1, '0'), (2, '1'), (3, '[5 rows x 1 columns]')) v(place, line)")(_previewed)
