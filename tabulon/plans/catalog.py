"""Registered queries over the tables of a data folder, with the SQL that says the same.

Each query goes through the library's own operators; sums of floating-point numbers are rounded, since their last digits
depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import col
from ..operators.table import Table, open_table, union

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return open_table(f"{sf_dir.rstrip('/')}/{name}.parquet", spark=spark)


def query(name: str, source: str, sql: str | None) -> Callable:
    """Register ``f(table) -> selection or DataFrame`` over one table."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(table(spark, sf_dir, source))
            return out if isinstance(out, DataFrame) else out.df

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


# scans, projection, schema
query("scan_all", "nation", "SELECT * FROM nation")(lambda t: t)
query("project_column", "orders", "SELECT o_totalprice FROM orders")(lambda t: t["o_totalprice"])
query("project_columns", "orders", "SELECT o_custkey, o_orderkey FROM orders")(lambda t: t[["o_custkey", "o_orderkey"]])
query("select_names", "lineitem", "SELECT l_tax, l_orderkey FROM lineitem")(lambda t: t.select("l_tax", "l_orderkey"))
query("drop_names", "part", "SELECT p_partkey, p_name, p_size FROM part")(lambda t: t.drop("p_brand", "p_type", "p_retailprice"))
query("frame_select", "customer", "SELECT c_name, c_custkey FROM customer")(lambda t: t.edit().select("c_name", "c_custkey"))
query("frame_drop", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier")(lambda t: t.edit().drop("s_name", "s_nationkey"))
query("rename_swap", "supplier", "SELECT s_suppkey AS s_nationkey, s_nationkey AS s_suppkey, s_name, s_acctbal FROM supplier")(lambda t: t.edit().rename({"s_suppkey": "s_nationkey", "s_nationkey": "s_suppkey"}))
query("cast_columns", "lineitem", "SELECT CAST(trunc(l_quantity) AS INTEGER) AS l_quantity, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem")(lambda t: t.edit().select("l_quantity", "l_linenumber").astype({"l_quantity": "i4", "l_linenumber": "f8"}))
query("constant_column", "region", "SELECT r_regionkey, 7 AS c, 'x' AS s FROM region")(lambda t: t.edit().select("r_regionkey").assign(c=np.int32(7), s="x"))

# predicates
query("filter_query_string", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND 0.02 < l_discount AND l_discount < 0.07")(lambda t: t.query("l_quantity > @q and 0.02 < l_discount < 0.07", params={"q": 30}).select("l_orderkey", "l_quantity"))
query("filter_expression", "orders", "SELECT * FROM orders WHERE o_totalprice >= 100000 AND NOT (o_orderstatus = 'F')")(lambda t: t[(col("o_totalprice") >= 100000) & ~(col("o_orderstatus") == "F")])
query("filter_in", "part", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 50)")(lambda t: t.query("p_size in [1, 5, 9, 50]", columns=["p_partkey", "p_size"]))
query("filter_not_in", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")(lambda t: t.query("c_mktsegment not in ['BUILDING', 'MACHINERY']")[["c_custkey"]])
query("filter_or", "events", "SELECT event_id FROM events WHERE event_type = 'click' OR value > 50")(lambda t: t.query("event_type == 'click' or value > 50").select("event_id"))
query("filter_arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 40000")(lambda t: t.query("l_extendedprice * (1 - l_discount) > 40000").select("l_orderkey", "l_linenumber"))
query("filter_truthiness", "nation", "SELECT n_nationkey FROM nation WHERE n_regionkey = 0")(lambda t: t.query("not n_regionkey").select("n_nationkey"))
query("filter_rows_and_columns", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice < 5000")(lambda t: t[col("o_totalprice") < 5000, ["o_orderkey"]])
query("filter_where_choice", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END > 25")(lambda t: t.where(np.where(col("l_returnflag") == "R", col("l_quantity"), 0.0) > 25).select("l_orderkey", "l_linenumber"))
query("filter_evaluated", "supplier", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")(lambda t: t.query("s_acctbal > 0", lazy=False).select("s_suppkey"))

# positions
query("row_scalar", "orders", "SELECT * FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")(lambda t: t[-1])
query("row_slice", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 60")(lambda t: t[10:60, ["o_orderkey"]])
query("row_stride", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 5 AND (o_orderkey - 5) % 7 = 0")(lambda t: t[5::7, ["o_orderkey"]])
query("row_reversed", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 100 AND o_orderkey > 20 AND (100 - o_orderkey) % 3 = 0")(lambda t: t[100:20:-3, ["o_orderkey"]])
query("row_fancy", "customer", "SELECT c_custkey, c_name FROM customer JOIN (VALUES (7), (7), (1), (42)) v(k) ON c_custkey = k")(lambda t: t[[7, 7, 1, 42], ["c_custkey", "c_name"]])
query("row_mask", "region", "SELECT * FROM region WHERE r_regionkey IN (0, 2, 4)")(lambda t: t[np.array([True, False, True, False, True])])
query("row_composed", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 20 AND o_orderkey < 100 AND o_orderkey % 4 = 0")(lambda t: t[0:200:2][10:50:2].select("o_orderkey"))
query("row_head", "part", "SELECT p_partkey, p_name FROM part WHERE p_partkey < 10")(lambda t: t.head().select("p_partkey", "p_name"))
query("row_tail", "part", "SELECT p_partkey FROM part WHERE p_partkey > (SELECT max(p_partkey) - 5 FROM part)")(lambda t: t.tail(5).select("p_partkey"))

# expressions
query("derive_arithmetic", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")(
    lambda t: t.edit().assign(net=col("l_extendedprice") * (1 - col("l_discount"))).assign(gross=col("net") * (1 + col("l_tax"))).select("l_orderkey", "l_linenumber", "net", "gross"))
query("derive_floor_mod", "orders", "SELECT o_orderkey, CAST(floor((o_custkey - 50) / 7.0) AS BIGINT) AS q, (((o_custkey - 50) % 7) + 7) % 7 AS m FROM orders")(
    lambda t: t.edit().assign(q=(col("o_custkey") - 50) // 7, m=(col("o_custkey") - 50) % 7).select("o_orderkey", "q", "m"))
query("derive_divide_by_zero", "nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN CASE WHEN n_nationkey = 0 THEN NULL ELSE -1.0 END ELSE n_nationkey / CAST(n_regionkey AS DOUBLE) END AS q FROM nation")(
    lambda t: t.edit().assign(q=col("n_nationkey") / col("n_regionkey")).df.select("n_nationkey", F.when(F.isnan("q"), None).when(F.col("q") == float("inf"), -1.0).otherwise(F.col("q")).alias("q")))
query("derive_rounding", "lineitem", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, trunc(l_discount * 10) AS t FROM lineitem")(
    lambda t: t.edit().assign(f=np.floor(col("l_extendedprice")), c=np.ceil(col("l_extendedprice")), t=np.trunc(col("l_discount") * 10)).select("l_orderkey", "l_linenumber", "f", "c", "t"))
query("derive_choice", "customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0.0 END AS pos, least(greatest(c_acctbal, -100.0), 100.0) AS clipped, greatest(c_acctbal, 500.0) AS big FROM customer")(
    lambda t: t.edit().assign(pos=np.where(col("c_acctbal") > 0, col("c_acctbal"), 0.0), clipped=col("c_acctbal").clip(-100.0, 100.0), big=np.maximum(col("c_acctbal"), 500.0)).select("c_custkey", "pos", "clipped", "big"))
query("derive_power", "part", "SELECT p_partkey, p_size * p_size AS sq, CAST(p_size * p_size * p_size AS INTEGER) AS cube FROM part")(lambda t: t.edit().assign(sq=np.square(col("p_size")), cube=col("p_size") ** 3).select("p_partkey", "sq", "cube"))
query("derive_bits", "part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS s FROM part")(
    lambda t: t.edit().assign(a=col("p_size") & 12, o=col("p_size") | 3, x=col("p_size") ^ 5, s=np.left_shift(col("p_size"), 2)).select("p_partkey", "a", "o", "x", "s"))
query("derive_bools", "lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS r, l_quantity IN (1.0, 2.0) AS few, l_tax < l_discount AS lower FROM lineitem")(
    lambda t: t.edit().assign(r=col("l_returnflag") == "R", few=col("l_quantity").isin([1.0, 2.0]), lower=col("l_tax") < col("l_discount")).select("l_orderkey", "l_linenumber", "r", "few", "lower"))
query("derive_math", "events", "SELECT event_id, round(sqrt(abs(value)), 9) AS r, round(ln(abs(value) + 1), 9) AS l, round(sin(value), 9) AS s, round(exp(value / 1000), 9) AS e FROM events")(
    lambda t: t.edit().assign(r=np.sqrt(np.abs(col("value"))), l=np.log(np.abs(col("value")) + 1), s=np.sin(col("value")), e=np.exp(col("value") / 1000)).df.select("event_id", *(F.round(c, 9).alias(c) for c in "rlse")))
query("udf_apply", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + l_tax AS y FROM lineitem")(lambda t: (f := t.edit()).assign(y=f.apply(lambda q, x: q * 2 + x, "l_quantity", "l_tax")).select("l_orderkey", "l_linenumber", "y"))
query("attach_array", "region", "SELECT r_regionkey, r_regionkey * 10 AS w FROM region")(lambda t: t.edit().assign(w=np.arange(5, dtype="i8") * 10).select("r_regionkey", "w"))

# reductions and cutflows
query("reduce_all", "lineitem", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 6) AS m, min(l_discount) AS lo, max(l_extendedprice) AS hi, round(var_pop(l_quantity), 6) AS v, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem")(
    lambda t: t.edit().summary(n=("count",), s=("sum", "l_extendedprice"), m=("mean", "l_quantity"), lo=("min", "l_discount"), hi=("max", "l_extendedprice"), v=("var", "l_quantity"), sd=("std", "l_quantity", 1)).select("n", F.round("s", 2).alias("s"), F.round("m", 6).alias("m"), "lo", "hi", F.round("v", 6).alias("v"), F.round("sd", 6).alias("sd")))
query("reduce_integers", "orders", "SELECT CAST(sum(o_custkey) AS BIGINT) AS s, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS n FROM orders WHERE o_orderstatus = 'O'")(lambda t: t.edit().where("o_orderstatus == 'O'").summary(s=("sum", "o_custkey"), lo=("min", "o_custkey"), hi=("max", "o_custkey"), n=("count",)))
query("reduce_derived", "lineitem", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")(
    lambda t: t.edit().where("0.05 <= l_discount <= 0.07 and l_quantity < 24").summary(revenue=("sum", col("l_extendedprice") * col("l_discount"))).select(F.round("revenue", 2).alias("revenue")))
_CUTS = "SELECT 0 AS place, 'big' AS label, count(*) AS entering, count(*) FILTER (l_quantity > 20) AS passing FROM lineitem UNION ALL SELECT 1, 'cheap', count(*) FILTER (l_quantity > 20), count(*) FILTER (l_quantity > 20 AND l_extendedprice < 50000) FROM lineitem UNION ALL SELECT 2, '#2', count(*) FILTER (l_quantity > 20 AND l_extendedprice < 50000), count(*) FILTER (l_quantity > 20 AND l_extendedprice < 50000 AND l_returnflag = 'N') FROM lineitem"
query("cutflow", "lineitem", _CUTS)(lambda t: t.edit().where("l_quantity > 20", "big").where("l_extendedprice < 50000", "cheap").where("l_returnflag == 'N'").report_df())

# unions
query("union_all", "nation", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")(lambda t: union([t, t]).select("n_nationkey", "n_name"))
query("union_positions", "region", "SELECT r_regionkey FROM region WHERE r_regionkey >= 3 UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey < 2")(lambda t: union([t, t])[3:7].select("r_regionkey"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derive, cut and select over lineitem."""
    f = table(spark, sf_dir, "lineitem").edit().assign(net=col("l_extendedprice") * (1 - col("l_discount")))
    return f.where("l_quantity > 10 and net > 1000").select("l_orderkey", "l_linenumber", "net").df
