"""What the operators of this subpackage share: table access, materialisation in the folder that the cluster shares, lookups of hot keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python: bounds a worker's memory when documents are long.
ARROW_ROWS = 2000
#: A key is hot if more than HOT_LEAST rows and more than one in HOT_KEYS of all rows have it; so at most HOT_KEYS keys are hot.
HOT_LEAST, HOT_KEYS = 256, 100_000
#: Ways into which the rows of a hot key are dealt.
SALTS = 1024

_fallback: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where it is on the driver's path only."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if getattr(sc, "_tabulon_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tabulon-")) / "tabulon_llm.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "tabulon").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._tabulon_shipped = True


def prepare(spark: SparkSession) -> None:
    """What the operators ask of a session: importable code in Python workers, and Arrow batches of at most ARROW_ROWS rows.

    The session keeps this limit: Spark reads it when a plan runs, which is after an operator has returned.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder, through Spark's reader (a file or a folder of part files, any file system)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a folder of our own, on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="tabulon-"))
    return path.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and losing executors costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulon-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names of our own, so that no column of the caller's clashes with one of an operator's; and the name of each."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], n: int, times: str, spread: Column) -> DataFrame:
    """``rows`` with the other columns of ``values`` by equal ``keys`` (nulls where there are none).

    ``values`` has one row a key, and in ``times`` how many of the ``n`` rows have the key; ``spread``: what tells rows of one
    key apart. Values of hot keys, if there are any, are broadcast; their rows need no match after that and are dealt by a
    salt, so that no task of the join has more than a share of them. A null key has no values.
    """
    bound = max(HOT_LEAST, n // HOT_KEYS)
    values = stored(values, "values")
    others = [c for c in values.columns if c not in (*keys, times)]
    named = values.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.struct(*others).alias("__v"), F.col(times).alias("__times"))
    same = lambda a, b: [a[k] == b[f"__k{i}"] for i, k in enumerate(keys)]
    if named.where(F.col("__times") > bound).isEmpty():
        out, got = rows.join(named, same(rows, named), "left"), F.col("__v")
    else:
        hot = named.where(F.col("__times") > bound).withColumnRenamed("__v", "__hot").drop("__times")
        cold = named.where(F.col("__times") <= bound).drop("__times").withColumn("__s", F.lit(0))
        out = rows.join(F.broadcast(hot), same(rows, hot), "left").drop(*(f"__k{i}" for i in range(len(keys))))
        out = out.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int") + 1).otherwise(0))
        out, got = out.join(cold, [*same(out, cold), F.col("__salt") == F.col("__s")], "left"), F.coalesce("__hot", "__v")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(got.getField(c).alias(c) for c in others))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its dense place, from 0, in the order of ``order`` (which tells rows apart): dealt by range, numbered in parts.

    Only the sizes of the parts, as many as there are shuffle partitions at most, are summed up in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    out = out.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col("__in") - 1).cast("long").alias(name))
