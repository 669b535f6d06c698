"""Growing folders of shards with Structured Streaming: follow one, filter and derive, append to another."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.lower import lower
from ..functions.query import check_predicate, parse
from ..functions.types import numpy_type
from ..operators.table import open_table


def follow(directory: Any, *, spark: SparkSession | None = None, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame of the shards in a folder, those to come included; one shard must be there for its schema."""
    first = open_table(directory, spark=spark)
    reader = first.spark.readStream.schema(first._df.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(os.fspath(directory))


def filtered(stream: DataFrame, predicate: str, params: dict[str, Any] | None = None) -> DataFrame:
    """A stream's rows for which a query string holds, with the same semantics as on tables."""
    dtypes = {f.name: numpy_type(f) for f in stream.schema}
    return stream.where(lower(check_predicate(parse(predicate, list(dtypes), params), dtypes), dtypes))


def append_to(stream: DataFrame, directory: Any, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Write a stream's batches as shards of a folder, each named by its batch: a batch that is replayed replaces its own."""
    directory = os.fspath(directory)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(directory, f"batch_{number:08d}.parquet"))

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
