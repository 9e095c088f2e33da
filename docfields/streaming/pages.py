"""Incremental extraction: the same plans over a stream of page-word files.

Per-row expressions and joins with small lookups run on a stream as they are.  Operators that need a
whole page group by page; a page arrives whole in one file, so each micro-batch is complete
and the batch plan runs on it unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def extract_stream(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run a batch ``plan`` over all files that have arrived at ``source`` and append its rows to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        plan(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

