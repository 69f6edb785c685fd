"""Structured Streaming over records that arrive late and repeatedly.

The batch pipeline has no stream; these operators keep its results up to date
as files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sieveworks.functions.normal import word


def record_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_counts(records: DataFrame, late: str = "7 days") -> DataFrame:
    """day, model, records, unsafe: windows of a day by ``timestamp``; rows later than ``late`` are left out, as a watermark demands."""
    w = records.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day"), word("model").alias("model"))
    return w.agg(F.count("*").alias("records"), F.count_if(F.col("unsafe")).alias("unsafe")).select(F.to_date("window.start").alias("day"), "model", "records", "unsafe")


def first_deliveries(records: DataFrame, late: str = "7 days") -> DataFrame:
    """Repeated deliveries of an item with one timestamp dropped, with state for ``late`` only."""
    return records.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["item_id", "timestamp"])


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet until all files that are there have been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
