"""The events table as rows: metric event_type, labels user_id and k, seq event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import clock, epoch_seconds


def event_rows(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None, sparse: bool = False) -> DataFrame:
    """Rows of events, those of [start, end] if given: the bounds reach the Parquet reader.

    sparse: beside user_id, a label k from props, of which small values are empty and so no label, and
    a second, to be dropped, of the same name.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if start is not None:
        events = events.where(F.col("ts") >= clock(start))
    if end is not None:
        events = events.where(F.col("ts") < clock(end + 1))
    return as_rows(events, sparse)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of events as a stream of the files of the table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_rows(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))


def as_rows(events: DataFrame, sparse: bool = False) -> DataFrame:
    labels = [F.struct(F.lit("user_id").alias("name"), F.col("user_id").cast("string").alias("value"))]
    if sparse:
        k = F.get_json_object("props", "$.k").cast("int")
        labels += [F.struct(F.lit("k").alias("name"), F.when(k >= 50, k.cast("string")).otherwise("").alias("value")), F.struct(F.lit("k").alias("name"), F.lit("x").alias("value"))]
    return events.select(F.col("event_type").alias("metric"), F.array(*labels).alias("labels"), epoch_seconds(F.col("ts")).alias("ts"), "value", F.col("event_id").alias("seq"))
