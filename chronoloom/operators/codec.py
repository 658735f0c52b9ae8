"""What a delta-of-delta codec would find in the times of a series.

Parquet does the encoding; these counts tell how regular the times are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest magnitudes of the delta of deltas that take 1, 9, 12 and 16 bits; others take 36.
BUCKETS = ((0, 1), (63, 9), (255, 12), (2047, 16))
WIDEST = 36


def dod_buckets(points: DataFrame) -> DataFrame:
    """bits and n_points over the second and later deltas of each series and segment, by time."""
    by_time = Window.partitionBy("seg", "labels_key").orderBy("ts", "seq")
    deltas = points.withColumn("delta", F.col("ts") - F.lag("ts").over(by_time))
    second = deltas.withColumn("dod", F.abs(F.col("delta") - F.lag("delta").over(by_time))).where(F.col("dod").isNotNull())
    bits = F.lit(WIDEST)
    for most, n in reversed(BUCKETS):
        bits = F.when(F.col("dod") <= most, n).otherwise(bits)
    return second.groupBy(bits.alias("bits")).agg(F.count("*").alias("n_points"))
