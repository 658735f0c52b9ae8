"""The inverted index as a table: (seg, name, value) to series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.matchers import Matcher, value_predicate


def build_postings(series: DataFrame) -> DataFrame:
    """seg, name, value and labels_key for each label of each series."""
    return series.select("seg", F.explode("labels").alias("name", "value"), "labels_key")


def cardinality(postings: DataFrame) -> DataFrame:
    """name, value and n_series, the distinct series that bear the label."""
    return postings.select("name", "value", "labels_key").distinct().groupBy("name", "value").agg(F.count("*").alias("n_series"))


def label_values(postings: DataFrame) -> DataFrame:
    return postings.select("name", "value").distinct()


def match_postings(postings: DataFrame, matchers: Sequence[Matcher]) -> DataFrame:
    """labels_key of the series that are in every matcher's union of lists.

    Each posting notes the matchers it satisfies; a series is in if its postings note all. One pass
    over the postings, however many matchers there are.
    """
    if not matchers:
        return postings.select("labels_key").where(F.lit(False))
    hits = F.array_compact(F.array(*(F.when((F.col("name") == m.name) & value_predicate(F.col("value"), m), i) for i, m in enumerate(matchers))))
    found = postings.select("labels_key", F.explode(hits).alias("matcher")).distinct()
    return found.groupBy("labels_key").agg(F.count("*").alias("n")).where(F.col("n") == len(matchers)).select("labels_key")
