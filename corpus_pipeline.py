"""A corpus pipeline of five stages over ``documents``.

Quality rules drop what they reject; of each class of near duplicates one document stays; secrets are
masked; sources are mixed to their target weights, which repeats or leaves out documents; what is left
is encoded. Each stage takes (spark, docs, sf_dir), works on all of docs, and returns the columns of
documents, the last the codes and their places in training. Texts are whole throughout.

Null texts, keys and sources, repeated rows, other columns and empty tables are treated as the stages'
operators say: null texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, mixing, near_dup, quality_rules, secrets
from chronoloom.llm.common import cut, hinted, read

#: Copies of a row up to which one task writes all of them.
OFTEN = 64


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that pass the base rules and are not of a bad host. Null texts fail."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of alike texts the row of the smallest doc_id; rows of null text all stay."""
    return near_dup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets masked. Null texts stay null."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's share takes them, whole. Rows without words are left out."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, copy (from 0) and position (training time, 0 to 1) of each row of the mix.

    Files keep no order, so the position says where in training a row stands. Rows that the mix
    repeats are encoded once. Null texts have no ids.

    Each text moves once: rows meet their places where they were made distinct, before they are
    encoded, and a row's copies follow each other there. Rows repeated more than OFTEN times, whose copies
    one task would have to write, meet them after, by a join that adaptive execution splits.
    """
    rows, places, times, row = mixing.mix_order(docs)
    rows = rows.select("doc_id", "text", row)
    often = times.where(F.col("times") > OFTEN).select(row)
    n = often.count()
    few = places.join(hinted(often, n), row, "left_anti") if n else places
    placed = rows.join(few, row).select("text", F.struct("doc_id", "copy", "position").alias(row))
    out = bpe.encode_documents(placed, bpe.production_path(), key=row, decoded=False).select(f"{row}.doc_id", "ids", f"{row}.copy", f"{row}.position")
    if not n:
        return out
    some = rows.join(hinted(often, n), row, "left_semi").select("text", F.struct("doc_id", row).alias("doc_id"))
    encoded = bpe.encode_documents(some, bpe.production_path(), decoded=False).select("doc_id.*", "ids")
    return out.unionByName(encoded.join(places.join(hinted(often, n), row, "left_semi"), row).select(*out.columns))


STAGES = [
    ("quality_rules", filter_quality),
    ("near_dup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix),
    ("bpe", encode),
]

#: The near-duplicate and encoding stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
