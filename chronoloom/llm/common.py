"""What several operators share: tables that cut lineage, free column names, ranged runs and small joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of characters other than these six, as in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few short columns up to which a table, counted first, may be broadcast: some 5 MB.
BROADCAST_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared folder of ``spark.checkpoint.dir`` and read from there.

    The setting is the session's. Only where it has none, as in tests on one machine, a temporary
    folder is taken. A table is written, not a checkpoint: that would keep the partitionings and
    constraints of the plan that made it, which multiply in a loop until planning takes longer than the
    work. Tables stay until discard() or the folder's owner removes them.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that cut() made and nothing reads any more."""
    for table in tables:
        if path := getattr(table, "cut_path", None):
            context = table.sparkSession.sparkContext
            root = context._jvm.org.apache.hadoop.fs.Path(path)
            root.getFileSystem(context._jsc.hadoopConfiguration()).delete(root, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front, such that df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of df begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound, else as it is: a shuffled
    join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def ranged(df: DataFrame, order: Sequence[Column], part: str = "part") -> DataFrame:
    """df dealt in the order given to about equal ranges, with the range's number in ``part``.

    A hot key spreads over many ranges as long as a later column of the order tells its rows
    apart. The result is written: a range's number must not change when rows are read again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """df with the sum of ``value`` over the earlier rows of its group, in the order given.

    No task holds a group: rows are dealt in ranges of (group, order); sums run within a range, and
    each range starts at the total of the group's earlier ranges, of which a group has at most one
    a range.
    """
    part, total, base = (free_name(df, x) for x in ("part", "total", "base"))
    rows = ranged(df, [*(F.col(c) for c in group), *order], part)
    totals = rows.groupBy(part, *group).agg(F.sum(value).alias(total))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col(part).alias(f"{part}_b"), *(F.col(c).alias(f"{c}_b") for c in group), F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(base))
    within = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col(part) == F.col(f"{part}_b")) & F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_b"))
    summed = rows.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = summed.join(bases, same, "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col(base), F.lit(0))).select(*df.columns, out)
