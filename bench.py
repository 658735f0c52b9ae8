"""Seconds of the headline queries, as one line of JSON.

Each query runs to its full result on data that an earlier run has warmed up; the best of three counts.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from chronoloom.plans.queries import MONTH, QUERIES  # noqa: E402
from chronoloom.plans.matchers import Matcher  # noqa: E402
from chronoloom.sources.events import event_rows  # noqa: E402
from chronoloom.sources.options import CODECS, Options  # noqa: E402
from chronoloom.sources.store import Store  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("range_eq", "range_regex", "range_multi", "range_empty_series", "series_regex", "series_multi_matcher", "label_values", "segment_manifest", "postings_match", "late_split", "archive_merge", "ingest_normalize")


def best(f, times=3):
    took = []
    for _ in range(times):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    return round(min(took), 4)


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def all_rows(df):
        df.write.format("noop").mode("overwrite").save()

    seconds = {name: best(lambda name=name: all_rows(QUERIES[name](spark, SF_DIR))) for name in HEADLINE}

    # A grid of series at the pace and with the labels of the published workload: rows written a second
    # and bytes a point for each codec, and a range of one series against a scan of all.
    series, steps = 16 * 5 * 128, 121
    ids = spark.range(series * steps)
    s, step = F.col("id") % series, F.floor(F.col("id") / series)
    names = [("node", F.concat(F.lit("vm"), s % 5)), ("dc", (F.floor(s / 5) % 128).cast("string")), ("foo", F.md5((s % 16).cast("string"))), ("bar", F.md5((s % 16 + 16).cast("string"))), ("zoo", F.md5((s % 16 + 32).cast("string")))]
    labels = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in names))
    grid = ids.select(F.concat(F.lit("metric."), F.floor(s / 640)).alias("metric"), labels.alias("labels"), (F.lit(1_600_000_000) + step * 60).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(60)).cast("double").alias("value"), F.col("id").alias("seq"))
    extra = {"points": series * steps}
    root = tempfile.mkdtemp(prefix="bench-store-")
    grid.repartition(4 * int(CPUS)).write.parquet(f"{root}/rows")
    grid = spark.read.parquet(f"{root}/rows")
    for codec in CODECS:
        store = Store(spark, f"{root}/{codec}", Options(codec=codec, segment_seconds=86_400))
        began = time.perf_counter()
        store.append(grid)
        seconds[f"ingest_{codec}"] = round(time.perf_counter() - began, 4)
        size = sum(p.stat().st_size for p in Path(root, codec).rglob("*.parquet"))
        extra[f"rows_per_s_{codec}"] = round(series * steps / seconds[f"ingest_{codec}"])
        extra[f"bytes_per_point_{codec}"] = round(size / (series * steps), 3)
    seconds["store_range"] = best(lambda: all_rows(store.query_range("metric.3", [Matcher("node", "vm1"), Matcher("dc", "7")], 1_600_000_000, 1_600_003_600)))
    extra["store_range_rows"] = store.query_range("metric.3", [Matcher("node", "vm1"), Matcher("dc", "7")], 1_600_000_000, 1_600_003_600).count()
    seconds["store_full_scan"] = best(lambda: all_rows(store.points()))
    print(json.dumps({"metric": "sum of the queries' best times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1], **extra, "range": MONTH}))
    spark.stop()


if __name__ == "__main__":
    main()
