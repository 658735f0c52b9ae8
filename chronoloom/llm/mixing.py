"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a piecewise linear function of training time. Its integral over the whole of
training, with what the others leave, gives the source's share of the words; its integral up to a time
gives the words that the mix has taken from the source by then. Documents of a source are lined up in
a fixed pseudo-random order, as often as the share needs, so each copy begins at some word of the
source's demand; the time at which the integral reaches that word is the copy's training position.
Sorting all copies by position, in ranges, makes the mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, free_prefix, hinted, read, running_sum

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: How each weight runs over training time: (time, factor) knots; each has a mean factor of 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Words of the mix for each word there is, in halves: 150 %.
BUDGET_HALVES = 3
#: Most times that a document is taken.
MAX_TIMES = 2

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which the schedule's integral reaches this share of its whole."""
    need, done = share * F.lit(integral(schedule)), 0.0
    out, cases = F.lit(float(schedule[-1][0])), []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        part, slope = need - F.lit(done), (w1 - w0) / (t1 - t0)
        below = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * part, F.lit(0.0)))
        done += (t1 - t0) * (w0 + w1) / 2
        cases.append((need <= F.lit(done), F.lit(float(t0)) + F.when(below > 0, F.lit(2.0) * part / below).otherwise(F.lit(0.0))))
    for case, time in reversed(cases):
        out = F.when(case, time).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], schedules: Sequence[Schedule], budget_halves: int, max_times: int) -> tuple[DataFrame, int]:
    """source, source_size, nth (place in code point order, from 0), weight and target, and the number
    of sources. sizes: source, words.

    A weight counts times its schedule's integral. Targets over max_times the source's size stop
    there, and what is over is shared anew by weight. Each round brings two sums to the driver, and
    at least one more source to its limit.
    """
    sources = cut(sizes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")))
    n = sources.count()
    nth = _nth(sources)
    turns = [float(w * integral(s)) for w, s in zip(weights, schedules, strict=True)]
    weight = F.element_at(F.array(*map(F.lit, turns)), (F.col("nth") % len(turns) + 1).cast("int"))
    sources = cut(nth.select("source", "source_size", "nth", weight.alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, rate, known = F.col("source_size") * max_times, 0.0, None
    while True:
        at_limit = F.col("weight") * F.lit(rate) >= full
        s = sources.agg(F.sum(F.when(at_limit & F.lit(known is not None), full)).alias("full"), F.sum(F.when(~at_limit | F.lit(known is None), F.col("weight"))).alias("weight")).first()
        now = (s["full"] or 0, s["weight"] or 0.0)
        if now == known or not now[1]:
            break
        known, rate = now, (total * budget_halves / 2 - now[0]) / now[1]
    target = F.when(F.col("weight") * F.lit(rate) >= full, full.cast("double")).otherwise(F.col("weight") * F.lit(rate))
    return sources.withColumn("target", target), n


def mix_plan(docs: DataFrame, keys: Sequence[str], size: str, source: str, weights=WEIGHTS, schedules=SCHEDULES, budget_halves=BUDGET_HALVES, max_times=MAX_TIMES) -> DataFrame:
    """For each row of docs: the keys, size, source_size, target, nth, ``times`` (array of the words
    that each pass takes) and ``positions`` (array of the passes' training times, null if not taken).

    keys tell rows apart, beside source and size; rows equal in all of them are counted first and
    share one place in their source's order, so that no number of repeats makes a hot group, and get
    consecutive places there. Lined up are rows by the MD5 of the first key's text, then the keys. A
    pass takes rows until the source's target, rounded to words, is reached; of the last row only the
    words up to it.
    """
    items = cut(docs.groupBy(F.col(source).alias("source"), F.col(size).alias("size"), *(F.col(k).alias(f"key_{k}") for k in keys)).agg(F.count("*").alias("repeats")))
    items = items.withColumn("words", F.col("size") * F.col("repeats"))
    sources, n = source_targets(items.select("source", "words"), weights, schedules, budget_halves, max_times)
    order = [F.md5(F.col(f"key_{keys[0]}").cast("string")), *(F.col(f"key_{k}") for k in keys), F.col("size")]
    lined = running_sum(items, ["source"], order, "words", "start")
    lined = lined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    joined = lined.join(hinted(sources.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")))
    due = F.floor(F.col("target") + 0.5)
    begins = [F.col("start") + F.col("source_size") * p for p in range(max_times)]
    takes = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), due - b)) for b in begins]

    positions = [F.when(t > 0, _scheduled(b / due, schedules)) for b, t in zip(begins, takes, strict=True)]
    return joined.select(*(F.col(f"key_{k}").alias(k) for k in keys), F.col("source").alias(source), F.col("size").alias(size), "source_size", "target", "nth", "repeats", "copy", F.array(*takes).alias("times"), F.array(*positions).alias("positions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """key, size, source_size, target, taken and positions of each row, sorted by first position.

    Null and empty texts have size 0 and are not taken; null sources are one source, the last in
    order; null keys and repeated rows count as rows of their own; an empty table gives none; other
    columns are not read. Documents of equal position keep the order of their keys.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.col(text)).alias("print"))
    plan = mix_plan(slim, ["key", "print"], "size", "source", **options)
    taken = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    out = plan.select(F.col("key").alias(key), "size", "source_size", "target", taken.alias("taken"), F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.lit(1)).alias("second_position"))
    return out.orderBy(F.col("position").asc_nulls_last(), key)


def _marked(docs: DataFrame, text: str, source: str, key: str) -> tuple[DataFrame, str]:
    """docs with size, print and rest under a free prefix, which with key and source tell rows apart,
    and the prefix."""
    free, others = free_prefix(docs), [c for c in docs.columns if c not in (text, source, key)]
    rest = F.md5(F.to_json(F.struct(*others))) if others else F.lit("")
    return docs.withColumn(f"{free}size", word_count(F.col(text))).withColumn(f"{free}print", F.md5(F.col(text))).withColumn(f"{free}rest", rest), free


def _nth(sources: DataFrame) -> DataFrame:
    """sources with nth, their place in code point order, null last."""
    return running_sum(sources.withColumn("one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], "one", "nth").drop("one")


def _scheduled(share: Column, schedules: Sequence[Schedule]) -> Column:
    """The training time of a share of a source's words, by the source's nth."""
    time = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        time = F.when(F.col("nth") % len(schedules) == i, time_of(share, schedule)).otherwise(time)
    return F.round(time, 9)


def mix_order(mixed: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", schedules=SCHEDULES) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The order of a mix whose rows have lost it, as files have none: its different rows, once each,
    with a digest added that tells them apart; (digest, copy, position) for each row of the mix; (digest,
    times) for each different row; and the digest's name.

    Rows of a source are lined up as mix_plan() does, first copies first, and the schedule's integral
    is inverted at the words before each. That is the mix's own order within each source, and its
    training times up to the words that were rounded to whole texts. Null keys, texts and sources count
    as values; rows without words stand where their keys put them; an empty mix gives none.

    The digest is one column, never null, so that a join by it takes the different rows as they were dealt
    when made distinct, without moving their texts again.
    """
    marked, free = _marked(mixed, text, source, key)
    named = {f"{free}k{i}": F.col(c) for i, c in enumerate((key, f"{free}print", f"{free}rest", source))}
    keys, row = list(named), f"{free}row"
    marked = marked.withColumns(named).withColumn(row, F.md5(F.to_json(F.struct(*keys))))
    items = cut(marked.groupBy(row, *keys, F.col(f"{free}size").alias("size")).agg(F.count("*").alias("times")))
    totals = items.groupBy(F.col(keys[3]).alias("source")).agg(F.sum(F.col("size") * F.col("times")).alias("due"))
    sources = cut(_nth(cut(totals)))
    slots = items.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    order = [F.col("copy"), F.md5(F.col(keys[0]).cast("string")), *(F.col(k) for k in keys[:3]), F.col("size")]
    lined = running_sum(slots, [keys[3]], order, "size", "start").join(hinted(sources, sources.count()), F.col(keys[3]).eqNullSafe(F.col("source")))
    share = F.when(F.col("due") > 0, F.col("start") / F.col("due")).otherwise(F.lit(0.0))
    places = lined.select(row, "copy", _scheduled(share, schedules).alias("position"))
    return marked.dropDuplicates([row]), places, items.select(row, "times"), row


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: whole rows of docs, each as often as it is taken, sorted by position.

    A pass that takes less than half of a row's words leaves the row out, else takes all of it, so no
    text is cut. Rows without words are not taken.
    """
    marked, free = _marked(docs, text, source, key)
    size, print_, rest, at, repeats = (free + x for x in ("size", "print", "rest", "at", "repeats"))
    keys = [key, print_, rest]
    plan = mix_plan(marked.select(*keys, source, size), keys, size, source, **options)
    whole = F.filter(F.arrays_zip("times", "positions"), lambda x: 2 * x["times"] > F.col(size))
    known = {k: f"{free}k{i}" for i, k in enumerate([*keys, source])}
    copies = cut(plan.select(*(F.col(k).alias(name) for k, name in known.items()), F.col("repeats").alias(repeats), F.explode(F.transform(whole, lambda x: x["positions"])).alias(at)))
    same = F.lit(True)
    for k, name in known.items():
        same &= F.col(k).eqNullSafe(F.col(name))
    single = marked.join(copies.where(F.col(repeats) == 1), same)
    repeated = copies.where(F.col(repeats) > 1)
    some = marked.join(repeated.select(*known.values()).distinct(), same, "left_semi").dropDuplicates(list(known)).join(repeated, same)
    return single.unionByName(some).orderBy(at, key).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def _sql_time(share: str, schedule: Schedule) -> str:
    (_, w0), (_, w1) = schedule
    return f"2.0::DOUBLE * {share} / ({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {2 * (w1 - w0)}::DOUBLE * ({share}), 0.0::DOUBLE)))"


def _sql_position(pass_: int) -> str:
    share = f"((start + {pass_} * source_size)::DOUBLE / due::DOUBLE)"
    times = " ".join(f"WHEN {i} THEN {_sql_time(share, s)}" for i, s in enumerate(SCHEDULES))
    return f"CASE WHEN take{pass_} > 0 THEN round(CASE nth % {len(SCHEDULES)} {times} END, 9) END"


OP1_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS print, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source
), weighted AS (
  SELECT *, list_extract([{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}], CAST(nth % {len(WEIGHTS)} + 1 AS BIGINT)) AS weight FROM totals
), ordered AS (
  SELECT *, {MAX_TIMES} * source_size AS full_,
         coalesce(sum({MAX_TIMES} * source_size) OVER (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY source_size / weight DESC, nth DESC) AS rest, sum(source_size) OVER () AS total
  FROM weighted
), rates AS (
  SELECT *, (total::DOUBLE * {BUDGET_HALVES} / 2 - before::DOUBLE) / rest AS rate FROM ordered
), chosen AS (
  SELECT arg_min(rate, source_size / weight) AS rate FROM rates WHERE weight * rate < full_
), targets AS (
  SELECT w.*, CASE WHEN w.weight * coalesce(c.rate, 0) >= {MAX_TIMES} * source_size THEN ({MAX_TIMES} * source_size)::DOUBLE ELSE w.weight * coalesce(c.rate, 0) END AS target
  FROM weighted w CROSS JOIN chosen c
), lined AS (
  SELECT d.*, t.source_size, t.nth, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS due,
         coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)) NULLS FIRST, doc_id NULLS FIRST, print NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), takes AS (
  SELECT *, greatest(0, least(size, due - start)) AS take0, greatest(0, least(size, due - start - source_size)) AS take1 FROM lined
)
SELECT doc_id, size, source_size, target, CAST(take0 + take1 AS BIGINT) AS taken, {_sql_position(0)} AS position, {_sql_position(1)} AS second_position FROM takes
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": OP1_SQL}
