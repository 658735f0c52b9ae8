"""Quality rules: a text's own rules, and verdicts on whole hosts.

Rule failures are summed by host (a document's source). A host's failure rate is shrunk towards that
of all documents by a beta prior fitted to the hosts by moments, so that a host of few documents needs
more than bad luck to be judged. Documents of hosts whose shrunk rate is over a limit that follows from
the prior go, with those that fail the base rules themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, hinted, let, read

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Further rules, of which a failure counts against the host only: symbols and repeated lines per
#: hundred words and lines, mean length of words.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, MEAN_WORD = 10, 30, (2, 14)
#: A host is bad if its shrunk failure rate is over so many standard deviations of the prior above its
#: mean, and over so many times the mean; a limit under the least rate or over the most is put there.
DEVIATIONS, TIMES_MEAN, MIN_HOST_RATE, MAX_HOST_RATE = 2.0, 2.0, 0.3, 0.5
#: Bounds of the prior's strength in documents, and the strength where hosts don't show one.
STRENGTH, UNKNOWN_STRENGTH = (1.0, 10_000.0), 20.0

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window found twice or more.

    Window hashes tell the texts without repeats, most of them; the others' windows are sorted with
    their places, so that equal ones are neighbours, and the places' runs are added up.
    """
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    windows = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("at"))))

    def covered(sorted_windows: Column) -> Column:
        def beside(i: Column, x: Column) -> Column:
            return F.coalesce(F.get(sorted_windows, i)["w"] == x["w"], F.lit(False))

        twice = F.filter(sorted_windows, lambda x, i: beside(i - 1, x) | beside(i + 1, x))
        at = F.array_sort(F.transform(twice, lambda x: x["at"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    repeated = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).when(repeated, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def features(text: Column) -> Column:
    """A struct of FEATURES (long) and n_lines of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.regexp_extract_all(text, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: let(lines, lambda x: counted(w, x)))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def any_failed(f: Column) -> Column:
    symbols = 100 * f["n_symbols"] > MAX_SYMBOL_PERCENT * f["n_words"]
    lines = 100 * f["n_dup_lines"] > MAX_DUP_LINE_PERCENT * f["n_lines"]
    length = (f["word_chars"] < MEAN_WORD[0] * f["n_words"]) | (f["word_chars"] > MEAN_WORD[1] * f["n_words"])
    return base_failed(f) | symbols | lines | length


def host_rates(judged: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> tuple[DataFrame, float]:
    """host, host_docs, host_failed and host_rate (shrunk) by host, and the rate over which a host is bad.

    The prior tells what rates hosts have: its mean m is all documents' rate, its standard deviation
    the root of m (1 - m) / (strength + 1). Null is a host of its own. The sums are partial before they are shuffled; only the prior's six
    sums come to the driver.
    """
    hosts = cut(judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed")))
    n, k = F.col("host_docs"), F.col("host_failed")
    s = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("between"), F.sum(k * (n - k) / n).alias("within")).first()
    strength, mean = UNKNOWN_STRENGTH, 0.0
    if s["n"]:
        mean = s["k"] / s["n"]
    if s["hosts"] > 1 and s["n"] > s["hosts"]:
        among = (s["between"] - mean * s["k"]) / (s["hosts"] - 1)
        inside = s["within"] / (s["n"] - s["hosts"])
        size = (s["n"] - s["nn"] / s["n"]) / (s["hosts"] - 1)
        below = among + (size - 1) * inside
        likeness = (among - inside) / below if below > 0 else 0.0
        strength = STRENGTH[1] if likeness <= 0 else min(max(1 / likeness - 1, STRENGTH[0]), STRENGTH[1])
    rate = (k + F.lit(mean * strength)) / (n + F.lit(strength))
    spread = (mean * (1 - mean) / (strength + 1)) ** 0.5
    return hosts.withColumn("host_rate", rate), min(max_rate, max(MIN_HOST_RATE, TIMES_MEAN * mean, mean + DEVIATIONS * spread))


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """key, FEATURES, base_failed, kept, host_docs, host_failed and host_rate for each row.

    Null texts count as empty and fail for want of words; null hosts are one host; null keys stay;
    repeated rows are judged and counted each; an empty table gives none; other columns are not read.
    Long texts take time n log n. Texts are read once: what follows reads written counts.
    """
    f = F.col("f")
    slim = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), features(F.col(text)).alias("f"))
    counts = cut(slim.select("key", "host", *(f[c].alias(c) for c in FEATURES), base_failed(f).alias("base_failed"), any_failed(f).alias("failed")))
    hosts, limit = host_rates(counts, "host", "failed", max_rate)
    joined = counts.join(hinted(hosts.withColumnRenamed("host", "h"), hosts.count()), F.col("host").eqNullSafe(F.col("h")), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= limit)
    return joined.select(F.col("key").alias(key), *FEATURES, "base_failed", kept.alias("kept"), "host_docs", "host_failed", "host_rate")


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs, all columns, that judge_documents() keeps.

    Each text is judged once: rows are written with their two marks. Texts are shuffled only where the
    bad hosts are too many to broadcast.
    """
    failed, base, name = (free_name(docs, x) for x in ("any_failed", "base_failed", "bad_host"))
    found = free_name(docs, "found")
    marked = docs.withColumn(found, features(F.col(text))).withColumns({base: base_failed(F.col(found)), failed: any_failed(F.col(found))}).drop(found)
    marked = cut(marked)
    hosts, limit = host_rates(marked.select(F.col(host).alias("host"), F.col(failed).alias("failed")), "host", "failed", max_rate)
    bad = cut(hosts.where(F.col("host_rate") > limit).select(F.col("host").alias(name)))
    kept = marked.where(~F.col(base)).drop(base, failed)
    return kept.join(hinted(bad, bad.count()), F.col(host).eqNullSafe(F.col(name)), "left_anti")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(read(spark, sf_dir, "documents"))
    return judged.withColumn("host_rate", F.round("host_rate", 6))


#: Common table expressions that end in ``judged``: all columns of documents, the counts and verdicts.
JUDGED_SQL = f"""
rows_ AS (SELECT row_number() OVER () AS r, * FROM documents),
words_ AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM rows_ WHERE text IS NOT NULL)
), windows_ AS (
  SELECT r, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS w
  FROM words_ WINDOW o AS (PARTITION BY r ORDER BY pos)
), twice_ AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, w) AS n FROM windows_ WHERE w IS NOT NULL) WHERE n > 1
), covered_ AS (
  SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, pos + j AS pos FROM twice_, generate_series(0, {WINDOW - 1}) t(j)) GROUP BY r
), counted_ AS (
  SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM words_ GROUP BY r
), lines_ AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows_) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), features_ AS (
  SELECT d.*, coalesce(c.n_words, 0) AS n_words, coalesce(c.word_chars, 0) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(d.text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(v.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM rows_ d LEFT JOIN counted_ c USING (r) LEFT JOIN lines_ l USING (r) LEFT JOIN covered_ v USING (r)
), ruled_ AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM features_
), failed_ AS (
  SELECT *, base_failed OR 100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines
    OR word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words AS failed
  FROM ruled_
), hosts_ AS (
  SELECT source AS host, count(*) AS host_docs, CAST(sum(CAST(failed AS INTEGER)) AS BIGINT) AS host_failed FROM failed_ GROUP BY source
), sums_ AS (
  SELECT count(*) AS h, sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE AS k, sum(host_docs * host_docs)::DOUBLE AS nn,
         sum(host_failed * host_failed / host_docs::DOUBLE) AS b, sum(host_failed * (host_docs - host_failed) / host_docs::DOUBLE) AS w FROM hosts_
), spread_ AS (
  SELECT *, k / n AS mean, (b - k / n * k) / (h - 1) AS among, w / (n - h) AS inside, (n - nn / n) / (h - 1) AS size FROM sums_
), prior_ AS (
  SELECT mean, CASE WHEN h < 2 OR n <= h THEN {UNKNOWN_STRENGTH}
    WHEN among <= inside THEN {STRENGTH[1]}
    ELSE least(greatest((among + (size - 1) * inside) / (among - inside) - 1, {STRENGTH[0]}), {STRENGTH[1]}) END AS strength
  FROM spread_
), limit_ AS (
  SELECT *, least({MAX_HOST_RATE}, greatest({MIN_HOST_RATE}, {TIMES_MEAN} * mean, mean + {DEVIATIONS} * sqrt(mean * (1 - mean) / (strength + 1)))) AS most FROM prior_
), judged AS (
  SELECT f.*, h.host_docs, h.host_failed, (h.host_failed + mean * strength) / (h.host_docs + strength) AS host_rate,
         NOT base_failed AND (h.host_failed + mean * strength) / (h.host_docs + strength) <= most AS kept
  FROM failed_ f JOIN hosts_ h ON f.source IS NOT DISTINCT FROM h.host CROSS JOIN limit_
)"""

OP4_SQL = f"""WITH {JUDGED_SQL}
SELECT doc_id, {', '.join(FEATURES)}, base_failed, kept, host_docs, host_failed, round(host_rate, 6) AS host_rate FROM judged"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": OP4_SQL}
