"""Secret scans: fixed patterns, and random strings told from identifiers by Markov models.

Patterns find assigned values, access keys and long hexadecimal runs. Other long tokens are scored by
two first-order character models, one of random strings and one of ordinary identifiers, both trained
from labelled samples; a token whose log-likelihood ratio is over a limit is a secret as well.

All is made of SQL functions. Spark has none for a match's place, so places come from the lengths of
the matches and of what lies between them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, read

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The second and third pattern take the least lengths in: a run that is too short has no part that
#: is long enough, so they match what the plain pattern matches and a length test keeps.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Nats by which a token must be likelier random than ordinary.
MIN_RATIO = 10.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Labelled samples of each label that the models are trained from.
SAMPLES = 6_000
MASK = "[SECRET]"

_CHUNK = 256
_SPAN = "array<struct<start:int,kind:int,stop:int>>"

#: Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "account action address array attribute author available background batch begin border branch buffer build button cache calendar "
    "category change channel character check child class client cluster collection column command comment config connection console "
    "constant container content context control convert country create current customer database default delete delivery description "
    "device dictionary directory document domain download duration element email enable encoding engine entry environment error event "
    "exception export external factory feature field filter first folder format function general global graph group handler header "
    "height history identifier image import index information input instance integer interface internal invoice iterator language "
    "layout length level library limit listener location manager margin matrix maximum memory message method minimum model module "
    "month name network node number object operation option order output package page parameter parent parser partition password path "
    "pattern payment percent performance permission person picture pipeline platform pointer position previous primary priority process "
    "product profile program project property protocol provider quantity query queue random range record reference region register "
    "relation release remote remove report request resource response result return route sample schedule schema scope screen script "
    "search second section select sequence server service session setting shape shipping signal simple single source special standard "
    "start state station status stream string structure student style subject summary support switch symbol system table target task "
    "template temporary text thread time title token total transaction transfer transform translation type update upload user utility "
    "validate value variable vector version video view volume warehouse warning weight width window worker writer zone"
).split()


def _prefix_sums(values: Column) -> Column:
    """Sums up to and with each element; long arrays in chunks, so that time stays near linear."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def short(v: Column) -> Column:
        return F.transform(v, lambda x, i: total(F.slice(v, F.lit(1), i + 1)))

    def long(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda c: F.slice(v, c * _CHUNK + 1, _CHUNK))
        before = F.transform(chunks, total)
        return let(before, lambda b: F.flatten(F.transform(chunks, lambda chunk, c: let(total(F.slice(b, F.lit(1), c)), lambda base: F.transform(chunk, lambda x, i: base + total(F.slice(chunk, F.lit(1), i + 1)))))))

    return F.when(F.size(values) <= _CHUNK, short(values)).otherwise(long(values))


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """The pattern's leftmost non-overlapping matches as (start, kind, stop), from 0, stop exclusive.

    keep(matches, i) tells which of the matches stay.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column, pieces: Column) -> Column:
        gaps = F.transform(m, lambda x, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0))
        found = let(_prefix_sums(gaps), lambda s: F.transform(m, lambda x, i: F.struct(F.get(s, i).alias("start"), F.lit(kind).alias("kind"), (F.get(s, i) + F.length(x)).alias("stop"))))
        return found if keep is None else F.filter(found, lambda _, i: F.coalesce(keep(m, i), F.lit(False)))

    return F.when(text.rlike(pattern), let(matches, lambda m: let(F.split(text, pattern, -1), lambda p: placed(m, p)))).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns in the order of start and kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = let(F.when(text.rlike(ASSIGN), values).otherwise(F.array().cast("array<string>")), lambda v: _spans(text, ASSIGN, 0, lambda _, i: F.length(F.get(v, i)) >= MIN_ASSIGNED))
    return F.array_sort(F.concat(assigned, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


# The models


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """token and label (1 random, 0 ordinary): n rows of each, the same on every call.

    Random strings are digests in base 64, hexadecimal, upper and lower case letters with digits;
    ordinary ones are two to five words joined in the usual styles, some with a number.
    """
    ids = spark.range(n)
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(F.concat(b64, F.base64(F.unhex(F.sha2(digest, 256)))), "[^A-Za-z0-9]", "")
    forms = [b64, F.substring(digest, 1, 40), F.substring(F.upper(plain), 1, 32), F.substring(F.lower(plain), 1, 32), F.substring(plain, 1, 40)]
    case = F.col("id") % len(forms)
    random = F.lit("")
    for i, form in enumerate(forms):
        random = F.when(case == i, form).otherwise(random)
    words = F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")
    parts = F.transform(F.sequence(F.lit(1), (F.pmod(F.xxhash64("id"), F.lit(4)) + 2).cast("int")), lambda j: F.element_at(words, (F.pmod(F.xxhash64("id", j), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int")))
    number = F.when(F.pmod(F.xxhash64("id", F.lit("n")), F.lit(4)) == 0, F.pmod(F.xxhash64("id", F.lit("m")), F.lit(2000)).cast("string")).otherwise("")
    styles = [F.array_join(parts, "_"), F.array_join(parts, "-"), F.array_join(parts, "/"), F.array_join(parts, ""), F.upper(F.array_join(parts, "_")), F.array_join(F.transform(parts, F.initcap), "")]
    style = F.pmod(F.xxhash64("id", F.lit("s")), F.lit(len(styles)))
    ordinary = F.lit("")
    for i, form in enumerate(styles):
        ordinary = F.when(style == i, form).otherwise(ordinary)
    return ids.select(random.alias("token"), F.lit(1).alias("label")).unionByName(ids.select(F.concat(ordinary, number).alias("token"), F.lit(0).alias("label")))


def _codes(token: Column) -> Column:
    """Each character's place in the alphabet, 0 for others, after a 0 for the start."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0)), F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c)))


def _steps(token: Column) -> Column:
    size = len(ALPHABET) + 1
    return let(_codes(token), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), lambda i: F.coalesce(F.get(c, i) * size + F.get(c, i + 1), F.lit(0))))


def train(samples: DataFrame) -> list[int]:
    """For each pair of characters the log-likelihood ratio of its step, in thousandths.

    samples: token, label. Counts are of all the samples' steps, with one added to each; only the
    table, bounded by the alphabet, comes to the driver.
    """
    size = len(ALPHABET) + 1
    steps = samples.where(F.length("token") > 0).select("label", F.explode(_steps(F.col("token"))).alias("step")).groupBy("label", "step").count().collect()
    counts = [[1.0] * (size * size) for _ in range(2)]
    for row in steps:
        counts[row["label"]][row["step"]] += row["count"]
    rows = [[sum(c[a * size : a * size + size]) for a in range(size)] for c in counts]
    ratio = [math.log(counts[1][s] / rows[1][s // size]) - math.log(counts[0][s] / rows[0][s // size]) for s in range(size * size)]
    return [round(1000 * r) for r in ratio]


def log_ratio(token: Column, table: list[int]) -> Column:
    """How much likelier, in nats, the token is random than ordinary."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return F.aggregate(_steps(token), F.lit(0).cast("long"), lambda a, s: a + F.get(values, s)) / 1000.0


def _outside(token: Column, base: Column) -> Column:
    """The parts of a token's span that lie outside the base spans, which are in order."""
    over = F.filter(base, lambda b: (b["start"] < token["stop"]) & (token["start"] < b["stop"]))

    def part(over: Column, i: Column) -> Column:
        start = F.when(i == 0, token["start"]).otherwise(F.array_max(F.transform(F.slice(over, F.lit(1), i), lambda b: b["stop"])))
        stop = F.when(i == F.size(over), token["stop"]).otherwise(F.get(over, i)["start"])
        return F.struct(start.alias("start"), F.lit(3).alias("kind"), stop.alias("stop"))

    parts = let(over, lambda o: F.transform(F.sequence(F.lit(0), F.size(o)), lambda i: part(o, i)))
    return F.filter(parts, lambda s: s["start"] < s["stop"])


def secret_spans(text: Column, table: list[int], min_ratio: float = MIN_RATIO) -> Column:
    """Base spans and, as kind 'random', those of other tokens by the models, none over a base span.

    Of a token that touches base spans, each part outside them counts that is random by itself, or that
    is likelier random than not, however short, in a token that is random as a whole.
    """

    def ratio(s: Column) -> Column:
        return log_ratio(F.substring(text, s["start"] + 1, s["stop"] - s["start"]), table)

    def parts(base: Column) -> Column:
        touching = F.filter(_spans(text, TOKEN, 3), lambda s: F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
        judged = F.transform(touching, lambda t: F.filter(_outside(t, base), lambda s: (ratio(s) >= min_ratio) | ((ratio(s) > 0) & (ratio(t) >= min_ratio))))
        return F.when(F.size(base) > 0, F.flatten(judged)).otherwise(F.array().cast(_SPAN))

    def all_spans(base: Column) -> Column:
        scored = _spans(text, TOKEN, 3, lambda m, i: log_ratio(F.get(m, i), table) >= min_ratio)
        own = F.filter(scored, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
        return F.array_sort(F.concat(base, own, parts(base)))

    return let(base_spans(text), all_spans)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", samples: DataFrame | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """key and spans, an array of (start, kind number, stop) in code points, of each row.

    Null and empty texts have no spans; null keys stay, repeated rows are each scanned, an empty
    table gives none; other columns are not read. Texts are scanned whole; equal ones get equal
    spans. samples (token, label) take the place of the built-in ones. No shuffle but the training's.
    """
    table = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    return docs.select(F.col(key).alias(key), secret_spans(F.coalesce(F.col(text), F.lit("")), table, min_ratio).alias("spans"))


def mask_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = MASK, samples: DataFrame | None = None) -> DataFrame:
    """docs with each run of overlapping spans in the text replaced by the mask, and, where there is
    such a column and the text changed, its new length. Null texts stay null."""
    table = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    spans = free_name(docs, "spans")
    marked = docs.withColumn(spans, secret_spans(F.coalesce(F.col(text), F.lit("")), table))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, s: Column) -> Column:
        kept = F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"])
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], kept, F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out"))

    rest = F.length(text)
    masked = F.aggregate(F.col(spans), empty, add, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, rest)))
    changed = F.size(spans) > 0
    columns = {text: F.when(changed, masked).otherwise(F.col(text))}
    out = marked.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns), F.col(spans))
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(changed, F.length(text).cast(kind)).otherwise(F.col(length)))
    return out.drop(spans)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    spans = F.col("spans")

    def counted(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [counted(k) for k in range(4)]
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts[:3], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), counts[3])


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
