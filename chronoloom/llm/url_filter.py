"""URL filters: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

A url's verdict is that of the longest rule that fits it. Where none fits, the vocabulary decides:
every strict and soft term is searched in the lower-cased url (percent escapes decoded) by one
automaton; a hit counts only between characters that are no ASCII letters or digits. One strict
hit rejects, and so do ``soft_limit`` distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Terms that reject by themselves: they name what hardly anything else is called.
STRICT = (
    "casino", "casinos", "sportsbook", "blackjack", "baccarat", "roulette",
    "cialis", "levitra", "tramadol", "viagra", "xanax",
    "malware", "phishing", "ransomware", "spam", "warez", "crackz", "serialz",
    "camgirl", "camgirls", "hentai", "porn", "porno", "pornos", "xxx",
)
#: Terms that innocent urls have too, of which it takes several; plurals beside singulars, as a hit is a whole word.
SOFT = (
    "bet", "bets", "betting", "bingo", "bonus", "bonuses", "gambling", "jackpot", "jackpots", "lottery", "odds", "poker", "slot", "slots", "win", "winner",
    "pharmacy", "pharmacies", "pill", "pills", "diet", "slimming", "weight-loss", "prescription",
    "ad", "ads", "adserver", "affiliate", "banner", "banners", "clicks", "popup", "track", "tracker", "tracking", "traffic",
    "adult", "adults", "dating", "escort", "escorts", "hookup", "nude", "nudes", "sex", "sexy", "webcam",
    "crack", "cracked", "free-download", "keygen", "keygens", "nulled", "serials", "torrent", "torrents",
    "bargain", "cheap", "cheapest", "discount", "discounts", "free", "replica", "replicas", "rolex",
    "cash", "credit", "loan", "loans", "payday", "farm", "farms",
)
SOFT_LIMIT = 2


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits (longer host first, then longer path, then
    the smaller name); null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path), [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, action = F.when(fits, r.name).otherwise(name), F.when(fits, r.action).otherwise(action)
    return name, action


def compile_terms(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for terms, weight in ((soft, 1), (strict, 2)):
        for term in terms:
            automaton.add_word(term.lower(), (term.lower(), weight))
    automaton.make_automaton()
    return automaton


def term_hits(url: str, automaton: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms with a boundary on both sides."""
    text = unquote(url).lower()
    strict: set[str] = set()
    soft: set[str] = set()

    def inner(at: int) -> bool:
        return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()

    for end, (term, weight) in automaton.iter(text):
        if not inner(end + 1) and not inner(end - len(term)):
            (strict if weight == 2 else soft).add(term)
    return strict, soft


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict and n_soft (distinct terms) for each page row.

    Null url: host and path empty, no rule, no terms: allow. Null page_id stays null. Repeated
    rows give repeated results; an empty table gives none; other columns are not read, whatever
    their names. Urls of any length are searched whole, in time in proportion to their length.
    No shuffle: each row is judged alone.
    """
    strict, soft = tuple(strict), tuple(soft)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_terms(strict, soft)
        for batch in batches:
            found = [term_hits(u, automaton) if u and len(automaton) else ((), ()) for u in batch.column("url").to_pylist()]
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule", "action")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(a) for a, _ in found], pa.int32()), pa.array([len(b) for _, b in found], pa.int32())],
                names=["page_id", "host", "path", "rule", "action", "n_strict", "n_soft"],
            )

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, action = matching_rule(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "url", "host", "path", name.alias("rule"), action.alias("action"))
    kind = judged.schema["page_id"].dataType.simpleString()
    counted = judged.mapInArrow(count, f"page_id {kind}, host string, path string, rule string, action string, n_strict int, n_soft int")
    rejected = (F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit)
    verdict = F.coalesce(F.col("action"), F.when(rejected, "block").otherwise("allow"))
    return counted.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_strict", "n_soft")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def _hits(terms: Sequence[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)" for t in terms)


OP6_SQL = f"""
WITH cut AS (
  SELECT page_id, lower(url_decode(coalesce(url, ''))) AS u,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(action, rhost, rpath) AS (
  VALUES {', '.join(f"('{r.action}', '{r.host}', '{r.path}')" for r in RULES)}
), fit AS (
  SELECT p.*, r.action, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost) DESC NULLS LAST, length(r.rpath) DESC) AS nth
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
), counted AS (
  SELECT *, CAST({_hits(STRICT)} AS INTEGER) AS n_strict, CAST({_hits(SOFT)} AS INTEGER) AS n_soft
  FROM fit WHERE nth = 1
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft
FROM counted
"""

QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": OP6_SQL}
