"""Personal data: detection in the text and behind disguises, with places in the source text.

Disguised text is normalised by transducers that note, for each character they write, the source
characters it stands for: homoglyphs and wide forms to ASCII letters, any script's digits to 0-9,
invisible characters to nothing; spelled digits to digits, alone and among plain ones; bracketed or
spelled dots between digits to dots; bracketed or spelled "at" and "dot" in what looks like an address
to their signs. The same detectors then run on the normalised text, and what
they find is mapped back.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where its run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """(kind, start, stop) of the leftmost non-overlapping matches of each kind."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                end = m.end()
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# Transducers: (text, first, last) to the same, where first and last hold, for each character, the
# source characters it stands for.

#: Letters that look like ASCII ones, by what they look like.
HOMOGLYPHS = {
    look: ascii_
    for ascii_, looks in {
        "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏ", "m": "м", "n": "ո",
        "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ",
        "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
        "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "УΥ", "Z": "Ζ", "-": "‐‑‒–", ".": "․。", "@": "﹫",
    }.items()
    for look in looks
}
INVISIBLE = frozenset("­​‌‍⁠﻿")
NUMBER_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NUMBER = "|".join(NUMBER_WORDS)
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
#: Plain and spelled digits and what may stand between them. A run counts from seven digits on, the
#: fewest of a phone number, or with the three dots of an ip; which numbers count, the detectors tell.
_RUN = re.compile(
    rf"(?i)(?<![A-Za-z0-9])(?P<plus>plus[\x20,-]+)?(?:(?:{_NUMBER})(?![A-Za-z])|[0-9]++(?![A-Za-z]))"
    rf"(?:(?:[\x20,-]{{1,3}}|\x20?[()]\x20?|\.|{_DOT})(?:(?:{_NUMBER})(?![A-Za-z])|[0-9]++(?![A-Za-z])))+"
)
_PART = re.compile("[A-Za-z]+|[0-9]+")
_RUN_TRIGGER = re.compile(rf"(?i)(?<![A-Za-z])(?:{_NUMBER}|dot|plus)(?![A-Za-z])|[\[({{<]\s*\.")
MIN_DIGITS, IP_DOTS = 7, 3
_PLAIN = r"[A-Za-z0-9_%+-]+"
#: An address of which a dot is disguised, or the at and no dot. It begins where its word does, which
#: keeps long words linear.
_ADDRESS = re.compile(rf"(?i)(?<![A-Za-z0-9_%+-]){_PLAIN}(?:(?:\.|{_DOT}){_PLAIN}){{0,4}}(?P<at>{_AT})[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+){{1,5}}")
_DOTS, _ATS = re.compile(f"(?i){_DOT}"), re.compile(f"(?i){_AT}")
_AT_TRIGGER = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|\sdot\s")
_BRACKET_AT = re.compile(r"[\[({<]")


class Mapped:
    """A text whose characters know their source characters."""

    def __init__(self, text: str, first: list[int] | None = None, stop: list[int] | None = None):
        self.text, self.first, self.stop = text, first, stop

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """With text[start:stop] replaced, edits in order and apart. What replaces one character for
        each keeps its places; else each new character stands for all that it replaces."""
        if not edits:
            return self
        n = len(self.text)
        first = self.first if self.first is not None else list(range(n))
        stop = self.stop if self.stop is not None else list(range(1, n + 1))
        parts, firsts, stops, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            firsts += first[at:a]
            stops += stop[at:a]
            if len(new) == b - a:
                firsts += first[a:b]
                stops += stop[a:b]
            elif new:
                firsts += [first[a]] * len(new)
                stops += [stop[b - 1]] * len(new)
            at = b
        return Mapped("".join([*parts, self.text[at:]]), firsts + first[at:], stops + stop[at:])

    def source(self, start: int, stop: int) -> tuple[int, int]:
        return (start, stop) if self.first is None else (self.first[start], self.stop[stop - 1])


def plain_character(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


def plain_characters(m: Mapped) -> Mapped:
    changes = {c: p for c in set(m.text) if not c.isascii() and (p := plain_character(c)) != c}
    if not changes:
        return m
    return m.rewritten([(i, i + 1, changes[c]) for i, c in enumerate(m.text) if c in changes])


def spelled_digits(m: Mapped) -> Mapped:
    """Runs of spelled and plain digits: each word to its digit, words in a row to one number, disguised
    dots to dots; 'plus' before one to its sign. What else stands next to a word is a blank."""
    edits = []
    for run in _RUN.finditer(m.text):
        start = run.end("plus") if run["plus"] else run.start()
        parts = [(*p.span(), p[0].lower()) for p in _PART.finditer(m.text, start, run.end()) if p[0].lower() != "dot"]
        between = [(a, b, m.text[a:b]) for (_, a, _), (b, _, _) in zip(parts, parts[1:], strict=False)]
        dots = sum("." in gap or "dot" in gap.lower() for _, _, gap in between)
        if dots < IP_DOTS and sum(1 if p in NUMBER_WORDS else len(p) for _, _, p in parts) < MIN_DIGITS:
            continue
        if run["plus"]:
            edits.append((*run.span("plus"), "+"))
        for i, (a, b, part) in enumerate(parts):
            if part in NUMBER_WORDS:
                edits.append((a, b, NUMBER_WORDS[part]))
            if i == len(between):
                break
            a, b, gap = between[i]
            words = (part in NUMBER_WORDS) + (parts[i + 1][2] in NUMBER_WORDS)
            if "." in gap or "dot" in gap.lower():
                new = "."
            elif words == 2:
                new = ""
            elif words and gap not in (" ", "-"):
                new = " "
            else:
                new = gap
            if new != gap:
                edits.append((a, b, new))
    return m.rewritten(edits)


def signs(m: Mapped) -> Mapped:
    """'at' and 'dot' in disguised addresses to their signs.

    A bare 'at' counts only if a dot is disguised too, or else prose with a host name would do.
    """
    edits = []
    for a in _ADDRESS.finditer(m.text):
        dots = [d.span() for d in _DOTS.finditer(m.text, a.start(), a.end())]
        at = a["at"]
        if not dots and not _BRACKET_AT.search(at):
            continue
        edits += sorted([(*a.span("at"), "@"), *((*d, ".") for d in dots)])
    return m.rewritten(edits)


def disguised(text: str) -> Mapped:
    m = Mapped(text)
    if not text.isascii():
        m = plain_characters(m)
    if _RUN_TRIGGER.search(m.text):
        m = spelled_digits(m)
    if _AT_TRIGGER.search(m.text):
        m = signs(m)
    return m


def personal_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those found behind disguises only. One of these may hold base spans, of which
    it shows the whole, but is never equal to one, inside one or across its edge."""
    base = sorted(detect(text))
    m = disguised(text)
    if m.first is None:
        return base, []
    taken = sorted((a, b) for _, a, b in base)
    starts, longest = [a for a, _ in taken], []
    for _, b in taken:
        longest.append(max(b, longest[-1] if longest else 0))

    def fits(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b) - 1
        while i >= 0 and longest[i] > a:
            c, d = taken[i]
            if d > a and (c < a or d > b or (c, d) == (a, b)):
                return False
            i -= 1
        return True

    mapped = {(kind, *m.source(a, b)) for kind, a, b in detect(m.text)}
    return base, sorted(s for s in mapped if fits(s[1], s[2]))


def find_personal(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, and base and added: arrays of (kind number, start, stop) in code points, by kind and
    start, of each row.

    Null and empty texts have no spans; null keys stay, repeated rows are each scanned, an empty
    table gives none; other columns are not read. Whole texts are scanned, in time in proportion to
    their length. No shuffle.
    """
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": k, "start": a, "stop": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [personal_spans(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([listed(f[i]) for f in found], span) for i in range(2))], names=["key", "base", "added"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, spans = rows.schema["key"].dataType.simpleString(), "array<struct<kind:int,start:int,stop:int>>"
    return rows.mapInArrow(run, f"key {kind}, base {spans}, added {spans}").withColumnRenamed("key", key)


def _listed(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read(spark, sf_dir, "documents"))

    def counted(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [counted(k) for k in range(len(KINDS))]
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(both).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
