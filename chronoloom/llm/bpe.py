"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. At first its one state allows every base symbol after every other. Each
merge (u, v) -> w, in order, is a gadget on it: the state p that u leads to is split, u leads to the
copy, and the copy lacks the arc v; wherever u may be read, w may too, and leads to where v led
before. What remains after the last merge are the arc sequences that BPE yields, one for each word.

So where an arc leads depends on its token alone, and the states can bear the tokens' names. A state
differs by one missing arc from the one it was copied from; the tables hold that arc and the time of
the merge instead of all arcs (states times tokens). ``allowed(t, x)`` looks for the arc x, or for the
left part it stems from if x was made later, among the arcs that t's state lacks, and so back to the
state that t took over from its right part.

A word is encoded in one pass over its symbols by a transition table. Each prefix of a word is spelled
by exactly one accepted arc sequence, so what matters after a prefix is the state that it reached and
the labels that are under way: for each earlier position, how far a label begun there has come, and
the state there. These sets are numbered as they are met (the subset construction, done lazily), each
with the arc that ends there; a known step is one look-up, and the arcs are read off from the end.
Decoding joins the arc labels with blanks, as the library does for a vocabulary without decoder.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: What \s stands for in the vocabulary file's patterns (Unicode White_Space), for use in a class.
SPACES = "\t-\r \x85\xa0  -     　"
#: Distinct words whose codes a Python worker keeps at once, and the longest word that is kept.
CACHED_WORDS, CACHED_LENGTH = 200_000, 64
#: Sets of the transition table after which it starts anew, between words.
KNOWN_SETS = 250_000
#: Characters of decoded text and bytes of ids after which a batch of results goes out.
FLUSH = 8_000_000


def byte_symbols() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass
class Automaton:
    """left, right and made (the merge's number, -1 for base symbols) are by token; ``lacks`` maps
    (token * width + token) to the merge that removed that arc. ``prefixes`` maps (node * width + base
    symbol) to the next node, ``labelled`` a node to the token it spells."""

    left: list[int]
    right: list[int]
    made: list[int]
    lacks: dict[int, int]
    prefixes: dict[int, int]
    labelled: dict[int, int]
    width: int

    def allowed(self, after: int, token: int, until: int = 1 << 60) -> bool:
        """Whether the state that ``after`` leads to (-1: the first) has the arc, counting the gadgets
        of merges before ``until``."""
        lacks, made, width = self.lacks, self.made, self.width
        while after >= 0:
            at, before = after, until
            while True:
                if lacks.get(at * width + token, before) < before:
                    return False
                if made[at] < 0:
                    break
                before = min(before, made[at])
                at = self.right[at]
            if made[token] < 0:
                break
            until = min(until, made[token] + 1)
            token = self.left[token]
        return True


class Runner:
    """The automaton over base symbols, made deterministic as far as it is used.

    ``steps`` maps (set number * width + symbol) to a set number. A set is bytes of 32-bit integers: the
    token that ends there and its length, then its arcs under way as (node, token before, symbols so far).
    Tuples of tuples would take several times the memory. ``tokens`` and ``lengths`` repeat the first two.
    """

    def __init__(self, automaton: Automaton, most: int = KNOWN_SETS):
        self.automaton, self.most = automaton, most
        self.clear()

    def clear(self) -> None:
        self.steps: dict[int, int] = {}
        self.sets: list[bytes] = [struct.pack("5i", -1, 0, 0, -1, 0)]
        self.tokens, self.lengths = array("i", [-1]), array("i", [0])
        self.numbers: dict[bytes, int] = {}

    def run(self, symbols: Sequence[int]) -> list[int]:
        """The tokens on the accepted path whose labels spell the symbols."""
        if len(self.sets) > self.most:
            self.clear()
        width, steps, at, path = self.automaton.width, self.steps, 0, []
        for s in symbols:
            key = at * width + s
            try:
                at = steps[key]
            except KeyError:
                at = steps[key] = self.step(at, s)
            path.append(at)
        out, i, tokens, lengths = [], len(path), self.tokens, self.lengths
        while i:
            at = path[i - 1]
            length = lengths[at]
            if not length:
                raise ValueError("no accepted path")
            out.append(tokens[at])
            i -= length
        out.reverse()
        return out

    def step(self, at: int, symbol: int) -> int:
        a = self.automaton
        found, reached, reached_length = array("i", [-1, 0]), -1, 0
        for node, before, length in struct.iter_unpack("3i", memoryview(self.sets[at])[8:]):
            node = a.prefixes.get(node * a.width + symbol, 0)
            if node:
                found.extend((node, before, length + 1))
                token = a.labelled.get(node)
                if token is not None and reached < 0 and a.allowed(before, token):
                    reached, reached_length = token, length + 1
        if reached >= 0:
            found.extend((0, reached, 0))
            found[0], found[1] = reached, reached_length
        known = found.tobytes()
        number = self.numbers.get(known)
        if number is None:
            number = self.numbers[known] = len(self.sets)
            self.sets.append(known)
            self.tokens.append(reached)
            self.lengths.append(reached_length)
        return number


def compile_merges(base: Sequence[int], merges: Sequence[tuple[int, int, int]], size: int) -> Automaton:
    """The automaton for base symbols and merges (u, v, w) in order, ids below size.

    A merge whose parts can't meet is dead: its token is never read. Each token must be made once.
    """
    a = Automaton([-1] * size, [-1] * size, [-1] * size, {}, {}, {}, size)
    spelled = {s: (s,) for s in base}
    for k, (u, v, w) in enumerate(merges):
        if w in spelled:
            raise ValueError(f"token {w} is made twice")
        if u not in spelled or v not in spelled or not a.allowed(u, v):
            continue
        a.lacks[u * size + v] = k
        a.left[w], a.right[w], a.made[w] = u, v, k
        spelled[w] = spelled[u] + spelled[v]
    nodes = 1
    for token, symbols in spelled.items():
        node = 0
        for s in symbols:
            key = node * size + s
            node = a.prefixes.get(key, 0)
            if not node:
                node = a.prefixes[key] = nodes
                nodes += 1
        a.labelled[node] = token
    return a


@dataclass
class Vocabulary:
    automaton: Automaton
    labels: dict[int, str]
    special: dict[str, int]
    pattern: str
    inner: list[int]
    last: list[int]
    _encoder: Encoder | None = None

    def encoder(self, decoded: bool = True) -> Encoder:
        """Kept with the vocabulary, so that a worker's later tasks find the words it knows."""
        if self._encoder is None or self._encoder.decoded != decoded:
            self._encoder = Encoder(self, decoded)
        return self._encoder


def load_vocabulary(path: str) -> Vocabulary:
    """Compile a tokenizers file of the kind BPE with word ends: normaliser NFC, white space runs to
    one blank, lower case; a split pattern; byte-level symbols. Others raise ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    model = spec["model"]
    fit = kinds == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"] and model["type"] == "BPE" and not model["dropout"] and model["end_of_word_suffix"] and spec["decoder"] is None
    if not fit or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: not a vocabulary of the kind supported")
    vocab, end, shown = model["vocab"], model["end_of_word_suffix"], byte_symbols()
    inner, last = ([vocab[shown[b] + suffix] for b in range(256)] for suffix in ("", end))
    merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
    return Vocabulary(compile_merges([*inner, *last], merges, max(labels) + 1), labels, special, split["pattern"]["Regex"], inner, last)


class Splitter:
    """Normalised text cut into words.

    Characters up to U+00FF take short character classes; they need no composition. Other texts take
    the classes of the regex module; its Unicode version isn't the library's, so a text with characters
    that this Python doesn't know (Unicode 15.1) is left to the library's normaliser and splitter.
    """

    def __init__(self, pattern: str):
        self.pattern = pattern
        few = pattern.replace(r"\s", "\t-\r \x85\xa0")
        for kind in "LN":
            few = few.replace(rf"\p{{{kind}}}", "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind))
        self.few = re.compile(few).findall
        self.few_spaces = re.compile("[\t-\r \x85\xa0]+")
        self.all = regex.compile(pattern.replace(r"\s", SPACES)).findall
        self.spaces = re.compile(f"[{SPACES}]+")
        self.known: set[str] = set()

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.other(text)
        return self.few(self.few_spaces.sub(" ", text).lower())

    def other(self, text: str) -> list[str]:
        new = set(text) - self.known
        if any(unicodedata.category(c) == "Cn" for c in new):
            from tokenizers import Regex, normalizers, pre_tokenizers

            steps = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
            split = pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
            return [w for w, _ in split.pre_tokenize_str(steps.normalize_str(text))]
        self.known |= new
        text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
        # Letter by letter, so that no letter's lower case depends on those around it.
        return self.all("".join(map(str.lower, text)) if "Σ" in text else text.lower())


class Encoder(dict):
    """Words to (ids as 32-bit integers' bytes, decoded text), of which a bounded number of short ones
    are kept: those met since the last change of generations, and, in ``older``, those of the one
    before. Bytes and strings, unlike lists, cost the garbage collector nothing. Without ``decoded``
    all decoded texts are empty."""

    def __init__(self, vocabulary: Vocabulary, decoded: bool = True):
        super().__init__()
        self.v, self.decoded = vocabulary, decoded
        self.older: dict[str, tuple[bytes, str]] = {}
        self.runner = Runner(vocabulary.automaton)
        self.words = Splitter(vocabulary.pattern)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def __missing__(self, word: str) -> tuple[bytes, str]:
        out = self.older.get(word) or self.coded(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def coded(self, word: str) -> tuple[bytes, str]:
        data = word.encode()
        symbols = list(map(self.v.inner.__getitem__, data))
        symbols[-1] = self.v.last[data[-1]]
        ids = self.runner.run(symbols)
        return array("i", ids).tobytes(), " ".join(map(self.v.labels.__getitem__, ids)) if self.decoded else ""

    def text(self, text: str) -> tuple[bytes, str]:
        """A whole text's ids and decoded text."""
        found: list[tuple[bytes, str]] = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                found.append((array("i", [self.v.special[part]]).tobytes(), part))
            elif part:
                found += map(self.__getitem__, self.words(part))
        return b"".join([ids for ids, _ in found]), " ".join([label for _, label in found]) if self.decoded else ""

    def encode(self, text: str) -> list[int]:
        return array("i", self.text(text)[0]).tolist()


def decode(ids: Sequence[int], vocabulary: Vocabulary) -> str:
    """The arc labels of the ids, joined with blanks; ids that no token has are left out."""
    return " ".join(vocabulary.labels[i] for i in ids if i in vocabulary.labels)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decoded: bool = True) -> DataFrame:
    """The key, ids array<int> and, if asked for, decoded string of each row's whole text.

    Null and empty texts have no ids and decode to the empty text. Null keys stay, repeated rows are
    each encoded, an empty table gives none; other columns are not read. A text of any length takes
    time in proportion to it; results go out in batches of bounded size. The vocabulary file is read
    on the driver, and its tables, bounded by the vocabulary, are broadcast. Equal texts that follow each
    other are encoded once. No shuffle.
    """
    tables = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tables.value.encoder(decoded)
        last, done = "", encoder.text("")
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            at, ids, ends, labels, size = 0, array("i"), [0], [], 0
            for row, value in enumerate(texts):
                if (words := value.as_py() or "") != last:
                    last, done = words, encoder.text(words)
                codes, label = done
                ids.frombytes(codes)
                labels.append(label)
                ends.append(len(ids))
                size += len(codes) + len(label)
                if size > FLUSH or row == len(texts) - 1:
                    values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                    out = [keys.slice(at, row + 1 - at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
                    if decoded:
                        out.append(pa.array(labels, pa.string()))
                    yield pa.RecordBatch.from_arrays(out, names=["key", "ids", "decoded"][: len(out)])
                    at, ids, ends, labels, size = row + 1, array("i"), [0], [], 0

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>{', decoded string' * decoded}").withColumnRenamed("key", key)


def production_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_digests(encoded: DataFrame) -> DataFrame:
    """The key, n_tokens, and SHA-256 of the ids and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(encode_documents(read(spark, sf_dir, "documents"), production_path()))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
