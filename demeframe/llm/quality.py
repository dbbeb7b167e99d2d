"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are compared
with references of each language by Jensen-Shannon distance (base 2, square
root taken, so 0 to 1).  The references are counted over all documents with a
language; common words are those with at least one in ``1 / WORD_SHARE`` of a
language's words, so there are at most that many of them.  Every language that any
document has gets a reference, however rare, so no labelled document is left to
the others.  The nearest language judges, word distances counted as parts of that
of a text without common words, as languages differ in it.  How far a text without any common word is depends on how much of the
language they make up, so the limit is a part of that distance: in running text of
MIN_WORDS words it is not reached, in one with next to no common word it is
passed in every language.  Texts too short for a histogram to mean anything are not judged by it.

Two narrow passes over the text; only (language, word) counts, summed in the
tasks first, are shuffled.  The broadcast references are packed arrays: a row a
language, and at most 1 / WORD_SHARE words each; a text is held against all
languages at once, by the words that it has.

Defined results.  Null text counts as empty.  With no labelled document there is
no reference and the method keeps what the base rules keep.  Repeated rows give
one result each; documents without a language are judged, but teach nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A word is common with so large a share of its language's words.
WORD_SHARE = 0.001
#: Characters and words below which the histograms don't judge.
MIN_CHARS, MIN_WORDS = 300, 100
#: Distances beyond which a document is dropped; that of words as a part of the distance of a text without common words.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.88
MIN_BASE_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang_ref string, char_distance double, word_distance double, word_limit double"

VOWELS, STOPS = b"aeiou", b".,;:!?'\"()-"
CLASSES = 9


def _class_of(b: int) -> int:
    c = bytes([b])
    if c in VOWELS and b:
        return 0
    if 97 <= b <= 122:
        return 1
    if 65 <= b <= 90:
        return 2
    if 48 <= b <= 57:
        return 3
    if b == 32 or 9 <= b <= 13:
        return 4
    if c in STOPS:
        return 5
    if b < 128:
        return 6
    return 7 if b < 0xE0 else 8


CLASS_TABLE = bytes(_class_of(b) for b in range(256))
CONTINUATION = bytes(range(0x80, 0xC0))
SPACE_AND_CONTINUATION = bytes([32, *range(9, 14)]) + CONTINUATION


def char_classes(text: bytes) -> np.ndarray:
    """Characters in each class; UTF-8 characters count by their first byte."""
    return np.bincount(np.frombuffer(text.translate(CLASS_TABLE, CONTINUATION), np.uint8), minlength=CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts or shares."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def entropy(x: np.ndarray) -> float:
        x = x[x > 0]
        return float(-(x * np.log2(x)).sum())

    return float(np.sqrt(max(0.0, entropy(m) - (entropy(p) + entropy(q)) / 2)))


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.translate(None, SPACE_AND_CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows) if len(set(windows)) < len(windows) else None
    if seen:
        end = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return chars, symbols, len(lines) - len(set(lines)), repeated


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.where(x > 0, x, 1.0))


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a place with the shares p and q adds to the Jensen-Shannon divergence; q / 2 where p is 0."""
    return (_xlogx(p) + _xlogx(q)) / 2 - _xlogx((p + q) / 2)


class References:
    """Per language: the shares of the character classes and of common words, with the rest apart."""

    def __init__(self, chars: dict[str, np.ndarray], words: dict[str, dict[bytes, int]], totals: dict[str, int]) -> None:
        self.langs = sorted(chars)
        many = len(self.langs)
        self.chars = np.array([chars[x] / chars[x].sum() for x in self.langs], float).reshape(many, CLASSES)
        entries = sorted((w, k, n / totals[x]) for k, x in enumerate(self.langs) for w, n in words.get(x, {}).items())
        #: A common word's number; its entries stand at start[i] to start[i + 1]: languages and shares there.
        self.known: dict[bytes, int] = {}
        starts = []
        for i, (w, _, _) in enumerate(entries):
            if w not in self.known:
                self.known[w] = len(self.known)
                starts.append(i)
        self.start = np.array([*starts, len(entries)], np.int64)
        self.lang = np.array([e[1] for e in entries], np.int64)
        self.share = np.array([e[2] for e in entries], float)
        covered = [sum(words.get(x, {}).values()) for x in self.langs]
        self.rest = np.array([(totals[x] - n) / totals[x] if totals[x] else 0.0 for x, n in zip(self.langs, covered, strict=True)], float)
        self.half = np.bincount(self.lang, self.share / 2, many)
        self.wordless = np.array([not totals[x] for x in self.langs], bool)
        #: The distance of a text without common words.
        self.none = self.word_distances({}, 1)

    def char_distances(self, classes: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, _shared(classes / classes.sum(), self.chars).sum(1)))

    def word_distances(self, counts: dict[bytes, int], total: int) -> np.ndarray:
        """From each language; 1 from those without words."""
        which = np.array([self.known[w] for w in counts], np.int64)
        first, n = self.start[which], self.start[which + 1] - self.start[which]
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        k = np.repeat(np.array(list(counts.values()), np.int64), n)
        lang, q, many = self.lang[at], self.share[at], len(self.langs)
        found = np.bincount(lang, _shared(k / total, q) - q / 2, many)
        rest = _shared((total - np.bincount(lang, k, many)) / total, self.rest)
        return np.where(self.wordless, 1.0, np.sqrt(np.maximum(0.0, self.half + found + rest)))

    def judge(self, text: bytes, words: list[bytes]) -> tuple[str | None, float | None, float | None, float | None]:
        """The nearest language, the distances and the limit of that of words; None where a guard holds."""
        classes = char_classes(text) if self.langs and (len(text) >= MIN_CHARS or len(words) >= MIN_WORDS) else None
        c = self.char_distances(classes) if classes is not None and classes.sum() >= MIN_CHARS else None
        d = self.word_distances(Counter(w for w in words if w in self.known), len(words)) if classes is not None and len(words) >= MIN_WORDS else None
        if c is None and d is None:
            return None, None, None, None
        part = 0.0 if d is None else np.where(self.none > 0, d / np.where(self.none > 0, self.none, 1.0), 1.0)
        x = int(np.argmin((0.0 if c is None else c) + part))
        return self.langs[x], None if c is None else float(c[x]), None if d is None else float(d[x]), float(MAX_WORD_DISTANCE * self.none[x])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): words summed within the task; classes as words of one byte after a 0 byte, all words as the 0 byte alone."""
    held: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(counts), pa.string()), "word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
        held.clear()

    for table in common.by_bytes(batches, 4 << 20):
        for text, lang in zip(table.column("text").to_pylist(), table.column("lang").to_pylist(), strict=True):
            if not text:
                continue
            counts = held.setdefault(lang, Counter())
            words = alnum_common(text)
            counts.update(words)
            counts[b"\x00"] += len(words)
            for k, n in enumerate(char_classes(text).tolist()):
                if n:
                    counts[bytes([0, k])] += n
        if sum(map(len, held.values())) > 400_000:
            yield from flush()
    yield from flush()


def alnum_common(text: bytes) -> list[bytes]:
    """The words whose histogram is taken: ASCII-lower-cased runs of letters and digits."""
    return common.alnum_words(text)


def references(docs: DataFrame) -> References:
    """Counted over all documents that have a language."""
    labelled = common.doc_bytes(docs, "lang").where("lang is not null and text is not null")
    counted = labelled.select("text", "lang").mapInArrow(common.tidy(_count), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = common.written(counted, "quality-words")
    marks = counted.where(F.substring("word", 1, 1) == F.lit(b"\x00"))
    chars: dict[str, np.ndarray] = {}
    totals: dict[str, int] = {}
    for lang, word, n in _rows(marks):
        if len(word) == 1:
            totals[lang] = n
        else:
            chars.setdefault(lang, np.zeros(CLASSES, np.int64))[word[1]] += n
    # a row a language, as the marks
    each = F.broadcast(marks.where(F.length("word") == 1).select("lang", (WORD_SHARE * F.col("n")).alias("enough")))
    words: dict[str, dict[bytes, int]] = {}
    for lang, word, n in _rows(counted.where(F.substring("word", 1, 1) != F.lit(b"\x00")).join(each, "lang").where("n >= enough").select("lang", "word", "n")):
        words.setdefault(lang, {})[word] = n
    return References(chars, words, totals)


def _rows(df: DataFrame) -> Iterator[tuple]:
    for batch in df.toArrow().to_batches():
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _score(refs) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = []
        for text in table.column("text").to_pylist():
            text = text or b""
            words = text.split()
            rows.append((len(words), *base_counts(text, words), *refs.judge(text, alnum_common(text))))
        names = [x.split()[0] for x in SCHEMA.split(", ")[1:]]
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.float64()] * 3
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table({"doc_id": table.column("doc_id")} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


def quality(docs: DataFrame) -> DataFrame:
    """Base counts, distances to the nearest language, and the verdicts."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    refs = spark.sparkContext.broadcast(references(docs))
    scored = common.map_tables(common.doc_bytes(docs), lambda: _score(refs.value), SCHEMA, 4 << 20)
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), "lang_ref", "char_distance", "word_distance")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.read_table(spark, sf_dir, "documents"))
