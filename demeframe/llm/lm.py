"""An interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting.  Tasks count their batches' word pairs and send them, packed in arrays,
to shards by ranges of the pair's hash; so a shard's size doesn't depend on how
often one word or pair occurs.  A shard sums its pairs, writes them as a sorted
array of hashes with their counts, and sends what they say about their words on
to word shards: how often and after how many words each occurs, and how many
words follow it once, twice and more often.  These are written as sorted arrays
too.  A file's name says its shard and nothing else, and it is put in place whole, so a
task that runs again writes the same file; the driver gets one row of totals.

Scoring.  Workers map the files into memory, so they share pages and keep none of
their own, look up each batch's distinct words and pairs in order, in the files of the
shards that these fall into, and sum log10 p over each text.  One narrow pass without a
shuffle; a batch opens as many files as it has pairs at most, however many there are.

p(w|u) = max(c(u,w) - D(c), 0) / c(u) + g(u) p(w), with D for counts of 1, 2 and
more and g(u) what they leave; p(w) is the same over how many words w follows,
with 1 / (V + 1) below it, so an unknown word has a share as well.

Words and pairs are known by 64-bit hashes; those that collide count as one.
The order is two: with trigrams the counts alone would take more than the disk
that four times the input allows.

Defined results.  Null or blank texts are the end token alone.  A null doc_id is
not held out and teaches.  With nothing to learn from, every score is 0.
Repeated rows give one result each and teach as often as they stand there.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: crc32(doc_id as text) mod FOLDS that is held out.
FOLDS, HELD_OUT = 7, 2
#: No word holds white space, so these hashes are those of no word.
END, START = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" start")
#: Text bytes in one batch, and in all for each pair shard.
BATCH, SHARD_BYTES = 4 << 20, 16 << 20
#: Discounts where the counts of counts give none.
FALLBACK = 0.75
#: A pair is known by the 48 bits of its hash that follow those its shard has; a word by its hash.  MANY stands for a count kept apart.
PAIR, MANY = ("high", "low", "count"), 255
WORD = ("hash", "count", "after", "once", "twice", "often")
#: Numbers at the head of a file: its rows, and of each column the bytes of a number and how many there are.
HEAD = 32
TOTALS = "kind string, rows long, total long, n1 long, n2 long, n3 long, n4 long"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

_M = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (u ^ (u >> np.uint64(32))) * _M + w
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Batch:
    """Texts as places in a table of word hashes, and their distinct pairs."""

    def __init__(self, texts: list[bytes | None]) -> None:
        words = [common.space_words(t) if t else [] for t in texts]
        self.sizes = np.array([len(w) + 1 for w in words], np.int64)
        known: dict[bytes | None, int] = {}
        flat = np.fromiter((known.setdefault(w, len(known)) for w in itertools.chain.from_iterable(itertools.chain(w, (None,)) for w in words)), np.int64, int(self.sizes.sum()))
        self.hashes = np.array([*(END if w is None else xxhash.xxh3_64_intdigest(w) for w in known), START], np.uint64)
        self.words = flat
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = len(known)
        self.pairs, self.pair_of, self.pair_count = np.unique(before * len(self.hashes) + flat, return_inverse=True, return_counts=True)
        self.before, self.after = np.divmod(self.pairs, len(self.hashes))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text; every text has a token, and none depends on the others of its batch."""
        return np.add.reduceat(values, np.cumsum(self.sizes) - self.sizes) if len(self.sizes) else np.zeros(0)


def _count(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (shard, words, before, after, counts): a batch's training pairs that belong to a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.by_bytes(batches, BATCH):
            texts = [t for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True) if not held_out(d)]
            if not texts:
                continue
            b = Batch(texts)
            key = pair_hash(b.hashes[b.before], b.hashes[b.after])
            order = np.argsort(key)
            shard = key[order] >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
            cut = np.searchsorted(shard, np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = []
            for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                mine = np.sort(order[cut[k] : cut[k + 1]])  # in order of the first word, so steps between them are small
                used, place = np.unique(np.concatenate((b.before[mine], b.after[mine])), return_inverse=True)
                rows.append((k, b.hashes[used].tobytes(), _packed(np.diff(place[: len(mine)], prepend=0)), _packed(place[len(mine) :]), _packed(b.pair_count[mine]), len(mine)))
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "words", "before", "after", "counts", "n"])

    return run


def _narrow(x: np.ndarray) -> np.ndarray:
    """As the narrowest unsigned integers."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * np.dtype(k).itemsize))


def _packed(x: np.ndarray) -> bytes:
    return _narrow(x).tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"<u{len(x) // n}")


def _path(folder: str, kind: str, shard: int) -> str:
    return f"{folder}/{kind}-{shard:09d}"


def _write(path: str, columns: list[np.ndarray]) -> None:
    """A column after the other, each from a multiple of eight bytes on."""
    task = TaskContext.get()
    store, at = common.store(path)
    mine = f"{at}.{task.stageId()}-{task.taskAttemptId()}"
    head = np.zeros(HEAD, "<u8")
    head[: 2 * len(columns)] = [n for x in columns for n in (x.dtype.itemsize, len(x))]
    with store.open_output_stream(mine) as f:
        f.write(head.tobytes())
        for x in columns:
            f.write(x.tobytes() + bytes(-x.nbytes % 8))
    store.move(mine, at)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows in order of shard, together."""
    for shard, rows in itertools.groupby((r for b in batches for r in b.to_pylist()), lambda r: r["shard"]):
        yield shard, list(rows)


_PART = "shard int, totals string, n int, hashes binary, count binary, after binary, once binary, twice binary, often binary"


def _totals(kind: str, counts: np.ndarray, total: int) -> str:
    return "\t".join(map(str, (kind, len(counts), total, *(int((counts == k).sum()) for k in (1, 2, 3, 4)))))


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 6]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PART.split(", ")])


def _pairs(folder: str, bits: int, word_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums a shard's pairs and writes them; yields what they say about words, and a row on the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches):
            before, after, counts = [], [], []
            for r in rows:
                words = np.frombuffer(r["words"], np.uint64)
                before.append(words[np.cumsum(_unpacked(r["before"], r["n"]), dtype=np.int64)])
                after.append(words[_unpacked(r["after"], r["n"])])
                counts.append(_unpacked(r["counts"], r["n"]))
            rows.clear()
            before, after, counts = (np.concatenate(x) for x in (before, after, counts))
            key = pair_hash(before, after)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            c = np.add.reduceat(counts[order].astype(np.int64), first)
            before, after, known = before[order[first]], after[order[first]], key[first] << np.uint64(bits)
            del key, order, counts
            many = np.flatnonzero(c >= MANY)
            _write(_path(folder, "pair", shard), [(known >> np.uint64(32)).astype("<u4"), (known >> np.uint64(16)).astype("<u2"), np.minimum(c, MANY).astype("<u1"), many.astype("<u8"), c[many].astype("<u8")])
            yield _parts([(-1, _totals("pair", c, int(c.sum())), 0, *[b""] * 6)])
            words, place = np.unique(np.concatenate((before, after)), return_inverse=True)
            values = np.zeros((5, len(words)), np.int64)
            b, a = place[: len(before)], place[len(before) :]
            values[0] = np.bincount(a, c, len(words))  # exact up to 2^53
            values[1] = np.bincount(a, minlength=len(words))
            for k, at in ((2, c == 1), (3, c == 2), (4, c > 2)):
                values[k] = np.bincount(b[at], minlength=len(words))
            own = words >> np.uint64(64 - word_bits) if word_bits else np.zeros(len(words), np.uint64)
            cut = np.searchsorted(own, np.arange((1 << word_bits) + 1, dtype=np.uint64))
            yield _parts([(k, None, j - i, words[i:j].tobytes(), *(_packed(v[i:j]) for v in values)) for k, (i, j) in enumerate(itertools.pairwise(cut.tolist())) if j > i])

    return run


def _words(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums a shard's words and writes them; yields the totals of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = []
        for shard, rows in _groups(batches):
            if shard < 0:
                totals += [r["totals"] for r in rows]
                continue
            hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
            values = [np.concatenate([_unpacked(r[name], r["n"]).astype(np.int64) for r in rows]) for name in WORD[1:]]
            rows.clear()
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            out = dict(zip(WORD[1:], (np.add.reduceat(x[order], first) for x in values), strict=True))
            _write(_path(folder, "word", shard), [hashes[first], *map(_narrow, out.values())])
            totals.append(_totals("word", out["after"], int(out["count"].sum())))
        for x in totals:
            yield pa.record_batch({"totals": pa.array([x], pa.string())})

    return run


def discounts(n: tuple[int, int, int, int]) -> np.ndarray:
    """D for counts 0 to 3 and more, from the numbers of items counted once to four times."""
    n1, n2, n3, n4 = map(float, n)
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
        if (d[1:] > 0).all() and (d[1:] < [1, 2, 3]).all():
            return d
    return np.array([0, *[FALLBACK] * 3])


class Model:
    """What of the model is small: totals, discounts, and where the files are."""

    def __init__(self, folder: str, bits: int, word_bits: int, pairs: tuple[int, ...], words: tuple[int, ...]) -> None:
        """``pairs`` and ``words`` have the totals over their files: rows, counts, and the numbers of rows with counts 1 to 4."""
        self.folder, self.bits, self.word_bits = folder, bits, word_bits
        self.tokens, self.pair_kinds = words[1], pairs[0]
        self.pair_discounts = discounts(pairs[2:])
        self.word_discounts = discounts(words[2:])
        #: Words that occur; the start of a text is none of them.
        self.vocabulary = max(0, words[0] - 1)
        d = self.word_discounts
        left = d[1] * words[2] + d[2] * words[3] + d[3] * (self.vocabulary - words[2] - words[3])
        self.below = left / self.pair_kinds / (self.vocabulary + 1) if self.pair_kinds else 1.0


@lru_cache(4096)
def _mapped(path: str) -> list[np.ndarray]:
    """A file's columns; mapped where the shared folder is mounted, else read.  No file: no rows."""
    store, at = common.store(path)
    if store.get_file_info(at).type == pafs.FileType.NotFound:
        return [np.zeros(0, np.uint64)] * len(WORD)
    if isinstance(store, pafs.LocalFileSystem):
        data = np.memmap(at, np.uint8, "r")
    else:
        with store.open_input_stream(at) as f:
            data = np.frombuffer(f.read(), np.uint8)
    columns, offset = [], 8 * HEAD
    for width, n in data[:offset].view("<u8").reshape(-1, 2).tolist():
        if width:
            columns.append(np.asarray(data[offset : offset + width * n]).view(f"<u{width}"))
            offset += width * n + -width * n % 8
    return columns


def _shards(asked: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, i, j) of the shards that the sorted hashes fall into."""
    if not len(asked):
        return
    shard = asked >> np.uint64(64 - bits) if bits else np.zeros(len(asked), np.uint64)
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    yield from zip(shard[first].tolist(), first.tolist(), np.append(first[1:], len(asked)).tolist(), strict=True)


def pair_counts(model: Model, wanted: np.ndarray) -> np.ndarray:
    """How often the pairs with the hashes ``wanted`` were seen."""
    order = np.argsort(wanted)
    asked = wanted[order]
    out = np.zeros(len(wanted), np.int64)
    for shard, i, j in _shards(asked, model.bits):
        highs, lows, counts, many, rest = _mapped(_path(model.folder, "pair", shard))[:5]
        key = asked[i:j] << np.uint64(model.bits)
        high, low = (key >> np.uint64(32)).astype(np.uint32), (key >> np.uint64(16)).astype(np.uint16)
        at = np.searchsorted(highs, high)
        left = np.arange(j - i)
        while len(left):  # more rounds than one only where pairs share their first 32 bits
            left = left[at[left] < len(highs)]
            left = left[highs[at[left]] == high[left]]
            hit = lows[at[left]] == low[left]
            found = at[left[hit]]
            count = counts[found].astype(np.int64)
            full = np.flatnonzero(count == MANY)
            count[full] = rest[np.searchsorted(many, found[full])]
            out[order[i + left[hit]]] = count
            left = left[~hit]
            at[left] += 1
    return out


def look_up(model: Model, wanted: np.ndarray, *names: str) -> list[np.ndarray]:
    """Columns of the words with the hashes ``wanted``, 0 where there is none."""
    order = np.argsort(wanted)
    asked = wanted[order]
    out = [np.zeros(len(wanted), np.int64) for _ in names]
    for shard, i, j in _shards(asked, model.word_bits):
        columns = _mapped(_path(model.folder, "word", shard))
        hashes = columns[0]
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, asked[i:j]), len(hashes) - 1)
            found = np.flatnonzero(hashes[at] == asked[i:j])
            for x, name in zip(out, names, strict=True):
                x[order[i + found]] = columns[WORD.index(name)][at[found]]
    return out


def score_batch(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    b = Batch(texts)
    count, after, once, twice, often = look_up(model, b.hashes, "count", "after", "once", "twice", "often")
    pair = pair_counts(model, pair_hash(b.hashes[b.before], b.hashes[b.after]))
    base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
    low = np.maximum(after - model.word_discounts[np.minimum(after, 3)], 0) / max(1, model.pair_kinds) + model.below
    d = model.pair_discounts
    # a text starts as often as texts end; the end is followed by nothing
    follows = count.copy()
    follows[-1] = look_up(model, np.array([END], np.uint64), "count")[0][0]
    follows[b.hashes == END] = 0
    share = np.where(follows > 0, (d[1] * once + d[2] * twice + d[3] * often) / np.maximum(follows, 1), 1.0)
    seen = np.where(follows[b.before] > 0, np.maximum(pair - d[np.minimum(pair, 3)], 0) / np.maximum(follows[b.before], 1), 0.0)
    p = np.log10(seen + share[b.before] * low[b.after])
    return b.sizes, b.per_text((count[b.words] > 0).astype(np.int64)), b.per_text(base[b.words]), b.per_text(p[b.pair_of])


def train(docs: DataFrame, folder: str) -> Model:
    """Counts the training fold of ``docs`` and writes the model to ``folder``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // SHARD_BYTES).bit_length())
    word_bits = max(0, bits - 2)
    store, at = common.store(folder)
    store.create_dir(at, recursive=True)
    sent = common.doc_bytes(docs).mapInArrow(common.tidy(_count(bits)), "shard int, words binary, before binary, after binary, counts binary, n int")
    pairs = sent.repartition(1 << bits, "shard").sortWithinPartitions("shard").mapInArrow(common.tidy(_pairs(folder, bits, word_bits)), _PART)
    words = pairs.repartition(1 << word_bits, "shard").sortWithinPartitions("shard").mapInArrow(common.tidy(_words(folder)), "totals string")
    names = [x.split()[0] for x in TOTALS.split(", ")]
    fields = F.split("totals", "\t")
    rows = words.select(*[F.element_at(fields, k + 1).alias(n) for k, n in enumerate(names)])
    sums = {r[0]: tuple(int(x) for x in r[1:]) for r in rows.groupBy("kind").agg(*[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names[1:]]).collect()}
    nothing = (0,) * len(names[1:])
    return Model(folder, bits, word_bits, sums.get("pair", nothing), sums.get("word", nothing))


def score(docs: DataFrame, model: Model) -> DataFrame:
    common.arrow_limits(docs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        names = table.column("doc_id").to_pylist()
        n, known, base, mine = score_batch(model, table.column("text").to_pylist())
        return pa.table({"doc_id": table.column("doc_id"), "held_out": pa.array([held_out(d) for d in names]), "n_tokens": pa.array(n), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(mine)})

    return common.map_tables(common.doc_bytes(docs), lambda: run, SCHEMA, BATCH)


def language_model(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of the training fold."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    model = train(docs, common.scratch(spark, "lm"))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.col("n_tokens")).alias("log10_perplexity"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(common.read_table(spark, sf_dir, "documents"))
