"""Language identification by prediction by partial matching (PPM).

Each language has byte contexts of up to ORDER bytes with the counts of what
followed them in its training texts.  A byte's code length under a language is
that of PPM with escape method C: coded in the longest context that has seen
it, after escapes from the longer ones, and uniformly when none has.  The
statistics are frozen, so a byte's exact code length depends on it and the
ORDER bytes in front alone; each distinct (ORDER + 1)-gram is worked out once
and remembered.  The language with the shortest code wins; ``score`` is its
posterior probability under equal priors.

Training counts n-grams over all labelled training texts: summed in the tasks,
then shuffled by (language, n-gram).  All of them reach the model: a task for each
language, whose rows are its distinct n-grams however many texts it has, writes its
tree to the shared folder as sorted arrays, and workers map the files; in a store that
can't be mounted they read them.  The driver gets a row a language.  A text's code
length is summed over its own bytes alone, so equal texts have equal ones.

Defined results.  A text that is null or has no letter is ``und`` with score 0,
and so is every text if nothing could be learned.  Rows with a null lang or a
null doc_id teach nothing; those with a null doc_id aren't held out.  Equal code
lengths: the first language in order.  Repeated rows give one result each.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 3
#: Bits a byte beyond which no learned language explains a text.
REJECT_BITS = 6.5
UNKNOWN = "und"
#: What stands in front of a text.
START = b"\n" * ORDER
ASCII_LETTER = re.compile(rb"[A-Za-z]")
SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' n-grams in a row, as big-endian u32, and each text's first; START's own are left out."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(x for t in texts for x in (START, t.translate(common.LOWER))), np.uint8).astype(np.uint32)
    g = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:] if len(data) > ORDER else np.empty(0, np.uint32)
    begin = np.cumsum(sizes + ORDER) - sizes - ORDER
    keep = np.zeros(len(g) + 1, np.int64)
    full = sizes > 0
    np.add.at(keep, begin[full], 1)
    np.add.at(keep, begin[full] + sizes[full], -1)
    return g[np.cumsum(keep[:-1]) > 0], np.concatenate(([0], np.cumsum(sizes)))


class Tree:
    """One language's context tree, as sorted n-gram arrays of each length."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []  # by number of context bytes
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            k, where = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(where, counts, len(k))
            context, where = np.unique(k >> np.uint32(8), return_inverse=True)
            self.seen.append((k, n))
            self.contexts.append((context, np.bincount(where, n, len(context)), np.bincount(where, minlength=len(context)).astype(float)))

    def write(self, path: str) -> list[tuple[int, int]]:
        """All arrays in a row, the wider ones of each order first; returns the sizes of each order's two tables."""
        store, at = common.store(path)
        with store.open_output_stream(at) as f:
            for (k, n), (context, total, kinds) in zip(self.seen, self.contexts, strict=True):
                for x in (n, total, kinds):
                    f.write(np.ascontiguousarray(x, np.float64).tobytes())
                # u32 in pairs, so that what follows stays aligned
                pad = np.zeros((len(k) + len(context)) % 2, np.uint32)
                f.write(np.concatenate((k, context, pad)).astype(np.uint32).tobytes())
        return [(len(k), len(c[0])) for (k, _), c in zip(self.seen, self.contexts, strict=True)]

    @classmethod
    def read(cls, path: str, sizes: list[tuple[int, int]]) -> Tree:
        store, at = common.store(path)
        if isinstance(store, pafs.LocalFileSystem):
            data = np.memmap(at, np.uint8, "r")
        else:
            with store.open_input_stream(at) as f:
                data = np.frombuffer(f.read(), np.uint8)
        offset = 0

        def take(n: int, kind: type) -> np.ndarray:
            nonlocal offset
            offset += n * np.dtype(kind).itemsize
            return np.asarray(data[offset - n * np.dtype(kind).itemsize : offset]).view(kind)

        tree = cls.__new__(cls)
        tree.seen, tree.contexts = [], []
        for many, around in sizes:
            n, total, kinds = take(many, np.float64), take(around, np.float64), take(around, np.float64)
            k, context = take(many, np.uint32), take(around, np.uint32)
            take((many + around) % 2, np.uint32)
            tree.seen.append((k, n))
            tree.contexts.append((context, total, kinds))
        return tree

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Exact code length of each n-gram's last byte after the others."""
        cost, coded = np.zeros(len(g)), np.zeros(len(g), bool)
        for order in range(ORDER, -1, -1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            n = self._find(*self.seen[order], g & mask)
            context, total, kinds = self.contexts[order]
            around = (g & mask) >> np.uint32(8)
            t, d = self._find(context, total, around), self._find(context, kinds, around)
            now = ~coded & (n > 0)
            cost[now] += np.log2((t[now] + d[now]) / n[now])
            escape = ~coded & (n == 0) & (t > 0)
            cost[escape] += np.log2((t[escape] + d[escape]) / d[escape])
            coded |= now
        cost[~coded] += 8
        return cost


class Model:
    def __init__(self, trees: dict[str, Tree | tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(trees)
        self.trees = [x if isinstance(x, Tree) else Tree(*x) for x in map(trees.__getitem__, self.langs)]
        self.slots = 1 << max(12, min(20, int(np.log2((1 << 22) / max(1, len(self.langs))))))
        self.keys = np.full(self.slots, -1, np.int64)
        self.costs = np.zeros((len(self.langs), self.slots))

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint32(2654435761)) >> np.uint32(33 - self.slots.bit_length())

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        g, cut = grams(texts)
        slot = self._slot(g)
        new = np.unique(g[self.keys[slot] != g])
        fresh = np.array([t.bits(new) for t in self.trees])
        at = self._slot(new)
        self.keys[at], self.costs[:, at] = new, fresh
        rest = np.flatnonzero(self.keys[slot] != g)  # two n-grams of one slot
        where = np.minimum(np.searchsorted(new, g[rest]), max(0, len(new) - 1))
        inside = new[where] == g[rest] if len(new) else np.zeros(len(rest), bool)
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        lost = rest[~inside]
        for k, tree in enumerate(self.trees):
            cost = self.costs[k][slot]
            cost[rest[inside]] = fresh[k][where[inside]]
            if len(lost):
                cost[lost] = tree.bits(g[lost])
            if len(full):
                out[full, k] = np.add.reduceat(cost, cut[full])
        return out


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed over the task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            k, n = merged(parts)
            for i in range(0, len(k), 100_000):
                yield pa.record_batch({"lang": pa.array([lang] * len(k[i : i + 100_000]), pa.string()), "gram": pa.array(k[i : i + 100_000].astype(np.int64)), "n": pa.array(n[i : i + 100_000])})
        held.clear()

    for table in common.by_bytes(batches, 4 << 20):
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(table.column("text").to_pylist(), table.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            g, _ = grams(texts)
            if len(g):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(g, return_counts=True))
                if len(parts) > 8:
                    parts[:] = [merged(parts)]
        if sum(len(k) for parts in held.values() for k, _ in parts) > 3_000_000:
            yield from flush()
    yield from flush()


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and text is not null and doc_id is not null and crc32(cast(cast(doc_id as long) as string)) % 3 != 1")


#: Where a language's tree is, and the sizes of its tables.
Trees = dict[str, tuple[str, list[tuple[int, int]]]]


def _write_tree(folder: str) -> Callable[[pa.Table], pa.Table]:
    """One language's tree as a file; its name carries the attempt."""

    def run(table: pa.Table) -> pa.Table:
        path = f"{folder}/{uuid.uuid4().hex}.tree"
        sizes = Tree(table.column("gram").to_numpy().astype(np.uint32), table.column("n").to_numpy().astype(np.float64)).write(path)
        return pa.table({"lang": table.column("lang").slice(0, 1), "path": pa.array([path], pa.string()), "sizes": pa.array([[x for pair in sizes for x in pair]], pa.list_(pa.int64()))})

    return run


def train(labelled: DataFrame) -> Trees:
    """Each language's tree of all its n-grams, in the shared folder."""
    counted = common.doc_bytes(labelled, "lang").select("text", "lang").mapInArrow(common.tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    folder = common.scratch(labelled.sparkSession, "ppm-trees")
    store, at = common.store(folder)
    store.create_dir(at, recursive=True)
    # at most a row for each n-gram of four bytes that the language has
    made = counted.groupBy("lang").applyInArrow(_write_tree(folder), "lang string, path string, sizes array<long>").collect()
    return {r["lang"]: (r["path"], list(itertools.pairwise(r["sizes"]))[::2]) for r in made}


_models: dict[str, Model] = {}


def _model(sent, key: str) -> Model:
    """One model for each broadcast and worker; only the last one is kept."""
    if key not in _models:
        _models.clear()
        _models[key] = Model({x: Tree.read(*at) for x, at in sent.value.items()})
    return _models[key]


def _predict(model: Model) -> Callable[[pa.Table], pa.Table]:

    def run(table: pa.Table) -> pa.Table:
        texts = [t or b"" for t in table.column("text").to_pylist()]
        pred, score, per = [], [], []
        bits = model.code_lengths(texts) if model.langs else np.zeros((len(texts), 0))
        for text, row in zip(texts, bits, strict=True):
            if not len(row) or not has_letter(text):
                pred.append(UNKNOWN)
                score.append(0.0)
                per.append(None)
                continue
            best = int(row.argmin())
            pred.append(model.langs[best])
            score.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
            per.append(float(row[best] / len(text)))
        return pa.table({"doc_id": table.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(per, pa.float64())})

    return run


def predict(docs: DataFrame, trees: Trees, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every text; ``carry`` names columns to keep."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    sent, key = spark.sparkContext.broadcast(trees), uuid.uuid4().hex
    return common.map_tables(common.doc_bytes(docs, *(c for c in carry if c != "text")), lambda: _predict(_model(sent, key)), SCHEMA, 1 << 20, carry)


def language(docs: DataFrame) -> DataFrame:
    """Learns from the training fold and predicts every document."""
    common.arrow_limits(docs.sparkSession)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs, train(training_rows(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(common.read_table(spark, sf_dir, "documents"))
