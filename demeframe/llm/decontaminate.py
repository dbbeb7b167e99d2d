"""Benchmark decontamination with an FM-index per shard of training text.

Each task groups its documents into shards, indexes a shard's words
(:mod:`.fm_index`), backward-searches every benchmark window, locates the
occurrences and merges them into removal spans.  No row leaves its task: the
plan is one scan without a shuffle.

The benchmark's windows are made in executors, in blocks of about ``block_bytes`` of
item text, and written to the shared folder; the driver knows the files' names only.
A task holds its table against one block after the other, keeping the last few
blocks, so neither a broadcast nor a task's memory grows with the benchmark.

Defined results.  Null or empty text: no words, no spans.  An item without words
has no windows.  Repeated rows give one result each.  Other columns are ignored.
The windows of an item without ``item_id`` count as hits, but there is no id to report.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fm_index import FMIndex

WINDOW = 13
#: Words that go into one index; three positions of it fit into a sort key.
SHARD_WORDS = 1 << 19
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


class Windows:
    """The distinct windows of a block of items as symbol rows, and the items of each; window w's end at item_end[w]."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int) -> None:
        self.width = width
        self.symbols: dict[bytes, int] = {}
        rows, owner = [np.empty((0, width), np.int32)], [np.empty(0, np.int64)]
        for k, (_, text) in enumerate(items):
            ids = np.array([self.symbols.setdefault(w, len(self.symbols) + 1) for w in common.alnum_words(text)], np.int32)
            if len(ids):
                own = np.lib.stride_tricks.sliding_window_view(ids, width) if len(ids) >= width else np.concatenate((np.zeros(width - len(ids), np.int32), ids))[None]
                rows.append(np.unique(own, axis=0))
                owner.append(np.full(len(rows[-1]), k))
        self.patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(1)
        names = np.array([0 if i is None else i for i, _ in items], np.int64)
        named = np.array([i is not None for i, _ in items], bool)
        owner = np.concatenate(owner)
        pair = np.stack((which.reshape(-1), names[owner]))[:, named[owner]] if len(items) else np.empty((2, 0), np.int64)
        pair = np.unique(pair, axis=1)
        self.items = pair[1]
        self.item_size = np.bincount(pair[0], minlength=len(self.patterns))
        self.item_end = np.cumsum(self.item_size)

    def to_bytes(self) -> bytes:
        words = list(self.symbols)
        out = io.BytesIO()
        np.savez(out, width=self.width, patterns=self.patterns, lengths=self.lengths, items=self.items, item_size=self.item_size, words=np.frombuffer(b" ".join(words), np.uint8))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Windows:
        x = np.load(io.BytesIO(data))
        out = cls.__new__(cls)
        out.width, out.patterns, out.lengths, out.items, out.item_size = int(x["width"]), x["patterns"], x["lengths"], x["items"], x["item_size"]
        out.symbols = {w: k for k, w in enumerate(x["words"].tobytes().split(), 1)}
        out.item_end = np.cumsum(out.item_size)
        return out


def _write_blocks(folder: str, width: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One file a block of items; the names carry the attempt, and only those of attempts that succeeded are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        for k, table in enumerate(common.by_bytes(batches, block_bytes)):
            path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{k}"
            store, at = common.store(path)
            with store.open_output_stream(at) as f:
                f.write(Windows(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), width).to_bytes())
            yield pa.record_batch({"path": pa.array([path], pa.string())})

    return run


def window_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> list[str]:
    """Files with the windows of all items."""
    spark = benchmark.sparkSession
    folder = common.scratch(spark, "windows")
    store, at = common.store(folder)
    store.create_dir(at, recursive=True)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    made = items.repartition(max(1, -(-size // block_bytes))).mapInArrow(common.tidy(_write_blocks(folder, width, block_bytes)), "path string")
    return sorted(r[0] for r in made.collect())


@lru_cache(2)
def _block(path: str) -> Windows:
    store, at = common.store(path)
    with store.open_input_stream(at) as f:
        return Windows.from_bytes(f.read())


def _pieces(counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of documents with at most ``most`` words, or one longer document."""
    out, start, held = [], 0, 0
    for i, n in enumerate(counts):
        if i > start and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += n
    if start < len(counts):
        out.append((start, len(counts)))
    return out


def find_in_words(words: list[list[bytes]], windows: Windows, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Merged removal spans (document, start, end) and the items found in each document."""
    counts = np.array([len(w) for w in words], np.int64)
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    items = [np.empty(0, np.int64)] * len(words)
    if not len(windows.lengths):
        return (*[np.empty(0, np.int64)] * 3, items)
    for a, b in _pieces(counts + 1, shard_words):
        # one separator (the empty word, which is in no pattern) ends each document
        total = int(counts[a:b].sum()) + b - a
        chained = itertools.chain.from_iterable(itertools.chain(w, (b"",)) for w in words[a:b])
        ids = np.fromiter(map(windows.symbols.get, chained, itertools.repeat(0)), np.int64, total)
        starts = np.cumsum(counts[a:b] + 1) - counts[a:b] - 1
        keep = ids > 0
        keep[1:] |= ids[:-1] > 0
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        which, where = [], []
        # a document beyond the index's size is cut into pieces that overlap by a window less one word
        for k in range(0, max(1, len(at) - windows.width + 1), shard_words):
            piece = at[k : k + shard_words + windows.width - 1]
            symbols = ids[piece]
            if symbols[-1]:
                symbols = np.append(symbols, 0)
            index = FMIndex(symbols, len(windows.symbols))
            w, p = index.locate(*_complete(index, windows))
            which.append(w)
            where.append(piece[p])
        w, p = np.concatenate(which), np.concatenate(where)
        if not len(w):
            continue
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, p, 1)
        np.add.at(cover, p + windows.lengths[w], -1)
        hit = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
        begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
        doc = np.searchsorted(starts, begin, "right") - 1
        spans.append((doc + a, begin - starts[doc], end - starts[doc]))
        doc = np.searchsorted(starts, p, "right") - 1
        pair = np.unique(np.stack((doc, w)), axis=1)
        size = windows.item_size[pair[1]]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found = np.unique(np.stack((np.repeat(pair[0], size), windows.items[np.repeat(windows.item_end[pair[1]] - size, size) + offset])), axis=1)
        docs, first = np.unique(found[0], return_index=True)
        for d, got in zip(docs, np.split(found[1], first[1:]) if len(docs) else (), strict=True):
            items[a + d] = got
    parts = [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.empty(0, np.int64)] * 3
    return parts[0], parts[1], parts[2], items


def _complete(index: FMIndex, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    return index.search(windows.patterns, windows.lengths)


def _merge(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(old + new):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _search(paths: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Spans and items of a table's texts, over one block after the other."""

    def run(table: pa.Table) -> pa.Table:
        words = [common.alnum_words(t) if t else [] for t in table.column("text").to_pylist()]
        spans: list[list[tuple[int, int]]] = [[] for _ in words]
        items: list[list[int]] = [[] for _ in words]
        for path in paths:
            doc, start, end, found = find_in_words(words, _block(path))
            cut = np.searchsorted(doc, np.arange(len(words) + 1)).tolist()
            for k, (i, j) in enumerate(itertools.pairwise(cut)):
                if i < j:
                    spans[k] = _merge(spans[k], list(zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)))
                    items[k] = sorted({*items[k], *found[k].tolist()})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind),
                "items": pa.array(items, pa.list_(pa.int64())),
            }
        )

    return run


def removal_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, table_bytes: int = 4 << 20, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, merged word spans to remove, and the ids of items that occur.

    Spans are half-open and count words from 0.  ``carry`` names columns to keep.
    """
    common.arrow_limits(docs.sparkSession)
    paths = window_blocks(benchmark, width, block_bytes)
    return common.map_tables(common.doc_bytes(docs, *(c for c in carry if c != "text")), lambda: _search(paths), SCHEMA, table_bytes, carry)


def report(spans: DataFrame) -> DataFrame:
    """Counts, digest and verdict from :func:`removal_spans`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return spans.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "spans"
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(removal_spans(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.withColumn("spans", shown)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: From the rule, not from the plan: every run of words of a length that windows have is compared with the windows.
OP1_SQL = f"""
with docs as (select row_number() over () as r, cast(doc_id as bigint) as doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark where text is not null),
windows as (
  select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') as x
  from items, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as t(i) where len(w) > 0),
runs as (
  select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as x
  from docs, (select distinct n from windows) as s, unnest(range(1, len(w) - n + 2)) as t(i)),
hits as (select r, i, n, item_id from runs join windows using (n, x)),
words as (select distinct r, p from hits, unnest(range(i - 1, i - 1 + n)) as t(p)),
isles as (select r, min(p) as a, max(p) + 1 as b from (select r, p, p - row_number() over (partition by r order by p) as isle from words) group by r, isle),
spans as (select r, string_agg(a || ':' || b, ',' order by a) as spans, sum(b - a) as n_hit from isles group by r),
named as (select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from (select distinct r, item_id from hits where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated, coalesce(spans, '') as spans
from docs left join spans using (r) left join named using (r)
"""
