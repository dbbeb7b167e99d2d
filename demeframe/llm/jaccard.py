"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip).

Documents with equal shingle sets form one class; classes are searched.

1. A link of J >= 0.85 shares at least T = ceil(0.85 n) of a set's n shingles, so
   under any fixed order (here the hashes') the first n - T + l of both sets
   share l of them.  The first quarter of each set goes, packed in arrays, to
   shards by hash.  A shard tells each class which of these shingles another
   class has too, and how many have it.
2. Classes with fewer such shingles than any link needs are out.  Of the others
   the rarest shingles, as many as a link can't avoid, tie classes together;
   connected components of these ties hold every link within them.
3. Each component is searched in one task: inverted lists over its sets; for each
   query the L longest lists are set aside, the short ones are heap-merged,
   and candidates found often enough are probed in the long ones by binary search.
   L is the number that makes merged entries and expected probes cheapest together.
   A component beyond GROUP sets is searched by its ties (the sets that share one, for
   each of them) if these make fewer pairs than chunks would and copy a set COPIES times at most on average, and what is
   still beyond GROUP is cut by size band and hash into chunks.  A chunk goes into a file of the shared folder once; the
   pairs of chunks that can hold a link are the tasks, and read their two files: disk grows with the sets, and only the
   work with their square.  Each pair is looked at in one task only, or counted in one: exact at any size.
4. A task tells each class how many documents it found linked, and the least class that it
   reaches there, so a group's output is as long as the group; these edges join classes to
   components (:mod:`.components`).

Hot keys.  Equal documents collapse in the task that reads them.  A shingle that
HOT classes of one batch share isn't sent with its classes: one marker says that
it is hot, and the classes that hold it are told on the spot.  Hot shingles come
last in the order of rarity, for all alike.

Shingles are 64-bit hashes of words' hashes; two different shingles count as one
if these collide.

Defined results.  Null, empty or blank texts have no shingles and are linked with
nothing.  A row without doc_id has no identity: it is linked with nothing and its
component is null.  Repeated rows give one result each, and are linked with each other;
``n_links`` counts rows.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WIDTH = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Percent of a set whose hashes are sent to shards.
PREFIX = 25
#: Shingles in one shard; classes of one batch that make a shingle hot; rank of hot shingles.
SHARD, HOT, HOT_RANK = 700_000, 64, 2**31
#: Sets, and shingles in them, that one task searches.
GROUP, GROUP_SHINGLES = 3_000, 3_000_000
#: Copies of a set that a search by ties may make, on average; pairs of chunks that a task searches, more or less.
COPIES, PAIRS = 4, 16
#: Owner of a token without a class.
NONE = 65535
#: Merged entries that one probe costs; ids that the merge takes at once.
PROBE, RANGE = 25, 1 << 12

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [common.space_words(t) if t else [] for t in texts]
    ids: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))[flat] if len(ids) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - WIDTH + 1), np.uint64)
        for j in range(WIDTH):
            rolled = _mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - WIDTH + 1 + j])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WIDTH:
            out.append(np.unique(rolled[at : at + n - WIDTH + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def class_id(s: np.ndarray) -> int:
    """One id for all equal sets."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n: int) -> int:
    """Shingles that a set of ``n`` shares with every partner."""
    return -(-PERCENT * n // 100)


#: A hash of the text, which tells rows of one doc_id apart.
SAME = "same"


def _classes() -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text").to_pylist())
        return pa.table({"doc_id": table.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())})

    return run


def _prefixes(shards: int, many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (shard, hot, classes, sizes, tokens, owner): arrays of a batch's prefix shingles that belong to a shard.

    ``owner`` says which of ``classes`` a token belongs to; hot rows say that
    ``many`` classes of the batch or more share their tokens.  A token of the shard rows without a class (owner
    NONE) is a marker of a hot one.
    """

    def rows(sets: dict[int, np.ndarray]) -> Iterator[tuple]:
        classes, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
        firsts = [s[: max(len(s) - least_overlap(len(s)) + 1, -(-PREFIX * len(s) // 100))] for s in sets.values()]
        tokens = np.concatenate(firsts)
        owner = np.repeat(np.arange(len(firsts), dtype=np.uint16), [len(x) for x in firsts])
        kinds, where, count = np.unique(tokens, return_inverse=True, return_counts=True)
        hot = (count >= many)[where]
        marks = kinds[count >= many]
        for is_hot, t, o in ((True, tokens[hot], owner[hot]), (False, np.concatenate((tokens[~hot], marks)), np.concatenate((owner[~hot], np.full(len(marks), NONE, np.uint16))))):
            # hot rows go where their class says, as nothing else has to meet them
            key = (_mix(classes.astype(np.uint64))[o] if is_hot else _mix(t)) % np.uint64(shards) if len(t) else t
            order = np.argsort(key, kind="stable")
            cut = np.searchsorted(key[order], np.arange(shards + 1, dtype=np.uint64))
            for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                mine = order[cut[k] : cut[k + 1]]
                used, place = np.unique(o[mine], return_inverse=True)
                if used[-1] == NONE:  # keeps its number, and no class
                    place[place == len(used) - 1] = NONE
                    used = used[:-1]
                yield k, is_hot, classes[used].tobytes(), sizes[used].astype(np.uint32).tobytes(), t[mine].tobytes(), place.astype(np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for table in common.by_bytes(batches, 4 << 20):
            fresh: dict[int, np.ndarray] = {}
            for s in shingle_sets(table.column("text").to_pylist()):
                if len(s) and (c := class_id(s)) not in seen:
                    fresh[c] = s
                    seen.add(c)
            if len(seen) > 1_000_000:
                seen.clear()
            names = list(fresh)
            for i in range(0, len(names), 60_000):
                out = list(rows({c: fresh[c] for c in names[i : i + 60_000]}))
                kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "hot", "classes", "sizes", "tokens", "owner"])

    return run


def _by_bucket(buckets: int, classes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
    """One row a bucket of classes, with their tokens and the tokens' ranks of rarity."""
    key = _mix(classes.astype(np.uint64)) % np.uint64(buckets)
    order = np.argsort(key, kind="stable")
    cut = np.searchsorted(key[order], np.arange(buckets + 1, dtype=np.uint64))
    rows = []
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        mine = order[cut[k] : cut[k + 1]]
        rows.append((k, classes[mine].tobytes(), sizes[mine].astype(np.uint32).tobytes(), tokens[mine].tobytes(), ranks[mine].astype(np.uint32).tobytes()))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=["bucket", "classes", "sizes", "tokens", "ranks"])


def _shared(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What classes share with others, by the shards of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        marks: list[np.ndarray] = []
        for batch in batches:
            for r in batch.to_pylist():
                classes, sizes = np.frombuffer(r["classes"], np.int64), np.frombuffer(r["sizes"], np.uint32)
                tokens, owner = np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["owner"], np.uint16)
                if r["hot"]:
                    yield _by_bucket(buckets, classes[owner], sizes[owner], tokens, np.full(len(tokens), HOT_RANK))
                    continue
                own = owner != NONE
                marks.append(tokens[~own])
                parts.append((tokens[own], classes[owner[own]], sizes[owner[own]]))
        if not parts:
            return
        tokens, classes, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((classes, tokens))
        tokens, classes, sizes = tokens[order], classes[order], sizes[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
        tokens, classes, sizes = tokens[new], classes[new], sizes[new]
        # tokens are in order, so each one's classes stand together
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(tokens)))
        rank = np.where(np.isin(tokens[first], np.concatenate(marks)), HOT_RANK, np.minimum(count, HOT_RANK - 1)).astype(np.uint32)
        keep = np.repeat(rank > 1, count)
        yield _by_bucket(buckets, classes[keep], sizes[keep], tokens[keep], np.repeat(rank, count)[keep])

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cls) of whole classes: of each one's shared tokens the rarest that a link can't avoid."""
    kinds = {"classes": np.int64, "sizes": np.uint32, "tokens": np.uint64, "ranks": np.uint32}
    parts = [tuple(np.frombuffer(r[k], t) for k, t in kinds.items()) for b in batches for r in b.to_pylist()]
    if not parts:
        return
    classes, sizes, tokens, ranks = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((tokens, ranks, classes))
    classes, sizes, tokens = classes[order], sizes[order].astype(np.int64), tokens[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
    classes, sizes, tokens = classes[new], sizes[new], tokens[new]
    first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    have = np.diff(np.append(first, len(classes)))
    # what min(l) comes to for a set and its smallest partner
    need = np.maximum(1, sizes[first] * ((PREFIX - (100 - PERCENT)) * PERCENT) // 10_000)
    place = np.arange(len(classes)) - np.repeat(first, have)
    keep = place < np.repeat(have - need + 1, have)
    yield pa.record_batch({"token": pa.array(tokens[keep].view(np.int64)), "cls": pa.array(classes[keep])})


class Group:
    """Sets and their inverted lists; answers which sets behind a set it is linked with.

    With two sides only pairs across them count: the sets of side 0 come first, and those of side 1 are behind each of
    them.  Else sets come in order of size, and all that follow a set are behind it.
    """

    def __init__(self, sets: list[np.ndarray], side: np.ndarray) -> None:
        n = np.array([len(s) for s in sets], np.int64)
        self.across = bool((side == 0).any())
        self.order = np.lexsort((n, side)) if self.across else np.argsort(n, kind="stable")
        self.n = n[self.order]
        self.m = len(sets)
        self.queries = int((side == 0).sum()) if self.across else self.m
        tokens = np.concatenate([sets[k] for k in self.order])
        owner = np.repeat(np.arange(self.m), self.n)
        self.cut = np.concatenate(([0], np.cumsum(self.n)))
        by_token = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[by_token], owner[by_token]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        kind = np.cumsum(new) - 1
        #: (list, owner) as one number, in order.
        self.keys = kind * self.m + self.owner
        end = np.append(np.flatnonzero(new)[1:], len(tokens))
        # each set's tokens: their lists, where what stands behind the set begins there, and where the list ends
        place = np.empty(len(tokens), np.int64)
        place[by_token] = np.arange(len(tokens))
        self.kind, self.end = kind[place], end[kind[place]]
        self.begin = np.searchsorted(self.keys, self.kind * self.m + self.queries) if self.across else place + 1
        # a link needs as many shingles that something behind the set has too
        behind = np.add.reduceat((self.end > self.begin).astype(np.int64), self.cut[:-1])
        self.hopeful = np.flatnonzero((behind >= -(-PERCENT * self.n // 100))[: self.queries])

    def linked(self, q: int) -> np.ndarray:
        """The sets behind ``q`` that it is linked with."""
        own = slice(self.cut[q], self.cut[q + 1])
        begin, size, kind = self.begin[own], self.end[own] - self.begin[own], self.kind[own]
        need = least_overlap(int(self.n[q]))
        by_size = np.argsort(size, kind="stable")
        by_size = by_size[np.searchsorted(size[by_size], 1) :]
        if len(by_size) < need:
            return np.empty(0, np.int64)
        begin, size, kind = begin[by_size], size[by_size], kind[by_size]
        aside = np.arange(min(need, len(size)))
        merged = np.cumsum(size)[len(size) - 1 - aside]
        aside = int(np.argmin(merged + merged / (need - aside) * aside * PROBE))
        short = len(size) - aside
        who, count = merge([self.owner[b : b + n] for b, n in zip(begin[:short].tolist(), size[:short].tolist(), strict=True)])
        # linked sets differ in size by a share of the larger one at most
        keep = (count >= need - aside) & (100 * np.minimum(self.n[who], self.n[q]) >= PERCENT * np.maximum(self.n[who], self.n[q]))
        who, count = who[keep], count[keep]
        left = kind[short:][::-1]
        while len(left) and len(who):
            part = left[: max(1, 200_000 // len(who))]
            wanted = (part[:, None] * self.m + who[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            count = count + (self.keys[at] == wanted).reshape(len(part), -1).sum(0)
            left = left[len(part) :]
            keep = count + len(left) >= need
            who, count = who[keep], count[keep]
        return who[100 * count >= PERCENT * (self.n[who] + self.n[q] - count)]


def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of sorted lists in order, and in how many lists each is.

    The heap has each list's next id; all lists with ids in the range of the least one are taken together.
    """
    heap = [(int(x[0]), k, 0) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    ids, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while heap:
        base = heap[0][0]
        here = []
        while heap and heap[0][0] < base + RANGE:
            _, k, i = heap[0]
            x = lists[k]
            j = len(x) if x[-1] < base + RANGE else int(np.searchsorted(x, base + RANGE))
            here.append(x[i:j])
            if j < len(x):
                heapq.heapreplace(heap, (int(x[j]), k, j))
            else:
                heapq.heappop(heap)
        found = np.bincount(np.concatenate(here) - base)
        at = np.flatnonzero(found)
        ids.append(at + base)
        counts.append(found[at])
    return np.concatenate(ids), np.concatenate(counts)


def search(sets: list[np.ndarray], docs: np.ndarray, side: np.ndarray, own: Callable[[int, list[int]], list[bool]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, how many documents it is linked with in this group, and the least set that it reaches.

    ``docs`` are the sets' documents; ``own`` says which of a set's links are counted here.
    """
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    if len(sets) < 2 or len(np.unique(side)) < 2 and side[0] < 2:
        return links, root
    group = Group(sets, side)
    for q in group.hopeful.tolist():
        found = group.order[group.linked(q)]
        if not len(found):
            continue
        me = group.order[q]
        roots = np.unique(np.append(root[found], root[me]))
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
        if own:
            found = found[own(int(me), found.tolist())]
        links[me] += docs[found].sum()
        links[found] += docs[me]
    return links, root


#: Of a set in a search: its class, documents, ties and shingles.
_SET = ["cls", "docs", "ties", "shingles"]
#: (side) All pairs of a group count, those across two sides, or the group is a chunk.
ALL, CHUNK = 2, 3


def _found(token: int | None, rows: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    """(cls, least, links) of the classes with links; ``rows`` has each class's set, documents, side and ties."""
    names = sorted(rows)
    sets, docs, side, ties = zip(*(rows[c] for c in names), strict=True)
    own = None
    if token is not None:
        # links of sets that share several ties are counted with the least one
        before = [frozenset(x for x in t if x < token) for t in ties]
        own = lambda i, found: [before[i].isdisjoint(before[j]) for j in found]
    links, root = search(list(sets), np.array(docs, np.int64), np.array(side), own)
    kept = np.flatnonzero((links > 0) | (root != np.arange(len(names))))
    if len(kept):
        of = np.array(names, np.int64)
        yield pa.record_batch({"cls": pa.array(of[kept]), "least": pa.array(of[root[kept]]), "links": pa.array(links[kept])})


def _chunk_file(folder: str, name: str) -> str:
    return f"{folder}/{re.sub('[:/]', '_', name)}"


def _write_chunk(path: str, batches: list[pa.RecordBatch]) -> None:
    task = TaskContext.get()
    store, at = common.store(path)
    mine = f"{at}.{task.stageId()}-{task.taskAttemptId()}"
    with store.open_output_stream(mine) as f, pa.ipc.new_stream(f, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    store.move(mine, at)


@lru_cache(2)
def _chunk(path: str) -> list[tuple]:
    """(cls, set, documents, ties) of a chunk's file.  No file: no rows."""
    store, at = common.store(path)
    if store.get_file_info(at).type == pafs.FileType.NotFound:
        return []
    with store.open_input_stream(at) as f, pa.ipc.open_stream(f) as read:
        return [(r["cls"], np.frombuffer(r["shingles"], np.uint64), r["docs"], r["ties"] or ()) for b in read for r in b.to_pylist()]


def _search(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cls, least, links) of the classes with links, from rows in order of group; chunks become files of ``folder``."""

    def done(held: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, token, side = held
        if side == CHUNK:
            _write_chunk(_chunk_file(folder, name), parts)
        else:
            yield from _found(token, {r["cls"]: (np.frombuffer(r["shingles"], np.uint64), r["docs"], side, r["ties"] or ()) for b in parts for r in b.to_pylist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            heads = list(zip(*(batch.column(c).to_pylist() for c in ("group", "token", "side")), strict=True))
            start = 0
            for head, same in itertools.groupby(heads):
                if head != held:
                    if parts:
                        yield from done(held, parts)
                    held, parts = head, []
                end = start + len(list(same))
                parts.append(batch.slice(start, end - start).select(_SET))
                start = end
        if parts:
            yield from done(held, parts)

    return run


def _search_chunks(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same of pairs of chunks (first, second, token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                one, two = r["first"], r["second"]
                sides = [(one, ALL)] if one == two else [(one, 0), (two, 1)]
                rows = {c: (s, docs, side, ties) for name, side in sides for c, s, docs, ties in _chunk(_chunk_file(folder, name))}
                if rows:
                    yield from _found(r["token"], rows)
        _chunk.cache_clear()

    return run


def _sets() -> Callable[[pa.Table], pa.Table]:
    """The sets of the texts that still have the class they were chosen for."""

    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text").to_pylist())
        same = [i for i, (s, c) in enumerate(zip(sets, table.column("cls").to_pylist(), strict=True)) if len(s) and class_id(s) == c]
        kept = table.select(["cls", "docs", "ties", "groups"]).take(same)
        return kept.append_column("shingles", pa.array([sets[i].tobytes() for i in same], pa.binary()))

    return run


#: A search task that a class takes part in: its name, the tie that the task is for, and the class's side there (ALL, or CHUNK: the task is to write a chunk).
TASK = "struct<group:string,token:bigint,side:int>"


def _name(band: Column, chunk: Column) -> Column:
    return F.concat_ws(":", F.col("unit"), band.cast("string"), chunk.cast("string"))


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, task) from (cls, unit, token, n): one task a unit, or one for each of its chunks; and (unit, token, band, chunks, above) of these.

    ``above`` are the chunks of the next band, which may have links with those of this one.
    """
    sizes = rows.groupBy("unit").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    rows = rows.join(sizes, "unit").withColumn("large", (F.col("sets") > GROUP) | (F.col("shingles") > GROUP_SHINGLES))
    task = lambda name, side: F.struct(name.alias("group"), F.col("token").alias("token"), F.lit(side).alias("side")).cast(TASK)
    small = rows.where("not large").select("cls", task(F.col("unit"), ALL).alias("task"))
    # sets that link differ by a band of sizes at most
    cut = rows.where("large").select("cls", "unit", "token", "n", F.floor(F.ln("n") / float(1.001 * np.log(100 / PERCENT))).alias("band"))
    per = cut.groupBy("unit", "band").agg(F.first("token").alias("token"), F.ceil(F.greatest(F.count("*") / (GROUP // 2), F.sum("n") / (GROUP_SHINGLES // 2))).alias("chunks"))
    up = per.select("unit", (F.col("band") - 1).alias("band"), F.col("chunks").alias("above"))
    chunks = common.written(per.join(up, ["unit", "band"], "left").select("unit", "token", "band", "chunks", F.coalesce("above", F.lit(0).cast("long")).alias("above")), "jaccard-chunks")
    cut = cut.join(chunks.select("unit", "band", "chunks"), ["unit", "band"])
    return small.unionByName(cut.select("cls", task(_name(F.col("band"), F.pmod(F.xxhash64("cls"), F.col("chunks"))), CHUNK).alias("task"))), chunks


def _pairs(chunks: DataFrame) -> DataFrame:
    """(first, part, second, token): the chunks that may have links with each other, or with themselves; a part has PAIRS of a first one's."""
    one = F.lit(1).cast("long")
    first = chunks.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - one)))
    inside = F.transform(F.sequence(F.col("x"), F.col("chunks") - one), lambda y: _name(F.col("band"), y))
    above = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("above"), one) - one), lambda y: _name(F.col("band") + 1, y))).otherwise(F.array().cast("array<string>"))
    pairs = first.select(_name(F.col("band"), F.col("x")).alias("first"), F.posexplode(F.concat(inside, above)).alias("place", "second"), "token")
    return pairs.select("first", F.floor(F.col("place") / PAIRS).alias("part"), "second", "token")


def _groups(clusters: DataFrame, ties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, groups, ties): the search tasks of each class; and the chunks.  ``clusters`` has cls, component and n; ``ties`` token and cls.

    Large components are searched by their ties where these make fewer pairs.
    """
    sizes = clusters.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = sizes.where((F.col("sets") > GROUP) | (F.col("shingles") > GROUP_SHINGLES))
    tied = ties.join(clusters.join(large, "component").select("cls", "n", "component", "sets"), "cls")
    pairs = tied.groupBy("component", "sets", "token").agg(F.count("*").cast("double").alias("here")).groupBy("component", "sets").agg(F.sum(F.col("here") * F.col("here")).alias("pairs"), F.sum("here").alias("copies"))
    # a chunk holds a set once, at any size; ties copy it
    cheaper = (F.col("pairs") < F.col("sets").cast("double") * F.col("sets")) & (F.col("copies") <= F.col("sets").cast("double") * COPIES)
    by_tie = pairs.where(cheaper).select("component")
    whole = clusters.join(by_tie, "component", "left_anti").select("cls", F.col("component").cast("string").alias("unit"), F.lit(None).cast("long").alias("token"), "n")
    parts = tied.join(by_tie, "component", "left_semi").select("cls", F.concat_ws("/", F.col("component").cast("string"), F.col("token").cast("string")).alias("unit"), "token", "n")
    # a class's ties are a part of its shingles, its tasks one, or as many as its ties are
    own = parts.groupBy("cls").agg(F.collect_list("token").alias("ties"))
    dealt, chunks = _dealt(whole.unionByName(parts))
    tasks = dealt.groupBy("cls").agg(F.collect_list("task").alias("groups"))
    return tasks.join(own, "cls", "left").select("cls", "groups", "ties"), chunks


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, least, links) of linked classes: by search task, the least class reached and the documents of linked classes."""
    spark = docs.sparkSession
    texts = common.doc_bytes(docs).where("doc_id is not null and text is not null")
    shingles = classes.agg(F.sum("n")).first()[0] or 0
    shards = int(max(1, -(-shingles * PREFIX // 100 // SHARD)))
    sent = texts.mapInArrow(common.tidy(_prefixes(shards, HOT)), "shard int, hot boolean, classes binary, sizes binary, tokens binary, owner binary")
    tasks = max(shards, spark.sparkContext.defaultParallelism)
    told = sent.repartition(tasks, "shard").mapInArrow(common.tidy(_shared(shards)), "bucket int, classes binary, sizes binary, tokens binary, ranks binary")
    ties = common.written(told.repartition(tasks, "bucket").mapInArrow(common.tidy(_ties), "token long, cls long"), "jaccard-ties")
    least = ties.groupBy("token").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most").drop("most")
    near = components(ties.join(least, "token").where("cls <> least").select(F.col("least").alias("u"), F.col("cls").alias("v")))
    # one document of each class to be searched, and its tasks
    members = near.withColumnRenamed("id", "cls").join(classes.where("doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("docs")), "cls")
    members = common.written(members, "jaccard-members")
    groups, chunks = _groups(members, ties)
    wanted = members.join(groups, "cls").select("doc_id", "cls", "docs", "ties", "groups")
    sets = common.map_tables(texts.join(wanted, "doc_id").select("text", "cls", "docs", "ties", "groups"), _sets, f"cls long, docs long, ties array<long>, groups array<{TASK}>, shingles binary", 4 << 20)
    dealt = sets.select("cls", "docs", "ties", "shingles", F.explode("groups").alias("task")).select("cls", "docs", "ties", "shingles", "task.*")
    folder = common.scratch(spark, "jaccard-sets")
    store, at = common.store(folder)
    store.create_dir(at, recursive=True)
    kinds = "cls long, least long, links long"
    found = common.written(dealt.repartition("group").sortWithinPartitions("group").mapInArrow(common.tidy(_search(folder)), kinds), "jaccard-links")
    pairs = _pairs(chunks)
    if not (many := pairs.count()):
        return found
    parts = max(spark.sparkContext.defaultParallelism, -(-many // PAIRS))
    met = pairs.repartition(parts, "first", "part").sortWithinPartitions("first", "part").mapInArrow(common.tidy(_search_chunks(folder)), kinds)
    return found.unionByName(common.written(met, "jaccard-links"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row."""
    return classified(docs).drop(SAME, "part")


def classified(docs: DataFrame) -> DataFrame:
    """The same, with a hash of the row's text as ``same``, and ``part``, one number for each component (null without words or id)."""
    common.arrow_limits(docs.sparkSession)
    texts = common.doc_bytes(docs, F.xxhash64("text").alias(SAME))
    classes = common.written(common.map_tables(texts, _classes, "doc_id long, n long, cls long", 4 << 20, [SAME]), "jaccard-classes")
    found = links(docs, classes)
    parts = components(found.where("cls <> least").select(F.col("least").alias("u"), F.col("cls").alias("v"))).withColumnsRenamed({"id": "cls", "component": "linked"})
    # a row a class; only then do documents meet it
    alike = classes.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.count("*").alias("alike"), F.min("doc_id").alias("first"))
    each = alike.join(found.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(parts, "cls", "left").withColumn("part", F.coalesce("linked", "cls"))
    smallest = each.groupBy("part").agg(F.min("first").alias("smallest"))
    each = each.join(smallest, "part").select("cls", "part", "smallest", (F.col("alike") - 1 + F.coalesce("links", F.lit(0))).alias("near"))
    whole = classes.join(each, "cls", "left")
    known = F.col("doc_id").isNotNull()
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("smallest", "doc_id")).alias("component_id"), F.when(known, F.coalesce("near", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links"), SAME, F.when(known, F.col("part")).alias("part"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.read_table(spark, sf_dir, "documents"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: From the rule: all pairs of rows that share a shingle are counted out.
OP9_SQL = f"""
with recursive docs as (
  select row_number() over () as r, cast(doc_id as bigint) as doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select distinct r, array_to_string(list_slice(w, i, i + {WIDTH} - 1), ' ') as x
  from docs, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) as t(i) where len(w) > 0),
sizes as (select r, count(*) as n from sets group by r),
known as (select * from sets semi join (select r from docs where doc_id is not null) using (r)),
shared as (select a.r as u, b.r as v, count(*) as c from known a join known b on a.x = b.x and a.r < b.r group by 1, 2),
links as (select u, v from shared join sizes a on a.r = u join sizes b on b.r = v where 100 * c >= {PERCENT} * (a.n + b.n - c)),
sides as (select u, v from links union all select v, u from links),
reach(r, s) as (select r, r from docs union select reach.r, v from reach join sides on s = u),
parts as (select reach.r, min(doc_id) as component_id from reach join docs on docs.r = s group by 1),
degrees as (select u as r, count(*) as n_links from sides group by 1)
select doc_id, coalesce(n, 0) as n_shingles, case when doc_id is not null then component_id end as component_id, coalesce(n_links, 0) as n_links
from docs join parts using (r) left join sizes using (r) left join degrees using (r)
"""
