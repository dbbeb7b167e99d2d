"""Byte-level BPE encoding and decoding with a public rank file.

A text longer than one chunk is cut into overlapping chunks, which threads
pre-tokenise side by side.  A match starting at a place depends only on the
text from there on; so where the chunk before and the next chunk both have a
boundary in their overlap, they agree from that boundary on, and the stitched
boundaries are those of the whole text.  Where an overlap holds no common
boundary (one match covers it all), the chunk before runs on.  The pieces
between boundaries are then encoded, once for each distinct piece that a worker
still remembers.  Decoding concatenates the bytes of the ids.

One scan without a shuffle.  The rank file is read on each worker.

Defined results.  Null text is encoded as empty: no ids.  Bytes that aren't
UTF-8 become U+FFFD, as in Python.  Decoding an id outside the vocabulary
raises.  Repeated rows give one result each; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk and of what it shares with the next.
CHUNK, OVERLAP = 16_384, 1_024
#: Characters before a chunk's end within which a match might have gone on or come out otherwise.
MARGIN = 4
#: Distinct pieces that a worker remembers.
REMEMBERED = 150_000


class _Pieces(dict):
    """Ids of each piece; forgets all when full, so its size is bounded."""

    def __init__(self, encode: Callable[[bytes], list[int]], size: int) -> None:
        self.encode = encode
        self.shared = list(range(size))  # one object an id

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(map(self.shared.__getitem__, self.encode(piece.encode())))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, ranks_path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 2) -> None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(self.merges._encode_single_piece, max(ranks.values()) + 1)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.chunk, self.overlap, self.threads = chunk, overlap, threads

    def _ends(self, text: str, start: int, stop: int) -> list[int]:
        """``start`` and the ends of matches from there that the cut at ``stop`` can't change."""
        ends = [start, *(m.end() for m in self.pattern.finditer(text, start, stop, concurrent=True))]
        if stop < len(text):
            del ends[bisect.bisect_right(ends, stop - MARGIN) :]
        return ends

    def boundaries(self, text: str) -> list[int]:
        """Pre-token boundaries of the whole text, from overlapping chunks."""
        starts = list(range(0, max(1, len(text) - self.overlap), self.chunk))
        spans = [(a, min(len(text), a + self.chunk + self.overlap)) for a in starts]
        if len(spans) == 1:
            return self._ends(text, *spans[0])
        with ThreadPoolExecutor(self.threads) as pool:
            chunks = list(pool.map(lambda x: self._ends(text, *x), spans))
        out = chunks[0]
        for k in range(1, len(chunks)):
            nxt, common_at = chunks[k], None
            while common_at is None:
                have = set(nxt)
                common_at = next((i for i in range(bisect.bisect_left(out, nxt[0] if nxt else len(text)), len(out)) if out[i] in have), None)
                if common_at is None:
                    if out[-1] >= (spans[k + 1][0] if k + 1 < len(spans) else len(text)):
                        break  # it ran on over all of this chunk that the next doesn't have as well
                    more, reach = [], self.chunk + self.overlap
                    while len(more) < 2 and out[-1] < len(text):
                        more = self._ends(text, out[-1], min(len(text), out[-1] + reach))
                        reach *= 2
                    out += more[1:]
            if common_at is not None:
                out[common_at:] = nxt[bisect.bisect_left(nxt, out[common_at]) :]
        return out

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk + self.overlap:
            pieces = self.pattern.findall(text)
        else:
            at = self.boundaries(text)
            pieces = [text[a:b] for a, b in itertools.pairwise(at)]
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise IndexError("a negative id")
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


@lru_cache(2)
def tokenizer(ranks_path: str) -> ByteBPE:
    return ByteBPE(ranks_path)


def _text(b: bytes | None) -> str:
    return (b or b"").decode("utf-8", "replace")


def _ids_array(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.int32), *rows])
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32), flat)


def encode(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>)."""
    common.arrow_limits(docs.sparkSession)

    def make() -> Callable[[pa.Table], pa.Table]:
        bpe = tokenizer(ranks_path or public_tokenizers.path(RANKS))
        return lambda t: pa.table({"doc_id": t.column("doc_id"), "ids": _ids_array([np.array(bpe.encode(_text(x)), np.int32) for x in t.column("text").to_pylist()])})

    return common.map_tables(common.doc_bytes(docs), make, "doc_id long, ids array<int>", 4 << 20)


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and bytes, from doc_id and ids."""
    common.arrow_limits(encoded.sparkSession)

    def run(batches):
        bpe = tokenizer(ranks_path or public_tokenizers.path(RANKS))
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "bytes": pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Digests of the ids and of what they decode to, both made in the task that encodes; with ``with_ids`` the ids too."""
    common.arrow_limits(docs.sparkSession)

    def make() -> Callable[[pa.Table], pa.Table]:
        bpe = tokenizer(ranks_path or public_tokenizers.path(RANKS))

        def run(table: pa.Table) -> pa.Table:
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in table.column("text").to_pylist():
                ids = bpe.encode(_text(text))
                n.append(len(ids))
                if with_ids:
                    kept.append(np.array(ids, np.int32))
                ids_sha.append(bpe.digest(ids))
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            out = pa.table({"doc_id": table.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())})
            return out.append_column("ids", _ids_array(kept)) if with_ids else out

        return run

    return common.map_tables(common.doc_bytes(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, 4 << 20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read_table(spark, sf_dir, "documents"))
