"""Token ids as length-delimited binary records, with a separate offset index.

Record: payload length (u64), its masked CRC-32C (u32), payload, the payload's
masked CRC-32C (u32); all little-endian.  Payload: doc_id (i64; the smallest
i64 stands for null) and the ids, as u16 where the vocabulary allows and else
u32.  Index, one entry a record: doc_id (i64), offset (u64), number of ids (u64),
so a reader can fetch records in any order.

Texts are range-partitioned by doc_id and place in the table and sorted, so that rows
with one doc_id may take several ranges; then each task encodes its
range and writes one file pair.  File names carry the task attempt, and only the
pairs of attempts that succeeded are listed, so retries and lost executors leave
at most unlisted files.  The list has one row a file; positions in front of each
file are sums over it.  Files go to the folder that the session shares, through
pyarrow's file systems, so it need not be a mounted one.

Defined results.  Null text counts as empty.  The text of a special token is that
token, as in the library's plain call.  Rows that repeat a doc_id are all
written, in the order of the table; null ids come first.  An empty table writes no file.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .crc32c import crc32c, masked

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
NO_ID = -(1 << 63)
#: Slots of the table of units that a worker remembers (32 bytes each), the most of them in use, and the most ids kept for them.
SLOTS, FULL, KEPT_IDS = 1 << 22, 0.6, 1 << 25
#: Longer units aren't remembered; a key has a unit's bytes and its length.
LONGEST = 23
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])
FILES = "part int, records string, index string, n_records long, n_tokens long, width int"


_WHITE, _ALNUM, _MARK, _SOLID, _HIGH = 1, 2, 3, 4, 5


def _class_of(b: int) -> int:
    c = chr(b)
    if b in (9, 10, 11, 12, 13, 32):
        return _WHITE
    if b >= 128:
        return _HIGH
    return _ALNUM if c.isalnum() else _MARK if c in ".,;:!?" else _SOLID if 33 <= b <= 126 else 0


CLASS_TABLE = np.array([_class_of(b) for b in range(256)], np.uint8)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each byte for certain, whatever stands around it.

    It does where white space follows anything else, and where a mark follows an ASCII
    letter or digit.  Behind characters that share their first bytes with white space beyond ASCII nothing is certain.
    """
    kind = CLASS_TABLE[data]
    out = np.zeros(len(data), bool)
    before, here = kind[:-1], kind[1:]
    out[1:] = (here == _WHITE) & (before >= _ALNUM) | (here == _MARK) & (before == _ALNUM)
    at = np.flatnonzero((here == _WHITE) & (before == _HIGH)) + 1
    lead, middle = data[np.maximum(at - 3, 0)], data[np.maximum(at - 2, 0)]
    doubt = (middle == 0xC2) | np.isin(lead, (0xE1, 0xE2, 0xE3)) & np.isin(middle, (0x80, 0x81, 0x9A))
    out[at[doubt]] = False
    return out


class UnitTable:
    """Ids of byte strings of 1 to LONGEST bytes: an open-addressed table in arrays, asked for many at once, exact.

    A slot has the string's bytes and length in three words, and in a fourth where its ids start and how many there are.
    """

    def __init__(self, kind: np.dtype, slots: int = SLOTS) -> None:
        self.kind, self.least = kind, slots
        self.clear()

    def clear(self) -> None:
        self.slots = self.least
        self.rows = np.zeros((self.slots, 4), np.uint64)
        self.ids = np.empty(1 << 16, self.kind)
        self.used = self.n_ids = 0

    def add_ids(self, ids: np.ndarray) -> int:
        """Where they stand from now on."""
        at = self.n_ids
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(max(len(self.ids), len(ids)), self.kind)))
        self.ids[at : at + len(ids)] = ids
        self.n_ids += len(ids)
        return at

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (keys[:, 0] ^ keys[:, 1] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 2] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fourth words of the strings, and which are not here."""
        at, mine, left = self.slot(keys), keys, np.arange(len(keys))
        out, lost = np.zeros(len(keys), np.uint64), [np.empty(0, np.int64)]
        while len(left):
            rows = self.rows.take(at, 0)
            hit = (rows[:, 0] == mine[:, 0]) & (rows[:, 1] == mine[:, 1]) & (rows[:, 2] == mine[:, 2])
            out[left] = rows[:, 3] * hit
            other = np.flatnonzero(~hit)
            free = rows[other, 2] == 0
            lost.append(left[other[free]])
            other = other[~free]
            at, mine, left = (at[other] + 1) & (self.slots - 1), mine[other], left[other]
        return out, np.concatenate(lost)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct strings that aren't here; a text with more of them than the table has room for makes it wider."""
        if self.used + len(keys) > 0.9 * self.slots:
            old = self.rows[self.rows[:, 2] > 0]
            while self.used + len(keys) > FULL * self.slots:
                self.slots *= 2
            self.rows, self.used = np.zeros((self.slots, 4), np.uint64), 0
            self.add(old[:, :3], old[:, 3])
        at, left = self.slot(keys), np.arange(len(keys))
        self.used += len(keys)
        while len(left):
            free = left[self.rows[at[left], 2] == 0]
            _, first = np.unique(at[free], return_index=True)
            now = free[first]
            self.rows[at[now], :3], self.rows[at[now], 3] = keys[now], values[now]
            left = np.setdiff1d(left, now, assume_unique=True)
            at[left] = (at[left] + 1) & (self.slots - 1)


class UnitTokenizer:
    """Ids of texts, as packed bytes, from the library's ids of the texts' units.

    A text is cut where pre-tokens start for certain (:func:`unit_starts`), so its ids are
    those of its units in a row; the library is called for units that the worker doesn't
    remember.  A text with an added token's text, which the library makes that token wherever it stands, is
    encoded whole, and so is every text where the tokenizer splits texts by another rule.
    """

    def __init__(self, path: str, slots: int = SLOTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = rules["pre_tokenizer"] or {}
        self.in_units = rules["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not any(a.split() != [a] for a in self.added)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        #: Bytes of each token: its name has a character a byte.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        self.table = UnitTable(self.kind, slots if self.in_units else 1)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(many.sum())), many

    def _joined(self, units: list[bytes], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that start with white space and end with something else: encoded many in one text, and parted by their bytes."""
        flat, _ = self._flat([b"".join(units[i : i + together]).decode() for i in range(0, len(units), together)])
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        return flat, np.diff(np.searchsorted(np.cumsum(self.sizes[flat]), ends) + 1, prepend=0)

    def _learn(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keeps the ids of distinct units; where they start, and how many they are."""
        ends = starts + sizes
        raw = np.frombuffer(data, np.uint8)
        joins = (CLASS_TABLE[raw[starts]] == _WHITE) & (raw[ends - 1] >= 33) & (raw[ends - 1] <= 126)
        place, many = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        for which, own in ((np.flatnonzero(joins), True), (np.flatnonzero(~joins), False)):
            units = [data[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
            ids, n = self._joined(units) if own else self._flat([u.decode() for u in units])
            many[which], place[which] = n, self.table.add_ids(ids) + np.cumsum(n) - n
        return place, many

    def encode(self, texts: list[bytes]) -> list[bytes]:
        texts = [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]
        whole = [k for k, t in enumerate(texts) if not self.in_units or any(a in t for a in self.added)]
        flat, many = self._flat([texts[k].decode() for k in whole])
        apart = dict(zip(whole, np.split(flat, np.cumsum(many)[:-1]), strict=True)) if whole else {}
        if self.table.used > FULL * self.table.slots or self.table.n_ids > KEPT_IDS:
            self.table.clear()
        length = np.array([0 if k in apart else len(t) for k, t in enumerate(texts)], np.int64)
        begin = np.cumsum(length) - length
        raw = b"".join(t for k, t in enumerate(texts) if k not in apart)
        data = np.frombuffer(raw + bytes(LONGEST + 1), np.uint8)
        cut = unit_starts(data[: len(raw)])
        cut[begin[length > 0]] = True
        starts = np.flatnonzero(cut)
        at, many = self._units(raw, data, starts, np.diff(starts, append=len(raw)))
        end = np.cumsum(many)
        ids = self.table.ids[np.repeat(at - end + many, many) + np.arange(int(many.sum()))]
        edges = np.searchsorted(starts, np.append(begin, len(raw)))
        stop = np.concatenate(([0], end))[edges].tolist()
        return [apart[k].tobytes() if k in apart else ids[i:j].tobytes() for k, (i, j) in enumerate(itertools.pairwise(stop))]

    def _units(self, raw: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit, where its ids start and how many they are."""
        at, many = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        n, s = sizes[short], starts[short]
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = np.empty((len(short), 3), np.uint64)
        for k in range(3):
            keys[:, k] = words[np.minimum(s + 8 * k, len(words) - 1)] & _LOW_BYTES[np.clip(n - 8 * k, 0, 8)] if (n > 8 * k).any() else 0
        keys[:, 2] |= n.astype(np.uint64) << np.uint64(56)
        while True:
            values, lost = self.table.find(keys)
            if not len(lost):
                break
            # one of each home slot; those that share it with another string come next time
            _, first = np.unique(self.table.slot(keys[lost]), return_index=True)
            new = lost[first]
            place, size = self._learn(raw, s[new], n[new])
            self.table.add(keys[new], place.astype(np.uint64) << np.uint64(16) | size.astype(np.uint64))
        at[short], many[short] = (values >> np.uint64(16)).astype(np.int64), (values & np.uint64(0xFFFF)).astype(np.int64)
        long = np.flatnonzero(sizes > LONGEST)
        if len(long):
            kinds: dict[bytes, int] = {}
            which = [kinds.setdefault(raw[a : a + m], len(kinds)) for a, m in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
            ids, size = self._flat([u.decode() for u in kinds])
            place = self.table.add_ids(ids) + np.cumsum(size) - size
            at[long], many[long] = place[which], size[which]
        return at, many


@lru_cache(2)
def unit_tokenizer(path: str) -> UnitTokenizer:
    """One for each worker process, so that what it remembers serves later tasks."""
    return UnitTokenizer(path)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records in a row, and where each starts."""
    sizes = np.array([len(p) for p in payloads], "<u8")
    heads = [s.tobytes() for s in sizes]
    head_crc, body_crc = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    out = b"".join(x for h, a, p, b in zip(heads, head_crc, payloads, body_crc, strict=True) for x in (h, a.tobytes(), p, b.tobytes()))
    lengths = sizes.astype(np.int64) + 16
    return out, np.cumsum(lengths) - lengths


def unframe(data: bytes, starts: np.ndarray) -> list[bytes]:
    """The payloads of whole records at ``starts``; raises on a wrong checksum."""
    payloads, heads, sums = [], [], []
    for s in starts.tolist():
        n = int.from_bytes(data[s : s + 8], "little")
        if s + 16 + n > len(data):
            raise ValueError(f"a record is cut off at {s}")
        heads.append(data[s : s + 8])
        payloads.append(data[s + 12 : s + 12 + n])
        sums.append((data[s + 8 : s + 12], data[s + 12 + n : s + 16 + n]))
    want = np.frombuffer(b"".join(a + b for a, b in sums), "<u4").reshape(-1, 2)
    if (masked(crc32c(heads)) != want[:, 0]).any() or (masked(crc32c(payloads)) != want[:, 1]).any():
        raise ValueError("a record's checksum is wrong")
    return payloads


def _writer(folder: str, path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        store, at = common.store(folder)
        name = f"part-{part:06d}-{task.taskAttemptId()}"
        files = None
        offset = records = tokens = 0
        units = None
        for table in common.by_bytes(batches, 4 << 20):
            if not table.num_rows:
                continue
            units = units or unit_tokenizer(path or public_tokenizers.path(TOKENIZER))
            if files is None:
                files = (store.open_output_stream(f"{at}/{name}.rec"), store.open_output_stream(f"{at}/{name}.idx"))
            width = units.kind.itemsize
            end = np.array([END_ID], units.kind).tobytes()
            ids = [x + end for x in units.encode([t or b"" for t in table.column("text").to_pylist()])]
            names = [NO_ID if d is None else d for d in table.column("doc_id").to_pylist()]
            data, starts = frame([d.to_bytes(8, "little", signed=True) + x for d, x in zip(names, ids, strict=True)])
            entries = np.empty(len(ids), INDEX)
            entries["doc_id"], entries["offset"], entries["n_tokens"] = names, starts + offset, [len(x) // width for x in ids]
            files[0].write(data)
            files[1].write(entries.tobytes())
            offset += len(data)
            records += len(ids)
            tokens += int(entries["n_tokens"].sum())
        if files is not None:
            for f in files:
                f.close()
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            row = [part, f"{folder}/{name}.rec", f"{folder}/{name}.idx", records, tokens, units.kind.itemsize]
            yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in FILES.split(", ")])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer_path: str | None = None) -> DataFrame:
    """Writes all documents in order of doc_id; returns the list of files with ``start``, the ids in front of each."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    store, at = common.store(folder)
    store.create_dir(at, recursive=True)
    dealt = common.doc_bytes(docs, F.monotonically_increasing_id().alias("place")).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    # one row a file: computed once, here, as its side effect is the files
    files = sorted(dealt.mapInArrow(_writer(folder, tokenizer_path), FILES).collect())
    start = itertools.accumulate((r["n_tokens"] for r in files), initial=0)
    return spark.createDataFrame([(*r, s) for r, s in zip(files, start, strict=False)], FILES + ", start long")


def read_index(row: dict) -> np.ndarray:
    store, at = common.store(row["index"])
    with store.open_input_stream(at) as f:
        return np.frombuffer(f.read(), INDEX)


def read_records(files: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """Per record: doc_id, start, n_tokens and ids_crc32, read back and verified.

    A file is read in parts of about ``part_bytes``, found by its index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            index = read_index(row)
            count = index["n_tokens"].astype(np.int64)
            start = np.cumsum(count) - count + row["start"]
            ends = np.append(index["offset"][1:], index["offset"][-1] + np.uint64(24 + row["width"] * int(count[-1]))).astype(np.int64)
            store, at = common.store(row["records"])
            kind = f"<u{row['width']}"
            with store.open_input_file(at) as f:
                i = 0
                while i < len(index):
                    first = int(index["offset"][i])
                    j = max(i + 1, int(np.searchsorted(ends, first + part_bytes, "right")))
                    data = f.read_at(int(ends[j - 1]) - first, first)
                    payloads = unframe(data, index["offset"][i:j].astype(np.int64) - first)
                    ids = [np.frombuffer(p, kind, offset=8) for p in payloads]
                    names = [int.from_bytes(p[:8], "little", signed=True) for p in payloads]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array([None if d == NO_ID else d for d in names], pa.int64()),
                            "start": pa.array(start[i:j], pa.int64()),
                            "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        }
                    )
                    i = j

    many = files.repartition(max(1, min(files.count(), 2 * files.sparkSession.sparkContext.defaultParallelism, 10_000)))
    return many.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the records of all documents and returns what reading them back gives."""
    files = write_records(common.read_table(spark, sf_dir, "documents"), common.scratch(spark, "records"))
    return read_records(files)
