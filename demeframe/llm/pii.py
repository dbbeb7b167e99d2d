"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

Patterns find entities (e-mail and IP addresses, card and phone numbers).  The
corpus then tells how strongly a word reveals an entity: with p(e|t) the share
of the contexts of word t that lie within NEAR words of entity e, the word
discloses e if PMI(e;t) >= ALPHA * IC(e), that is p(e|t) >= p(e)^(1 - ALPHA).
Such words are generalised, or removed where p(e|t) >= REMOVE.  Contexts are
distinct signatures of the SIDE words around an occurrence, so that copies of a
text count once.

Passes over the text, each one narrow: (1) entities, and (entity, word,
signature) near them; (2) signatures of the words that are near one entity at
least SUPPORT times; a word with more signatures in one task than any of its
entities allows is out at once and sends one row; (3) all spans.  Words
reach passes 2 and 3 as files of at most BLOCK words in the shared folder, which a task
goes through one after the other, so neither the driver nor a task holds them all.

Defined results.  Null text counts as empty: no spans.  Repeated rows give one
result each.  With no entity in the corpus there are no disclosing words.  Work is
linear in the text, also where it is all addresses or all @.
"""

from __future__ import annotations

import bisect
import io
import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
TERM, REMOVED = "term", "removed"
NEAR, SIDE = 8, 3
#: Distinct contexts with one entity from which a word is judged; the share of the entity's information that discloses it; from where on a word is removed.
SUPPORT, ALPHA, REMOVE = 3, 0.97, 0.9
#: Words in one file; signatures that a task holds before it sends them.
BLOCK, HELD = 200_000, 1_000_000
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't start inside a run of digits, as it would have started with the run.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; looks only around each @, so long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    low = 0  # behind the last @, which no local part holds
    while at >= 0:
        start = max(end, low) + len(text[max(end, low) : at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        low = at + 1
        at = text.find("@", max(low, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start, in code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """The value that spellings of one entity share."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(DIGIT.findall(value))}"


def _signature(words: list[bytes], i: int) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words[max(0, i - SIDE) : i + SIDE + 1])) - (1 << 63)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, signature) near entities; with the empty term, a count of words as the signature."""
    for table in common.by_bytes(batches, 4 << 20):
        rows: set[tuple[str, bytes, int]] = set()
        words_read = 0
        for raw in table.column("text").to_pylist():
            if not raw:
                continue
            text = raw.decode("utf-8", "replace")
            words_read += raw.count(b" ") + 1
            spans = base_spans(text)
            if not spans:
                continue
            places = [(m.start(), m.end()) for m in WORD.finditer(text)]
            words = [text[a:b].encode().translate(common.LOWER) for a, b in places]
            starts, ends = zip(*places, strict=True) if places else ((), ())
            taken = set()
            inside = []
            for kind, a, b in spans:
                own = range(bisect.bisect_right(ends, a), bisect.bisect_left(starts, b))
                taken.update(own)
                inside.append((entity(kind, text[a:b]), own))
            for name, own in inside:
                for i in range(max(0, own[0] - NEAR), min(len(words), own[-1] + NEAR + 1)) if own else ():
                    if i not in taken:
                        rows.add((name, words[i], _signature(words, i)))
        rows.add(("", b"", words_read))
        e, t, s = zip(*rows, strict=True)
        yield pa.record_batch({"entity": pa.array(e, pa.string()), "term": pa.array(t, pa.binary()), "signature": pa.array(s, pa.int64())})


def _write_blocks(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Files of at most BLOCK rows; the names carry the attempt, and only those of attempts that succeeded are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        held: list[pa.RecordBatch] = []

        def write(k: int) -> pa.RecordBatch:
            path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{k}"
            store, at = common.store(path)
            with store.open_output_stream(at) as f, pa.ipc.new_stream(f, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            held.clear()
            return pa.record_batch({"path": pa.array([path], pa.string())})

        number = itertools.count()
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) + batch.num_rows > BLOCK and held:
                yield write(next(number))
            held.append(batch)
        if held:
            yield write(next(number))

    return run


def word_blocks(words: DataFrame, name: str) -> list[str]:
    """Files with the rows of ``words`` (term, value)."""
    folder = common.scratch(words.sparkSession, name)
    store, at = common.store(folder)
    store.create_dir(at, recursive=True)
    return sorted(r[0] for r in words.mapInArrow(common.tidy(_write_blocks(folder)), "path string").collect())


@lru_cache(2)
def _block(path: str) -> dict[bytes, float]:
    store, at = common.store(path)
    with store.open_input_stream(at) as f:
        table = pa.ipc.open_stream(io.BytesIO(f.read())).read_all()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def _contexts(paths: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, signature) of the terms with limits in the files; a null signature puts a term out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, set[int]] = {}
        out: set[bytes] = set()

        def rows() -> Iterator[pa.RecordBatch]:
            found = [(w, None) for w in out] + [(w, s) for w, x in seen.items() for s in x]
            for i in range(0, len(found), 50_000):
                t, s = zip(*found[i : i + 50_000], strict=True)
                yield pa.record_batch({"term": pa.array(t, pa.binary()), "signature": pa.array(s, pa.int64())})
            seen.clear()
            out.clear()

        held = 0
        for table in common.by_bytes(batches, 4 << 20):
            texts = [common.alnum_words(raw or b"") for raw in table.column("text").to_pylist()]
            for path in paths:
                limit = _block(path)
                names = limit.keys()
                for words in texts:
                    here = (names & set(words)) - out
                    for i, w in enumerate(words) if here else ():
                        if w in here and w not in out:
                            mine = seen.setdefault(w, set())
                            held -= len(mine)
                            mine.add(_signature(words, i))
                            held += len(mine)
                            if len(mine) > limit[w]:
                                out.add(w)
                                held -= len(mine)
                                del seen[w]
            # what is sent twice counts once in the end
            if held + len(out) > HELD:
                yield from rows()
                held = 0
        yield from rows()

    return run


def disclosing(docs: DataFrame) -> DataFrame:
    """term and p, the largest p(e|t) among the entities it discloses."""
    spark = docs.sparkSession
    texts = common.doc_bytes(docs).select("text").where("text is not null")
    near = common.written(texts.mapInArrow(common.tidy(_near), "entity string, term binary, signature long"), "pii-near")
    total = near.where("entity = ''").agg(F.sum("signature")).first()[0] or 0
    pairs = near.where("entity <> ''").distinct().groupBy("entity", "term").agg(F.count("*").alias("n"))
    pairs = common.written(pairs, "pii-pairs")
    mentions = pairs.groupBy("entity").agg((F.sum("n") / (2 * NEAR)).alias("mentions"))
    chance = F.least(F.lit(1.0), F.greatest(F.col("mentions"), F.lit(1.0)) / F.lit(float(max(1, total))))
    judged = pairs.where(F.col("n") >= SUPPORT).join(mentions, "entity").select("entity", "term", "n", F.pow(chance, F.lit(1 - ALPHA)).alias("least"))
    judged = common.written(judged, "pii-judged")
    limits = word_blocks(judged.groupBy("term").agg(F.max(F.floor(F.col("n") / F.col("least"))).alias("most")), "pii-limits")
    if not limits:
        return spark.createDataFrame([], "term binary, p double")
    counted = texts.mapInArrow(common.tidy(_contexts(limits)), "term binary, signature long")
    # a term that one task put out is out; else its distinct signatures count
    contexts = counted.groupBy("term").agg(F.count_distinct("signature").alias("contexts"), F.max(F.col("signature").isNull()).alias("out")).where("not out")
    p = F.least(F.lit(1.0), F.col("n") / F.col("contexts"))
    return judged.join(contexts, "term").where(p >= F.col("least")).groupBy("term").agg(F.max(p).alias("p"))


def _spans(paths: list[str], clean: bool) -> Callable[[pa.Table], pa.Table]:
    """Base spans, then those of the terms in the files.

    With ``clean`` terms from REMOVE on are marked as such, and the text comes out sanitised.
    """

    def run(table: pa.Table) -> pa.Table:
        raws = table.column("text").to_pylist()
        texts = [(raw or b"").decode("utf-8", "replace") for raw in raws]
        found = [base_spans(t) for t in texts]
        base = [_merged(x) for x in found]
        terms: list[list[tuple[str, int, int]]] = [[] for _ in raws]
        for path in paths:
            block = _block(path)
            for k, raw in enumerate(raws):
                if not raw or block.keys().isdisjoint(common.alnum_words(raw)):
                    continue
                starts, ends = base[k]
                for m in WORD.finditer(texts[k]):
                    p = block.get(m[0].encode().translate(common.LOWER))
                    # the first base span that ends behind the word's start
                    at = bisect.bisect_right(ends, m.start()) if p is not None else 0
                    if p is not None and (at == len(starts) or starts[at] >= m.end()):
                        terms[k].append((REMOVED if clean and p >= REMOVE else TERM, m.start(), m.end()))
        out = [b + sorted(t, key=lambda x: x[1:]) for b, t in zip(found, terms, strict=True)]
        if clean:
            raws = [sanitise(t, s).encode() if s else r for r, t, s in zip(raws, texts, out, strict=True)]
        shown = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in out]
        return pa.table({"doc_id": table.column("doc_id"), "text": pa.array(raws, pa.binary()), "spans": pa.array(shown, pa.list_(SPAN))})

    return run


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(x[1:] for x in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find_spans(docs: DataFrame, terms: DataFrame | None = None, carry: Sequence[str] = (), clean: bool = False) -> DataFrame:
    """doc_id, text as bytes, and spans (kind, start, end in code points): base kinds, then ``terms`` (by default the disclosing ones).

    With ``clean`` the text comes out sanitised; ``carry`` names columns to keep.
    """
    common.arrow_limits(docs.sparkSession)
    paths = word_blocks(disclosing(docs) if terms is None else terms, "pii-terms")
    return common.map_tables(common.doc_bytes(docs, *carry), lambda: _spans(paths, clean), "doc_id long, text binary, spans array<struct<kind:string,start:long,end:long>>", 4 << 20, carry)


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with entities labelled and disclosing terms generalised or removed; overlapping spans are merged under the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a < at:
            at = max(at, b)
            continue
        if kind == REMOVED:
            label = ""
        elif kind == TERM:
            word = text[a:b]
            label = "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"
        else:
            label = LABELS[kind]
        out += [text[at:a], label]
        at = b
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the sanitised text, and the columns named in ``carry``."""
    return find_spans(docs, carry=carry, clean=True).select("doc_id", F.col("text").cast("string").alias("text"), *carry)


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, all spans as text, and the text without what they hold; ``found`` has the sanitised text."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(*KINDS)), text), ",")
    return found.select("doc_id", *map(of, KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"), F.col("text").cast("string").alias("sanitised"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_spans(common.read_table(spark, sf_dir, "documents"), clean=True))
