import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from demeframe.llm import common, records
from demeframe.llm.crc32c import crc32c, masked


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    rng = random.Random(1)
    data = [rng.randbytes(rng.choice([0, 1, 2, 3, 511, 512, 513, 3000])) for _ in range(50)] + [b"123456789"]
    assert crc32c(data).tolist() == [slow_crc32c(x) for x in data]
    assert crc32c(data)[-1] == 0xE3069283
    assert crc32c([]).tolist() == []
    assert masked(np.array([0], np.uint32))[0] == 0xA282EAD8


def library():
    """Unaltered, and apart from the operator's own."""
    return Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))


def as_lists(units, texts):
    return [np.frombuffer(x, units.kind).tolist() for x in units.encode([t.encode() for t in texts])]


ALPHABET = ["a", "Be", " ", " ", ".", "?!", " ", "  ", "\n", "'ll", "1", "\u00e9", "\u65e5", "!", "\t", " ", "<|endoftext|>", "\u3000", "x y", "\x1c", "\0", "\xa0", "\u2003", "\x85", "\u2026", "\u201d", "\u2029", "'s", "'", "\r\n", "a" * 30, "\u200b", "\u0663", "\u00b2", "\x7f", "\U0001f600", "\u00ad"]


@pytest.mark.parametrize("slots", [16, 1 << 9, 1 << 16])
def test_units_equal_whole_texts(slots):
    # with few slots the table widens within a batch and is cleared between them
    units, plain, rng = records.UnitTokenizer(public_tokenizers.path(records.TOKENIZER), slots), library(), random.Random(slots)
    for _ in range(6):
        texts = ["".join(rng.choice(ALPHABET[: 2 + rng.randrange(len(ALPHABET))]) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "  ", "\n", "a ", " a"]
        assert as_lists(units, texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_very_long_texts():
    units, plain = records.UnitTokenizer(public_tokenizers.path(records.TOKENIZER), 1 << 10), library()
    texts = ["one two, three\n\n four.  " * 4_000, "x" * 30_000, " " * 30_000, "".join(f"w{i} " for i in range(20_000)), "\n".join(["y" * 40] * 500)]
    assert as_lists(units, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    units, plain = records.UnitTokenizer(path), Tokenizer.from_file(path)
    texts = ["One two, three.", "", " a  b "]
    assert not units.in_units and as_lists(units, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_unit_table_is_exact():
    table, rng = records.UnitTable(np.dtype("<u2"), 64), random.Random(4)
    strings = list({bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(1, 24))) for _ in range(3000)})
    keys = np.array([np.frombuffer(x + bytes(23 - len(x)) + bytes([len(x)]), "<u8") for x in strings])
    for i in range(0, 2000, 500):
        table.add(keys[i : i + 500], np.arange(i, i + 500, dtype=np.uint64))
    values, lost = table.find(keys)
    assert values[:2000].tolist() == list(range(2000)) and sorted(lost.tolist()) == list(range(2000, len(strings)))


def test_special_tokens_as_in_the_plain_call():
    units, plain = records.UnitTokenizer(public_tokenizers.path(records.TOKENIZER), 1 << 10), library()
    texts = ["<|endoftext|>", "a<|endoftext|>b c", "one <|endoftext|>\ntwo. <|endoftext|>", "<|endoftext|> ", "plain words, no token", "<|endoftext", "|> <|endof text|>"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [50256]
    # a second time from what is remembered
    for _ in range(2):
        assert as_lists(units, texts) == want


def test_special_token_in_records(spark, make_docs):
    plain = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    texts = ["a b", "end <|endoftext|> of text", "c"]
    got = records.read_records(records.write_records(make_docs(texts), common.scratch(spark, "records"))).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, texts, strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_frames_detect_damage():
    data, starts = records.frame([b"", b"abc", b"x" * 1000])
    assert records.unframe(data, starts) == [b"", b"abc", b"x" * 1000]
    for at in (0, 9, int(starts[1]) + 13, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), starts)
    with pytest.raises(ValueError):
        records.unframe(data[:-1], starts)


def test_round_trip(spark, make_docs):
    plain = library()
    rows = [(i * 7 % 40, f"text {i}  of\nwords " * (i % 5)) for i in range(40)] + [(3, f"again {i}") for i in range(30)] + [(None, "no id"), (90, None), (91, "")]
    docs = make_docs(rows).selectExpr("*", "1 as start", "2 as place").repartition(5)
    files = records.write_records(docs, common.scratch(spark, "records"))
    got = records.read_records(files, part_bytes=100).orderBy("start").collect()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    want = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids, strict=True)]
    order = lambda x: (x[0] is not None, x)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=order) == sorted(want, key=order)
    assert sum(len(records.read_index(f.asDict())) for f in files.collect()) == len(rows)


def test_one_doc_id_takes_several_files(spark, make_docs):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        files = records.write_records(make_docs([(7, f"text {i}") for i in range(400)]).repartition(4), common.scratch(spark, "records"))
    finally:
        spark.conf.unset(key)
    assert files.count() > 1


def test_empty_table(spark, make_docs):
    files = records.write_records(make_docs(["a"]).limit(0), common.scratch(spark, "records"))
    assert records.read_records(files).count() == 0
