import hashlib
import random

import public_tokenizers
import pytest

from demeframe.llm import bpe


@pytest.fixture(scope="module")
def small():
    return bpe.ByteBPE(public_tokenizers.path(bpe.RANKS), chunk=40, overlap=12)


ALPHABET = ["a", "b", "the", " ", " ", "  ", "\n", "'ll", "'s", "'", "1", "23", "é", "日本", "!", "?!", "\t", " ", "👩‍👩‍👧", "\x1c", "ﬀ", "़"]


def test_stitched_chunks_equal_whole_text(small):
    rng = random.Random(4)
    for k in range(1500):
        text = "".join(rng.choice(ALPHABET[: 2 + k % len(ALPHABET)]) for _ in range(rng.randrange(300)))
        assert small.encode(text) == small.merges.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 500, " " * 500, "a" * 300 + " b" * 90 + "!" * 300, "x" * 39 + "'ll" + "y" * 99, " \n" * 200 + "z"])
def test_long_runs(small, text):
    ids = small.encode(text)
    assert ids == small.merges.encode_ordinary(text) and small.decode(ids) == text.encode()


def test_unknown_ids_raise(small):
    with pytest.raises(IndexError):
        small.decode([10**6])
    with pytest.raises(IndexError):
        small.decode([-1])


def test_table(spark, make_docs):
    rows = ["Hello  world\n", None, "", "Hello  world\n", "ñ " * 20_000]
    docs = make_docs(rows).selectExpr("*", "1 as ids")
    reference = bpe.tokenizer(public_tokenizers.path(bpe.RANKS)).merges
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    for i, t in enumerate(rows):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r[0]: bytes(r[1]) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(rows)}
    assert bpe.encode(docs.limit(0)).count() == 0
