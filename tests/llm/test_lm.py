import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from demeframe.llm import common, lm


def tokens(text):
    return [w.decode() for w in common.space_words((text or "").encode())] + ["</s>"]


def brute(rows, monkeypatch_discounts=lm.discounts):
    """The same model from plain dictionaries."""
    train = [tokens(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    uni, pairs = Counter(), Counter()
    for t in train:
        uni.update(t)
        pairs.update(zip(["<s>", *t], t))
    after, follow, kinds = Counter(), Counter(), {}
    for (u, w), c in pairs.items():
        after[w] += 1
        follow[u] += c
        kinds.setdefault(u, Counter())[min(c, 3)] += 1
    of = lambda values: lm.discounts(tuple(sum(v == k for v in values) for k in (1, 2, 3, 4)))
    d2, d1 = of(pairs.values()), of(after.values())
    total, v, n = len(pairs), len(uni), sum(uni.values())
    rest = sum(d1[min(a, 3)] for a in after.values()) / total / (v + 1) if total else 1.0

    def low(w):
        return max(after[w] - d1[min(after[w], 3)], 0) / max(1, total) + rest

    def p(u, w):
        if not follow[u]:
            return low(w)
        left = sum(d2[k] * m for k, m in kinds[u].items()) / follow[u]
        c = pairs[u, w]
        return max(c - d2[min(c, 3)], 0) / follow[u] + left * low(w)

    out = {}
    for d, t in rows:
        x = tokens(t)
        out[d] = (len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *x], x)))
    return out, p, uni, follow


def rows(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % int(rng.paretovariate(0.8))
    made = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(120)]
    return made + [(500, None), (501, ""), (502, " \n"), (503, "A a  B"), (None, "new words only here"), (505, "unseen-x unseen-y"), (506, "a b " * 400), (507, "a b " * 300)]


@pytest.mark.parametrize("shard", [32 << 20, 500])
def test_scores_match_brute_force(spark, make_docs, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard)
    data = rows(1)
    docs = make_docs(data).selectExpr("*", "1 as score", "2 as held_out").repartition(4)
    want, _, _, _ = brute(data)
    got = lm.language_model(docs).collect()
    assert len(got) == len(data)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3]) and r["score"] == pytest.approx(w[4])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_probabilities_sum_to_one():
    _, p, uni, follow = brute(rows(2))
    for u in [*list(follow)[:20], "<s>", "never seen"]:
        assert sum(p(u, w) for w in [*uni, "any other word"]) == pytest.approx(1)


def test_repeated_rows_and_empty_tables(spark, make_docs):
    one = next(i for i in range(100) if not lm.held_out(i))
    docs = make_docs([(one, "a b a"), (one, "a b a")])
    got = lm.language_model(docs).collect()
    assert [r["train_tokens"] for r in got] == [8, 8] and got[0]["score"] == got[1]["score"]
    assert lm.language_model(docs.limit(0)).count() == 0
    alone = next(i for i in range(100) if lm.held_out(i))
    r = lm.language_model(make_docs([(alone, "x y")])).collect()[0]
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_held_out_text_is_better_predicted_than_by_words(spark):
    df = lm.op3_kneser_ney(spark, "/root/testdata/sf0.001").where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert df["s"] > df["b"]


def test_discounts():
    assert lm.discounts((0, 0, 0, 0)).tolist() == [0, 0.75, 0.75, 0.75]
    d = lm.discounts((100, 40, 20, 12))
    assert 0 < d[1] < d[2] < d[3] < 3


def test_counts_beyond_32_bits(tmp_path, monkeypatch):
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"stageId": lambda self: 1, "taskAttemptId": lambda self: 2})())
    big = 5 << 32
    u, w, x = (np.array([v], np.uint64) for v in (11, 1 << 60, 99))
    key = np.sort(np.concatenate((lm.pair_hash(u, w), lm.pair_hash(u, x))))
    rows = [{"shard": 0, "words": np.concatenate((u, w, x)).tobytes(), "before": lm._packed(np.array([0, 0])), "after": lm._packed(np.array([1, 2])), "counts": np.array([big, 3], "<u8").tobytes(), "n": 2}]
    kinds = {"shard": pa.int32(), "n": pa.int32()}
    made = lm._pairs(str(tmp_path), 0, 0)(iter([pa.record_batch({k: pa.array([rows[0][k]], kinds.get(k, pa.binary())) for k in rows[0]})]))
    parts = [b for b in made]
    totals = [r[0].as_py().split("\t") for r in lm._words(str(tmp_path))(iter(parts)) for r in r.columns]
    assert ["pair", "2", str(big + 3), "0", "0", "1", "0"] in totals and sum(int(t[2]) for t in totals if t[0] == "word") == big + 3
    model = lm.Model(str(tmp_path), 0, 0, (2, big + 3, 0, 0, 1, 0), (3, big + 3, 2, 0, 0, 0))
    assert model.tokens == big + 3
    assert sorted(lm.pair_counts(model, key).tolist()) == [3, big]
    assert lm.look_up(model, np.concatenate((w, x, u)), "count", "after")[0].tolist() == [big, 3, 0]


def test_many_shards(spark, make_docs, monkeypatch):
    # most shards have no pair of a word in them
    data = rows(3)
    monkeypatch.setattr(lm, "SHARD_BYTES", 100)
    docs = make_docs(data).repartition(4)
    want, _, _, _ = brute(data)
    model = lm.train(docs, common.scratch(spark, "lm"))
    assert model.bits >= 6
    for r in lm.score(docs, model).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]][4])


def test_equal_texts_score_alike_and_very_long_texts(spark, make_docs):
    text = "some words that come again " * 60_000
    data = [(10, text), (11, "other words " * 3), (12, text), (13, "some words"), (14, "x" * 2_000_000), (15, "some words")]
    got = {r["doc_id"]: r for r in lm.language_model(make_docs(data).repartition(3)).collect()}
    want, _, _, _ = brute(data)
    assert got[10]["score"] == got[12]["score"] and got[13]["score"] == got[15]["score"] and got[10]["n_tokens"] == 300_001
    assert all(got[d]["score"] == pytest.approx(want[d][4]) for d, _ in data)
