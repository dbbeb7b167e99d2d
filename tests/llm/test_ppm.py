import math
import random
import zlib
from collections import Counter

import numpy as np

from demeframe.llm import ppm


def brute_bits(training, text):
    """PPM, escape method C, counted with plain dictionaries."""
    seen = [Counter() for _ in range(ppm.ORDER + 1)]
    for t in training:
        padded = ppm.START + t.lower()
        for i in range(ppm.ORDER, len(padded)):
            for o in range(ppm.ORDER + 1):
                seen[o][padded[i - o : i + 1]] += 1
    padded, total = ppm.START + text.lower(), 0.0
    for i in range(ppm.ORDER, len(padded)):
        for o in range(ppm.ORDER, -2, -1):
            if o < 0:
                total += 8
                break
            context = padded[i - o : i]
            after = {k: n for k, n in seen[o].items() if k[:o] == context}
            t, d, n = sum(after.values()), len(after), after.get(padded[i - o : i + 1], 0)
            if n:
                total += math.log2((t + d) / n)
                break
            if t:
                total += math.log2((t + d) / d)
    return total


def tree(training):
    g, _ = ppm.grams(training)
    return np.unique(g, return_counts=True)


def test_code_lengths_match_brute_force():
    rng = random.Random(1)
    text = lambda n: bytes(rng.choice(b"abcAB \xc3\xa9\x00") for _ in range(rng.randrange(n)))
    training = {"x": [text(40) for _ in range(5)], "y": [text(40) for _ in range(3)] + [b"zz"]}
    model = ppm.Model({k: tree(v) for k, v in training.items()})
    tests = [text(30) for _ in range(20)] + [b"", b"qqq\xff"]
    for _ in range(2):  # with and without what is remembered
        got = model.code_lengths(tests)
        for row, t in zip(got, tests, strict=True):
            for value, lang in zip(row, model.langs, strict=True):
                assert abs(value - brute_bits(training[lang], t)) < 1e-9 * (1 + value)


def test_slots_shared_by_grams():
    model = ppm.Model({"x": tree([b"the cat sat on the mat and more of this"])})
    model.slots = 4096
    model.keys, model.costs = np.full(4096, -1, np.int64), np.zeros((1, 4096))
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, 3000).astype(np.uint8).tobytes() for _ in range(8)]
    want = np.array([model.trees[0].bits(ppm.grams([t])[0]).sum() for t in texts])
    for _ in range(2):
        assert np.allclose(model.code_lengths(texts)[:, 0], want, rtol=1e-12)


def test_grams():
    g, cut = ppm.grams([b"", b"Ab", b"", b"c"])
    assert [x.to_bytes(4, "big") for x in g.tolist()] == [b"\n\n\na", b"\n\nab", b"\n\n\nc"] and cut.tolist() == [0, 0, 2, 2, 3]
    assert len(ppm.grams([])[0]) == len(ppm.grams([b""])[0]) == 0


WORDS = {"aa": "wind water stone light river".split(), "bb": "čaj noc ulice strom hrad".split()}


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=20)), lang) for i in range(150) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (None, "wind", "zz"), (1003, "river", None), (1003, "river", None), (1004, "нет", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = ppm.language(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, _, lang in rows[:150]:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and by[i]["lang_pred"] == lang and 0 <= by[i]["score"] <= 1
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003]["lang_pred"] == "aa" and by[1004]["lang_pred"] in WORDS and by[None]["held_out"] is False
    assert all(r["lang_pred"] == "und" for r in ppm.language(docs.where("lang is null")).collect())
    assert ppm.language(docs.limit(0)).count() == 0


def test_all_counted_grams_reach_the_model(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789.,;:-+ "
    # more distinct n-grams in one language than 200,000
    texts = ["".join(rng.choices(letters, k=3000)) for _ in range(140)] + ["plain words of a text " * 20]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1000, "another language here " * 30, "y")], "doc_id long, text string, lang string")
    trained = [r["text"].encode() for r in ppm.training_rows(docs).where("lang = 'x'").collect()]
    assert len(tree(trained)[0]) > 200_000
    model = ppm.Model({"x": tree(trained)})
    got = {r["doc_id"]: r for r in ppm.predict(docs, ppm.train(ppm.training_rows(docs))).collect()}
    for i in (0, 1, 70, 139):
        want = model.code_lengths([texts[i].encode()])[0, 0] / len(texts[i])
        assert got[i]["lang_pred"] == "x" and abs(got[i]["bits_per_byte"] - want) < 1e-9


def test_whole_predictions_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(6))), lang) for i in range(60) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(100, "wind", None), (101, "\u010daj \U0001f600", None), (102, "wind", "aa"), (102, "wind", "aa"), (103, None, "bb")]
    training = {}
    for i, t, lang in rows:
        if t is not None and lang and zlib.crc32(str(i).encode()) % 3 != 1:
            training.setdefault(lang, []).append(t.encode())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {(r["doc_id"], r["lang_pred"], r["score"], r["bits_per_byte"]) for r in ppm.language(docs).collect()}
    assert len({g[0] for g in got}) == len(got)  # repeated rows have the very same result
    got = {g[0]: g[1:] for g in got}
    for i, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            assert got[i] == ("und", 0.0, None)
            continue
        bits = {x: brute_bits(training[x], t.encode()) for x in sorted(training)}
        best = min(bits, key=bits.get)
        assert got[i][0] == best and abs(got[i][1] - 1 / sum(2 ** (bits[best] - x) for x in bits.values())) < 1e-9 and abs(got[i][2] - bits[best] / len(t.encode())) < 1e-9


def test_very_long_text(spark):
    rows = [(0, "wind water " * 100_000, "aa"), (2, "\u010daj noc " * 50_000, "bb"), (3, "strom", "bb"), (5, "stone", "aa")]
    rows += [(k, " ".join(WORDS[x]), x) for k in range(10, 30) for x in ["aa" if k % 2 else "bb"]]
    got = {r["doc_id"]: r["lang_pred"] for r in ppm.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[0] == "aa" and got[2] == "bb"
