import random

import duckdb
import numpy as np
import pytest

from demeframe.llm import common, jaccard
from demeframe.llm.components import components


def shingles(text):
    w = common.space_words((text or "").encode())
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1 :]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
                links[a] += 1
                links[b] += 1
    return sorted((d, len(s), find(d), links[d]) for d, s in sets)


def corpus(seed, size=160):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(900)
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([3, 8, 30, 80, 200]))] + (passage if rng.random() < 0.3 else []) for _ in range(25)]
    rows = []
    for i in range(size):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w += [word() for _ in range(rng.randrange(1, 12))]
        rows.append((i * 3 % 501, " ".join(w).upper() if rng.random() < 0.1 else "  ".join(w)))
    return rows + [(601, ""), (602, None), (603, " \n"), (604, "one"), (605, "ONE"), (606, "a b c d"), (607, "a b c d"), (608, "a b c d a b c d")]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("small", [False, True])
def test_components_match_brute_force(spark, make_docs, monkeypatch, seed, small):
    if small:  # many shards, hot shingles, and groups in chunks
        for name, value in {"SHARD": 500, "HOT": 3, "GROUP": 6, "GROUP_SHINGLES": 600}.items():
            monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed)
    docs = make_docs(rows).selectExpr("*", "1 as cls", "2 as n").repartition(5)
    assert sorted(tuple(r) for r in jaccard.join(docs).collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_match_brute_force(spark, make_docs, monkeypatch, seed):
    for name, value in {"GROUP": 6, "GROUP_SHINGLES": 600, "COPIES": 1_000}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed)
    assert sorted(tuple(r) for r in jaccard.join(make_docs(rows)).collect()) == brute(rows)


@pytest.mark.parametrize("near", [True, False])
def test_copies_of_sets_do_not_grow_with_a_component(spark, make_docs, monkeypatch, near):
    # one component, of near copies or of sets that share a few rare shingles with each of their neighbours
    monkeypatch.setattr(jaccard, "GROUP", 6)
    text = lambda i: " ".join("z%d" % i if near and k == 70 else "w%d" % (k if near else 12 * i + k) for k in range(140))
    rows = [(i, text(i)) for i in range(120)]
    tasks, plain = [], common.map_tables

    def counted(df, make, *rest):
        if make is jaccard._sets:
            tasks.extend(len(r[0]) for r in df.select("groups").collect())
        return plain(df, make, *rest)

    monkeypatch.setattr(common, "map_tables", counted)
    assert sorted(tuple(r) for r in jaccard.join(make_docs(rows)).collect()) == brute(rows)
    assert len(tasks) == 120 and sum(tasks) <= 4 * 120


def some_sets(rng):
    base = [rng.randrange(1 << 40) for _ in range(rng.choice([1, 5, 20, 100]))]
    out = []
    for _ in range(rng.choice([1, 2, 8, 50])):
        s = set(base)
        for _ in range(rng.randrange(1 + len(base) // 8)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(1 << 40))
        out.append(np.array(sorted(s), np.uint64))
    return out


@pytest.mark.parametrize("probe", [0.01, 25, 1e6])
@pytest.mark.parametrize("span", [4, 1 << 12])
def test_divide_skip_finds_all_links(monkeypatch, probe, span):
    # with cheap probes all long lists are set aside, with dear ones none
    monkeypatch.setattr(jaccard, "PROBE", probe)
    monkeypatch.setattr(jaccard, "RANGE", span)
    rng = random.Random(9)
    for k in range(60):
        sets = some_sets(rng)
        docs = np.array([rng.randrange(1, 4) for _ in sets])
        side = np.full(len(sets), 2) if k % 2 else np.array([rng.randrange(2) for _ in sets])
        links, root = jaccard.search(sets, docs, side)
        want, parts = [0] * len(sets), list(range(len(sets)))
        for i, s in enumerate(map(set, map(np.ndarray.tolist, sets))):
            for j in range(i):
                t = set(sets[j].tolist())
                if 100 * len(s & t) >= 85 * len(s | t) and (k % 2 or side[i] != side[j]):
                    want[i] += docs[j]
                    want[j] += docs[i]
                    low, high = sorted((parts[i], parts[j]))
                    parts = [low if x == high else x for x in parts]
        assert links.tolist() == want and root.tolist() == parts


def test_merge_counts():
    rng = random.Random(3)
    for _ in range(50):
        lists = [np.array(sorted(rng.sample(range(20_000), rng.randrange(60))), np.int64) for _ in range(rng.randrange(1, 9))]
        ids, counts = jaccard.merge(lists)
        want = {}
        for x in lists:
            for i in x.tolist():
                want[i] = want.get(i, 0) + 1
        assert dict(zip(ids.tolist(), counts.tolist(), strict=True)) == want and ids.tolist() == sorted(want)


def test_very_long_texts(spark, make_docs):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:110_000])), (3, "x y z " * 100_000), (4, "x y z " * 100_001), (5, "w" * 1_000_000)]
    assert sorted(tuple(r) for r in jaccard.join(make_docs(rows)).collect()) == [(1, 119_997, 1, 1), (2, 109_997, 1, 1), (3, 3, 3, 1), (4, 3, 3, 1), (5, 1, 5, 0)]


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    text = "some words that make one text"
    rows = [(5, text), (5, text), (None, text), (4, "other words here to read again"), (7, None)]
    got = sorted((tuple(r) for r in jaccard.join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(5, 3, 5, 1), (5, 3, 5, 1), (None, 3, None, 0), (4, 3, 4, 0), (7, 0, 7, 0)], key=str)
    assert jaccard.join(spark.createDataFrame([], schema)).count() == 0


def test_component_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (101, 102), (102, 100)], "u long, v long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0


def test_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{at}/documents.parquet'")
    got = [tuple(r) for r in jaccard.op9_jaccard(spark, at).collect()]
    assert sorted(got) == sorted(con.sql(jaccard.OP9_SQL).fetchall()) and any(r[3] for r in got)
