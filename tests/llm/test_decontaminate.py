import hashlib
import random

import duckdb
import numpy as np
import pytest

from demeframe.llm import common
from demeframe.llm.decontaminate import OP1_SQL, Windows, find_in_words, op1_decontaminate, removal_spans, report
from demeframe.llm.fm_index import FMIndex, suffix_array


def brute(docs, items, width=13):
    out = {}
    for doc, text in docs:
        words = common.alnum_words((text or "").encode())
        hit, found = set(), set()
        for item, t in items:
            w = common.alnum_words((t or "").encode())
            for i in range(max(1, len(w) - width + 1) if w else 0):
                x = w[i : i + width]
                for p in range(len(words) - len(x) + 1):
                    if words[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        found |= {item} - {None}
        names = ",".join(sorted(map(str, found)))
        out[doc] = (len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_and_search(seed):
    rng = np.random.default_rng(seed)
    s = np.append(rng.integers(0, 4, 300), 0)
    s[50:80] = s[150:180]
    key = lambda i: [(0, j) if x == 0 else (1, x) for j, x in enumerate(s[i:], i)]
    assert suffix_array(s, 2).tolist() == sorted(range(len(s)), key=key)
    index = FMIndex(s, 3)
    pats = [(1,), (1, 2), (3, 3, 1), (2, 1, 3, 2)]
    p = np.zeros((4, 4), np.int64)
    for row, x in enumerate(pats):
        p[row, 4 - len(x) :] = x
    low, high = index.search(p, np.array([len(x) for x in pats]))
    which, at = index.locate(low, high)
    for k, x in enumerate(pats):
        assert sorted(at[which == k].tolist()) == [i for i in range(len(s)) if tuple(s[i : i + len(x)]) == x]


def test_matches_brute_force(spark, make_docs):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "c", "Ñu", "d1", "x"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 13, 20, 30, 1, 14])] + [(9, ""), (10, None), (11, "?!"), (100, "a b c")]
    items += [(12, items[3][1]), (12, items[2][1]), (None, "c c b a"), (None, items[3][1])]
    docs = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(30)]
    docs += [items[3][1] + ". zz " * 40, "zz " + items[2][1].upper() + "!", None, "", "...", items[1][1], items[1][1]]
    rows = list(enumerate(docs))
    got = report(removal_spans(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert {r[0]: tuple(r[1:6]) for r in got} == brute(rows, items)
    # the same in many blocks, and with documents cut into pieces
    got = report(removal_spans(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=60)).collect()
    assert {r[0]: tuple(r[1:6]) for r in got} == brute(rows, items)


def test_long_document_is_cut_with_overlap():
    w = Windows([(1, b" ".join(b"w%d" % i for i in range(13)))], 13)
    words = [b"w%d" % (i % 13) for i in range(1000)]
    _, start, end, items = find_in_words([words, []], w, shard_words=50)
    assert (start.tolist(), end.tolist()) == ([0], [76 * 13]) and items[0].tolist() == [1] and not len(items[1])


def test_empty_tables_and_extra_columns(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs(["a b", None]).selectExpr("*", "1 as n_words", "2 as spans", "3 as items")
    got = sorted(report(removal_spans(docs, bench)).collect())
    assert [tuple(r[:4]) for r in got] == [(0, 2, 0, 0), (1, 0, 0, 0)]
    assert report(removal_spans(docs.limit(0), bench)).count() == 0


def test_item_without_id_counts_as_hit(spark, make_docs):
    got = report(removal_spans(make_docs(["a b c d"]), spark.createDataFrame([(None, "a b c")], "item_id long, text string"))).first()
    assert tuple(got[:4]) == (0, 4, 3, 0) and got["contaminated"]


def test_blocks_survive_writing():
    a = Windows([(1, b"a b c"), (None, b"b"), (2, b"a b c"), (3, b" ".join(b"w%d" % i for i in range(40)))], 13)
    b = Windows.from_bytes(a.to_bytes())
    assert a.symbols == b.symbols and all((getattr(a, x) == getattr(b, x)).all() for x in ("patterns", "lengths", "items", "item_size", "item_end"))
    assert len(a.patterns) == 30 and a.item_size.sum() == 2 + 28


def test_very_long_text(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(20))
    text = ("zz yy " * 200_000 + item + " ") * 2
    got = report(removal_spans(make_docs([text, "x"]), spark.createDataFrame([(5, item)], "item_id long, text string"))).orderBy("doc_id").collect()
    assert tuple(got[0][:4]) == (0, 800_040, 40, 1) and tuple(got[1][:4]) == (1, 1, 0, 0)


def test_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    got = [tuple(r) for r in op1_decontaminate(spark, at).collect()]
    assert sorted(got) == sorted(con.sql(OP1_SQL).fetchall()) and any(r[5] for r in got)
