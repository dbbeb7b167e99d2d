import hashlib
import os
import random
import time

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from demeframe.llm import bpe, common, ppm

from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, prose(20)) for i in range(6)]
    texts = [prose(rng.randrange(20, 90)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[2] + " " + word(), texts[3].upper()]
    texts += [items[0][1] + " " + prose(30), prose(40) + " " + items[1][1], items[2][1] + " " + prose(900)]
    texts += ["mail bob@site.org or +1 234 567 8901 now " + prose(20), None, "", "12 34 !", "x"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(50, texts[0], "en", "s0", 0), (50, texts[0], "en", "s0", 0), (None, prose(30), "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(at + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(at + "/benchmark.parquet")
    return at, rows, items


def test_run_matches_brute_force(spark, tables):
    at, rows, items = tables
    kept = [(d, t) for d, t, *_ in rows if t and ppm.has_letter(t.encode())]
    with_id = list(dict.fromkeys(x for x in kept if x[0] is not None))
    first = {d for d, _, c, _ in components(with_id) if d == c}
    kept = [x for x in with_id if x[0] in first] + [x for x in kept if x[0] is None]
    bad = contaminated(kept, items)
    kept = {d: t for d, t in kept if not bad[d][4]}
    assert not {44, 45} & kept.keys() and {46, 47, None} <= kept.keys()
    got = {r["doc_id"]: r for r in pipeline.run(spark, at).collect()}
    assert got.keys() == kept.keys()
    reference = bpe.tokenizer(public_tokenizers.path(bpe.RANKS)).merges
    for d, t in kept.items():
        t = t.replace("bob@site.org", "[EMAIL]").replace("+1 234 567 8901", "[PHONE]")
        ids = reference.encode_ordinary(t)
        assert list(got[d]["ids"]) == ids and got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_rows_that_share_an_id(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, text), (5, text + "."), (5, "quite another text that is on its own here"), (6, text), (7, "b c d e f g"), (7, "b c d e f g"), (7, "h i j k l m"), (8, None), (8, "")]
    rows += [(2, text.replace("one", "uno") + " end"), (9, text.upper())]
    docs = spark.createDataFrame([(d, t, x, "s", 1) for k, (d, t) in enumerate(rows) for x in [str(k)]], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    parts = {}
    for d, s, c, _ in components(list(dict.fromkeys(x for x in rows if x[0] in (1, 2, 6, 9)))):
        parts.setdefault(c, []).append(d)
    want = [(c, dict(rows)[c]) for c in parts] + [(5, "quite another text that is on its own here"), (7, "b c d e f g"), (7, "h i j k l m"), (8, None), (8, "")]
    assert got == sorted(want, key=str)


def test_stages_keep_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(tables[0] + "/documents.parquet").selectExpr("*", "1 as spans", "2 as lang_pred")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[0])
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.select(*pipeline.COLUMNS).schema]
        assert stage(spark, docs.limit(0), tables[0]).count() == 0


def shuffled(spark):
    """Bytes of each shuffle file that is there now."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getPath() for i in range(files.size())]
    return {f: os.path.getsize(f) for f in names if os.path.basename(f).startswith("shuffle_") and os.path.exists(f)}


def test_near_duplicates_leaves_no_shuffles_behind(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("%x" % rng.randrange(1 << 40) for _ in range(300)) for _ in range(200)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts + [t + " end" for t in texts[:50]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    before, setting, left, plain = set(shuffled(spark)), spark.conf.get(common.CLEANUP, None), [], common.written

    def looked(df, name):
        out = plain(df, name)
        for _ in range(20):
            now = sum(n for f, n in shuffled(spark).items() if f not in before)
            if now < 50_000:  # single rows that went to the driver
                break
            time.sleep(0.1)
        left.append(now)
        assert spark.conf.get(common.CLEANUP, None) == setting
        return out

    monkeypatch.setattr(common, "written", looked)
    out = pipeline.near_duplicates(spark, docs, "")
    assert len(left) > 4 and max(left) < 50_000
    assert out.count() == 200
