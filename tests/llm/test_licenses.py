import random

import numpy as np

from demeframe.llm import common
from demeframe.llm.licenses import CHAIN_GAP, LABEL_SHARE, LONG_MATCH, PHRASES, TEMPLATES, Scanner, SuffixAutomaton, labelled, license_spans


def test_matching_statistics_match_brute_force():
    rng = random.Random(5)
    for _ in range(50):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 15))] for _ in range(4)]
        a = SuffixAutomaton(texts)
        words = [rng.randrange(4) for _ in range(40)]
        lengths, states = a.statistics(words)
        for i, n in enumerate(lengths):
            inside = lambda x: {(k, j + len(x)) for k, t in enumerate(texts) for j in range(len(t) - len(x) + 1) if t[j : j + len(x)] == x}
            best = max(m for m in range(i + 2) if not m or inside(words[i + 1 - m : i + 1]))
            assert n == best
            if n:
                assert a.ends[states[i]] == inside(words[i + 1 - n : i + 1])


def test_base_places():
    s = Scanner()
    text = b"See the MIT License, mit-license; Apache License cc BY cc by 4 GNU general public license"
    words = common.alnum_words(text)
    starts, labels = s.base(s.numbers(words))
    want = sorted(i for p in PHRASES for i in range(len(words)) if [w.decode() for w in words[i:]][: len(p.split())] == p.split())
    assert starts == want and labels == {"mit", "apache", "cc-by", "gpl"}
    assert s.base(np.zeros(0, np.int64)) == ([], set())


def test_whole_and_cut_templates_are_covered():
    s = Scanner()
    for label, text in TEMPLATES.items():
        found = [x for x in s.spans(s.numbers(common.alnum_words(b"zzz yyy " + text.encode()))) if x[0] == label]
        assert found[0][1] == 2 and found[0][4] == 1.0
    words = common.alnum_words(TEMPLATES["mit"].encode())
    words[40:43] = [b"qqq"]
    found = [x for x in s.spans(s.numbers(words)) if x[0] == "mit"]
    assert len(found) == 1 and found[0][3] == len(words) - 1


def test_table(spark, make_docs):
    docs = make_docs([TEMPLATES["bsd"], "the cc-by text", None, "", "the cc-by text", "under the terms of a b"]).selectExpr("*", "1 as labels", "2 as n_words")
    got = {r["doc_id"]: r for r in labelled(license_spans(docs)).collect()}
    assert got[0]["labels"] == "bsd" and got[0]["score"] == 1.0 and got[0]["base_labels"] == ""
    assert got[1]["labels"] == got[4]["labels"] == "cc-by" and got[1]["first_word"] == got[1]["last_word"] == 1
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and got[2]["first_word"] is None and got[2]["score"] == 0
    assert got[5]["labels"] == ""
    assert labelled(license_spans(docs.limit(0))).count() == 0


def brute_spans(words):
    """Chains of maximal long matches, found by comparing all places."""
    texts = {label: [w.decode() for w in common.alnum_words(t.encode())] for label, t in TEMPLATES.items()}
    joined = {label: " " + " ".join(t) + " " for label, t in texts.items()}
    inside = lambda x: any(f" {' '.join(x)} " in t for t in joined.values())
    lengths, n = [], 0
    for i in range(len(words)):
        n += 1
        while n and not inside(words[i + 1 - n : i + 1]):
            n -= 1
        lengths.append(n)
    out = []
    for label, t in texts.items():
        found = []
        for i, n in enumerate(lengths):
            if n >= LONG_MATCH and (i + 1 == len(words) or lengths[i + 1] <= n):
                run = words[i + 1 - n : i + 1]
                found += [(i + 1 - n, i + 1, p) for p in range(len(t) - n + 1) if t[p : p + n] == run]
        chains = []
        for start, stop, place in sorted(found):
            if chains:
                last = chains[-1]
                cut = max(0, last[1] - start, last[2] - place)
                if cut < stop - start and start + cut - last[1] <= CHAIN_GAP:
                    last[1], last[2], last[3] = stop, place + stop - start, last[3] + stop - start - cut
                    continue
                if start < last[1] and stop - start <= last[3]:
                    continue
            chains.append([start, stop, place + stop - start, stop - start])
        out += [(label, s, e, n, min(1.0, n / len(t))) for s, e, _, n in chains]
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def test_whole_results_match_brute_force(spark, make_docs):
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            t = rng.choice(list(TEMPLATES.values())).split()
            a = rng.randrange(len(t))
            parts += t[a : a + rng.choice([3, 8, 40, 200])]
            parts += [rng.choice(["zzz", "the", "MIT License", "cc by"]) for _ in range(rng.randrange(15))]
        texts.append(" ".join(parts))
    texts += [None, "", texts[0], "x " * 50_000 + TEMPLATES["isc"]]
    got = {r["doc_id"]: r for r in labelled(license_spans(make_docs(texts))).collect()}
    for k, t in enumerate(texts):
        words = [w.decode() for w in common.alnum_words((t or "").encode())]
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        spans = brute_spans(words)
        base, r = {x for _, x in places}, got[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(base)))
        assert [tuple(x) for x in r["found"]] == spans
        assert r["labels"] == ",".join(sorted(base | {x[0] for x in spans if x[4] >= LABEL_SHARE})) and r["score"] == max([x[4] for x in spans], default=0.0)
