"""Pileups, genotype likelihoods and the cleaning of calls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demeframe.operators import calls as C
from demeframe.operators import pileup as PU
from demeframe.params import Params

PILE = "chrom string, pos int, sample_id int, base int, baseq int, mapq int, strand int, ord long"
P = Params(min_depth=1)
MICRO = {
    "B1": ([("A", 30, i % 2) for i in range(5)], (0, 0, 0.0, 15.0517, 15, 5)),
    "B2": ([("C", 30, i % 2) for i in range(5)], (1, 1, 0.0, 15.0517, 15, 5)),
    "B3": ([(b, 30, i % 2) for i, b in enumerate("AACCAC")], (0, 1, 5.0516, 72.2588, 67, 6)),
    "B4": ([("A", 30, i % 2) for i in range(9)] + [("C", 30, 0)], (0, 0, 20.0195, 20.1033, 0, 10)),
    "B5": ([("G", 20, 0)] * 3, (2, 2, 0.0, 9.031, 9, 3)),
    "B6": ([("T", 40, 0)], (3, 3, 0.0, 3.0103, 3, 1)),
    "B7": ([("A", 40, i % 2) for i in range(20)], (0, 0, 0.0, 60.2068, 60, 20)),
    "B8": ([("C", 30, i % 2) for i in range(10)], (1, 1, 0.0, 30.1034, 30, 10)),
}


def test_micro_pileups(spark):
    rows = [("c", k, 0, "ACGT".index(b), q, 60, s, k * 1000 + i) for k, (reads, _) in enumerate(MICRO.values()) for i, (b, q, s) in enumerate(reads)]
    cells = C.likelihoods(PU.filter_bases(spark.createDataFrame(rows, PILE), P), P).cache()
    lks = {r["pos"]: sorted(r[f"lk_{i}{j}"] for i, j in C.GENOTYPES) for r in cells.collect()}
    got = {r["pos"]: r for r in C.consensus(cells).collect()}
    for k, (_, (a1, a2, best, second, snpq, depth)) in enumerate(MICRO.values()):
        assert (got[k]["a1"], got[k]["a2"], got[k]["snpq"], got[k]["depth"], got[k]["rms"]) == (a1, a2, snpq, depth, 60)
        assert lks[k][:2] == pytest.approx([best, second], abs=1e-3)


def slow_likelihood(codes):
    """Straight from the definitions, over (qq, strand, base)."""
    n = len(codes)
    s, c = [0.0] * 4, [0] * 4
    w = {}
    for q, strand, b in sorted(codes, reverse=True):
        e = 10 ** (-q / 10)
        tail = lambda k: math.fsum(math.comb(n, i) * e**i * (1 - e) ** (n - i) for i in range(k, n + 1))
        r = w.setdefault((b, strand), 0)
        weight = 1.0 if r == 0 else (1 - C.DEPENDENCE) ** r * 0.97 + 0.03
        s[b] += weight * -10 * math.log10(tail(c[b] + 1) / tail(c[b]))
        w[b, strand] += 1
        c[b] += 1
    out = {}
    for i, j in C.GENOTYPES:
        x = sum(s[k] for k in range(4) if k not in (i, j))
        if i != j:
            x -= 4.343 * (math.log(math.comb(c[i] + c[j], c[j])) - (c[i] + c[j]) * math.log(2))
        out[i, j] = max(x, 0.0)
    return out


def test_random_cells_match_the_definitions(spark):
    rng = np.random.default_rng(3)
    cells = [[(int(rng.integers(4, 50)), int(rng.integers(2)), int(rng.integers(4))) for _ in range(rng.integers(1, 14))] for _ in range(60)]
    rows = [("c", k, 1, b, q, 60, s, k * 1000 + i) for k, x in enumerate(cells) for i, (q, s, b) in enumerate(x)]
    p = Params(min_baseq=0)
    for r in C.likelihoods(PU.filter_bases(spark.createDataFrame(rows, PILE), p), p).collect():
        want = slow_likelihood(cells[r["pos"]])
        assert [r[f"lk_{i}{j}"] for i, j in C.GENOTYPES] == pytest.approx([want[g] for g in C.GENOTYPES], abs=1e-6)


CLEAN = [
    ("A", 0, 1, 67, (1, 1), True),
    ("A", 0, 1, 10, (0, 0), False),
    ("A", 1, 1, 30, (1, 1), True),
    ("A", 1, 1, 15, (0, 0), False),
    ("A", 1, 2, 67, (1, 2), True),
    ("A", 1, 2, 10, (0, 0), False),
    ("a", 0, 0, 60, (0, 0), False),
    ("T", 0, 0, 60, (0, 0), True),
]


def classified(spark, rows, p):
    calls = spark.createDataFrame([("c", i, 0, a1, a2, 10, q, 50) for i, (_, a1, a2, q, *_) in enumerate(rows)], "chrom string, pos int, sample_id int, a1 int, a2 int, depth int, snpq int, rms int")
    refs = spark.createDataFrame([("c", i, r[0]) for i, r in enumerate(rows)], "chrom string, pos int, ref string")
    return {r["pos"]: r for r in C.classify(calls, refs, p).collect()}


def test_cleaning(spark):
    got = classified(spark, CLEAN, Params())
    for i, (*_, alleles, derived) in enumerate(CLEAN):
        assert (got[i]["a1"], got[i]["a2"]) == alleles and got[i]["derived"] == derived and got[i]["depth"] == 10 and got[i]["pass"]
    kept = classified(spark, [("A", 0, 1, 67, None)], Params(het_prior=1e-4))[0]
    assert (kept["a1"], kept["a2"], kept["derived"]) == (0, 1, True)


def test_both_modes_of_odd_references(spark):
    odd = [("a", 0, 0, 60), ("N", 0, 0, 60), ("A", 1, 2, 10)]
    assert classified(spark, odd, Params()).keys() == {0, 2}
    got = classified(spark, odd, Params(compat="reference"))
    assert got[0]["derived"] and got[1]["derived"] and (got[2]["a1"], got[2]["a2"]) == (2, 1)


def test_depth_cap_comes_before_the_quality_filter(spark):
    rows = [("c", 1, 0, 0, 5 if i < 3 else 40, 60, 0, i) for i in range(300)]
    df = spark.createDataFrame(rows, PILE)
    assert PU.filter_bases(PU.cap_depth(df, Params()), Params()).count() == 252
    assert PU.filter_bases(PU.cap_depth(df, Params(max_depth=3)), Params(min_depth=0, max_depth=3)).count() == 0
    deep = spark.createDataFrame([("c", 1, 0, 0, 40, 60, 0, i) for i in range(400)], PILE)
    assert C.call(deep, Params(max_depth=1000)).first()["depth"] == 255


def test_base_filters(spark):
    rows = [("c", 1, 0, 0, 12, 60, 0, 1), ("c", 1, 0, 0, 13, 60, 0, 2), ("c", 1, 0, 0, 40, 12, 0, 3), ("c", 1, 0, 0, 40, 13, 0, 4), ("c", 1, 0, None, 40, 60, 0, 5), ("c", 1, 0, 2, 70, 90, 0, 6)]
    got = {r["ord"]: r["qq"] for r in PU.filter_bases(spark.createDataFrame(rows, PILE), Params()).collect()}
    assert got == {2: 13, 4: 13, 6: 63}
    scaled = spark.createDataFrame([(31,), (64,), (0,)], "q int").select(PU.base_quality(F.col("q"), Params(illumina=True)).alias("x"))
    assert [r["x"] for r in scaled.collect()] == [0, 33, 0]


READS = "qname string, flag int, chrom string, pos int, mapq int, cigar string, seq string, qual array<int>, read_group string, ord long"


def reads(spark, rows):
    df = spark.createDataFrame([(f"r{i}", flag, "c", pos, 60, cigar, seq, [30] * len(seq), rg, i) for i, (flag, pos, cigar, seq, rg) in enumerate(rows)], READS)
    return df.withColumn("cigar", PU.parse_cigar(F.col("cigar")))


def test_alignments_become_bases(spark):
    df = reads(spark, [(16, 10, "5M2D5M", "ACGTACGTAC", "g"), (0, 10, "3M10N3M", "AAACCC", "g"), (0, 10, "2S3M1I2M", "TTGGGACC", "g"), (4, 10, "3M", "AAA", "g"), (0, 10, "3M", "AAA", None), (0, 10, "1M1P1M", "NN", "g")])
    groups = spark.createDataFrame([("g", 3)], "rg string, sample_id int")
    got = {}
    for r in PU.to_pileup(df, groups, Params()).collect():
        got.setdefault(r["ord"], []).append((r["pos"], r["base"], r["strand"], r["sample_id"]))
    assert sorted(got[0]) == [(p, b, 1, 3) for p, b in zip([10, 11, 12, 13, 14, 17, 18, 19, 20, 21], [0, 1, 2, 3, 0, 1, 2, 3, 0, 1])]
    assert [p for p, *_ in sorted(got[1])] == [10, 11, 12, 23, 24, 25] and [b for _, b, *_ in sorted(got[1])] == [0, 0, 0, 1, 1, 1]
    assert [(p, b) for p, b, *_ in sorted(got[2])] == [(10, 2), (11, 2), (12, 2), (13, 1), (14, 1)]
    assert 3 not in got and 4 not in got and [b for _, b, *_ in got[5]] == [None, None]
    with pytest.raises(Exception, match="no sample for read group"):
        PU.to_pileup(reads(spark, [(0, 1, "1M", "A", "other")]), groups, Params()).collect()
    assert PU.pass_flags(df, 0x14).count() == 4


def test_geometry(spark):
    df = reads(spark, [(0, 100, "5S10M2D3I4M", "A" * 22, "g")]).select(PU.reference_end(F.col("pos"), F.col("cigar")).alias("e"), PU.query_length(F.col("cigar")).alias("q"), PU.bin_of(F.lit(100), F.lit(200)).alias("a"), PU.bin_of(F.lit(16383), F.lit(16385)).alias("b"), PU.bin_of(F.lit(0), F.lit(1 << 29)).alias("c"))
    assert tuple(df.first()) == (116, 22, 4681, 585, 0)
