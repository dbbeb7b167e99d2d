"""Statistics over the hand-worked site matrix, in both modes, and their parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demeframe.functions import genomics as G
from demeframe.operators import diversity, haplotypes, linkage, snps, tree
from demeframe.operators import sites as S
from demeframe.operators.windows import Region, n_windows, parse_region, spine, with_window
from demeframe.params import Params

MATRIX = {3: "1100110", 10: "1100001", 25: "0010000", 40: "1111111", 41: "1100110", 70: "0001011", 88: "1000000"}
POPS = [S.Pop(0, "A", 0b0001111, 4), S.Pop(1, "B", 0b1110000, 3)]
DOC, REF = Params(min_snps=1), Params(compat="reference", min_snps=1)
SITES = "win_id long, chrom string, pos int, ref int, cov_mask long, type_mask long, derived_mask long, fq long"


def site_rows(matrix, length, samples=7, win=0):
    full = (1 << samples) - 1
    mask = lambda row: sum(1 << i for i, c in enumerate(row) if c == "1")
    return [(win, "c", i, 0, full, mask(matrix.get(i, "")), mask(matrix.get(i, "")), matrix.get(i, "").count("1")) for i in range(length)]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(site_rows(MATRIX, 100), SITES).cache()


@pytest.fixture(scope="module")
def windows(spark):
    return spark.createDataFrame([(0, "c", 0, 100), (1, "c", 100, 200)], "win_id long, chrom string, win_beg int, win_end int")


def by_pop(df, name):
    return {r["pop"]: r[name] for r in df.where("win_id = 0").collect()}


def near(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=6e-6)


@pytest.mark.parametrize("p,want", [(DOC, {"A": 0.035, "B": 0.02667}), (REF, {"A": 0.04667, "B": 0.04})])
def test_pi(found, windows, p, want):
    near({k: round(v, 5) for k, v in by_pop(diversity.nucleotide_diversity(found, POPS, windows, p), "pi").items()}, want)


def test_empty_window_still_has_rows(found, windows):
    rows = diversity.nucleotide_diversity(found, POPS, windows, DOC).where("win_id = 1").collect()
    assert [(r["ns"], r["pi"]) for r in rows] == [(0, None)] * 2
    assert linkage.zns(found, POPS, windows, DOC).where("win_id = 1").count() == 2


@pytest.mark.parametrize("p", [DOC, Params(compat="reference", min_sites=1)])
def test_dxy(found, windows, p):
    r = diversity.divergence_between(found, POPS, windows, p).where("win_id = 0").first()
    assert (r["pop1"], r["pop2"], r["ns"]) == ("A", "B", 100) and r["dxy"] == pytest.approx(0.02583, abs=5e-6)


def test_spectrum(found, windows):
    near({k: v and round(v, 5) for k, v in by_pop(diversity.spectrum(found, POPS, windows, DOC), "tajima_d").items()}, {"A": 0.67384, "B": None})
    near({k: round(v, 5) for k, v in by_pop(diversity.spectrum(found, POPS, windows, DOC), "faywu_h").items()}, {"A": 0.66832, "B": -1.60422})
    p = Params(compat="reference", min_sites=1)
    assert by_pop(diversity.spectrum(found, POPS, windows, p), "tajima_d")["A"] == pytest.approx(4.13288, abs=5e-6)
    near({k: round(v, 5) for k, v in by_pop(diversity.spectrum(found, POPS, windows, p), "faywu_h").items()}, {"A": 0.36454, "B": -1.60422})


def test_constants():
    assert G.tajima_constants(10) == pytest.approx((2.828968254, 1.539767731, 0.019060534, 0.004948928))
    assert G.tajima_constants(3)[2:] == pytest.approx((0, 0), abs=1e-12)


def test_divergence(found, windows):
    rows = diversity.divergence_individual(found, POPS, windows, DOC).where("win_id = 0").orderBy("sample_id").collect()
    assert [r["d"] for r in rows] == pytest.approx([x / 100 for x in (5, 4, 2, 2, 3, 4, 3)])
    rows = diversity.divergence_individual(found, POPS, windows, Params(dist="jc")).where("win_id = 0").orderBy("sample_id").collect()
    assert [round(r["d"], 5) for r in rows] == [0.05174, 0.04111, 0.02027, 0.02027, 0.03062, 0.04111, 0.03062]
    pops = {r["pop"]: r for r in diversity.divergence_population(found, POPS, windows, DOC).where("win_id = 0").collect()}
    assert [(pops[x]["fixed"], pops[x]["seg"]) for x in "AB"] == [(1, 6), (1, 4)] and pops["A"]["d"] == pytest.approx(0.07)
    few = diversity.divergence_population(found, POPS, windows, Params(substitutions_only=True, no_singletons=True)).where("win_id = 0").collect()
    assert {r["pop"]: (r["seg"], r["d"]) for r in few} == {"A": (3, 0.01), "B": (3, 0.01)}


def test_jukes_cantor(spark):
    got = spark.range(1).select(*[G.jukes_cantor(F.lit(x)).alias(f"v{i}") for i, x in enumerate((0.1, 0.75, 0.9, 0.0))]).first()
    assert got[0] == pytest.approx(0.107326, abs=1e-6) and got[1] is None and got[2] is None and got[3] == 0
    G.register_sql(spark)
    assert spark.sql("select jukes_cantor(0.1D)").first()[0] == pytest.approx(0.107326, abs=1e-6)


def test_haplotypes(found, windows):
    haps = {(r["pop_id"], r["sample_id"]): r["hap"] for r in haplotypes.haplotypes(found, POPS, DOC).collect()}
    assert [haps[0, i] for i in range(4)] == ["110101", "110100", "001000", "000010"] and [haps[1, i] for i in range(4, 7)] == ["1010", "1011", "0101"]
    assert by_pop(haplotypes.diversity(found, POPS, windows, DOC), "k") == {"A": 4, "B": 3}
    near(by_pop(haplotypes.diversity(found, POPS, windows, DOC), "kdiv"), {"A": 1.0, "B": 1.0})
    near(by_pop(haplotypes.diversity(found, POPS, windows, REF), "kdiv"), {"A": 0.75, "B": 2 / 3})
    r = haplotypes.gmin(found, POPS, windows, DOC).where("win_id = 0").first()
    assert r["mean_dxy"] == pytest.approx(2.58333, abs=1e-5) and r["min_dxy"] == 1 and r["gmin"] == pytest.approx(0.38710, abs=1e-5)
    want = {(0, 1): 1, (0, 2): 5, (0, 3): 5, (0, 4): 2, (0, 5): 3, (0, 6): 4, (1, 2): 4, (1, 3): 4, (1, 4): 1, (1, 5): 2, (1, 6): 3, (2, 3): 2, (2, 4): 3, (2, 5): 4, (2, 6): 3, (3, 4): 3, (3, 5): 2, (3, 6): 1, (4, 5): 1, (4, 6): 4, (5, 6): 3}
    assert {(r["i"], r["j"]): r["differ"] for r in haplotypes.pair_differences(found, POPS, DOC).collect()} == want
    near(by_pop(haplotypes.pairwise_pi(found, POPS, windows, DOC), "pi"), {"A": 21 / 6 / 100, "B": 8 / 3 / 100})
    assert by_pop(haplotypes.ehhs(found, POPS, windows, DOC), "ehhs")["B"] is None


def test_linkage(found, windows):
    near({k: round(v, 5) for k, v in by_pop(linkage.zns(found, POPS, windows, DOC), "zns").items()}, {"A": 0.42222, "B": 0.625})
    near({k: round(v, 5) for k, v in by_pop(linkage.zns(found, POPS, windows, REF), "zns").items()}, {"A": 0.42222, "B": 0.375})
    near({k: round(v, 5) for k, v in by_pop(linkage.omega_max(found, POPS, windows, DOC), "omega").items()}, {"A": 2.11429, "B": 1.0})
    wall = linkage.wall(found, POPS, windows, DOC)
    near({k: round(v, 5) for k, v in by_pop(wall, "wall_b").items()}, {"A": 0.2, "B": 0.66667})
    near({k: round(v, 5) for k, v in by_pop(wall, "wall_q").items()}, {"A": 0.33333, "B": 0.75})
    assert by_pop(linkage.zns(found, POPS, windows, Params(min_snps=5)), "zns")["B"] is None


def test_r_squared_is_folded_and_bounded(spark):
    rng = random.Random(1)
    rows = {i: "".join(rng.choice("01") for _ in range(8)) for i in range(25)}
    flip = {i: r if i % 2 else "".join("10"[int(c)] for c in r) for i, r in rows.items()}
    pops = [S.Pop(0, "A", 255, 8)]
    get = lambda m: {(r["i"], r["j"]): r["r2"] for r in linkage.r_squared(linkage.snps(spark.createDataFrame(site_rows(m, 25, 8), SITES), pops, DOC)).collect()}
    a, b = get(rows), get(flip)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) and 0 <= a[k] <= 1 + 1e-12 for k in a)


def test_neighbour_joining_recovers_additive_trees():
    d = np.array([[0, 5, 7, 8], [5, 0, 8, 9], [7, 8, 0, 9], [8, 9, 9, 0]], float)
    links = tree.neighbour_joining(d)

    def path(a, b, seen=()):
        if a == b:
            return 0.0
        for k, x in links[a]:
            if k not in seen and (rest := path(k, b, (*seen, a))) is not None:
                return x + rest
        return None

    assert all(path(i, j) == pytest.approx(d[i, j]) for i in range(4) for j in range(4))
    assert tree.newick(links, list("abcd")) == "(a:2.00000,b:3.00000,(c:4.00000,d:5.00000):1.00000);"


def test_trees(found, windows):
    names = ["ref", *(f"s{i}" for i in range(7))]
    rows = {r["win_id"]: r for r in tree.trees(found, POPS, windows, DOC, names).collect()}
    assert rows[0]["num_sites"] == 100 and all(rows[0]["newick"].count(n) == 1 for n in names) and rows[1]["newick"] is None
    assert tree.trees(found, [S.Pop(0, "A", 1, 1)], windows, DOC, names).first()["newick"] is None
    cells = {(r["i"], r["j"]): r["differ"] for r in tree.differences(found, POPS).collect()}
    assert [cells[0, j] for j in range(1, 8)] == [5, 4, 2, 2, 3, 4, 3] and cells[1, 3] == 5


def test_ms_and_sweepfinder(found, windows):
    r = snps.ms_blocks(found, POPS, windows, DOC).where("win_id = 0").first()
    assert r["segsites"] == 7 and r["positions"].split()[0] == "0.03000000" and r["haplotypes"][0] == "1101101"
    assert snps.ms_text(snps.ms_blocks(found, POPS, windows, DOC)).where("win_id = 1").first()["value"] == "\n//\nsegsites: 0"
    assert snps.ms_header(POPS, 2).splitlines() == ["ms 7 2 -t 5.0 -I 2 4 3", "1350154902"]
    flipped = snps.ms_blocks(found, POPS, windows, DOC, 6).where("win_id = 0").first()["haplotypes"]
    assert flipped[0] == "1000111" and flipped[6] == "0000000"
    assert snps.ms_header(POPS[:1], 3).splitlines()[0] == "ms 4 3 -t 5.0"
    out = {(r["pos"], r["pop"]): (r["x"], r["n"]) for r in snps.sweepfinder(found, POPS, DOC, 6).collect()}
    assert out[40, "A"] == (0, 4) and out[3, "A"] == (2, 4) and out[70, "B"] == (1, 3)


def test_sample_63_is_the_sign_bit(spark, windows):
    rows = [(0, "c", i, 0, -1, -(1 << 63) if i == 5 else 0, 0, int(i == 5)) for i in range(20)]
    pops = [S.Pop(0, "A", -1, 64)]
    df = spark.createDataFrame(rows, SITES)
    assert by_pop(diversity.nucleotide_diversity(df, pops, windows, DOC), "pi")["A"] == pytest.approx(2 * 63 / (64 * 63) / 20)
    assert diversity.divergence_individual(df, pops, windows, DOC).where("sample_id = 63 and win_id = 0").first()["d"] == 0.05


def test_edge_matrices(spark, windows):
    one = spark.createDataFrame(site_rows({4: "1111111"}, 20), SITES)
    assert by_pop(linkage.zns(one, POPS, windows, DOC), "zns") == {"A": None, "B": None}
    assert by_pop(haplotypes.diversity(one, POPS, windows, DOC), "k") == {"A": 1, "B": 1}
    none = spark.createDataFrame(site_rows({}, 20), SITES)
    assert by_pop(diversity.spectrum(none, POPS, windows, DOC), "tajima_d") == {"A": None, "B": None}
    assert tree.trees(none, POPS, windows, DOC, [str(i) for i in range(8)]).first()["newick"] is None
    mixed = [S.Pop(0, "A", 0b0010101, 3), S.Pop(1, "B", 0b0101010, 3)]
    full = spark.createDataFrame(site_rows(MATRIX, 100), SITES)
    assert haplotypes.gmin(full, mixed, windows, DOC).where("win_id = 0").first()["min_dxy"] == 1


def test_coverage_rules(spark):
    rows = [(0, "c", 1, 0, 0b1110111, 0, 0, 0), (0, "c", 2, 0, 0b0010011, 0, 0, 0), (0, "c", 3, 0, 0b0001111, 0b1, 1, 1)]
    df = spark.createDataFrame(rows, SITES)
    got = lambda rule, p: {(r["pos"], r["pop"]): r["covered"] for r in S.per_pop(df, POPS, p, rule).collect()}
    assert got("complete", DOC) == {(1, "A"): False, (1, "B"): True, (3, "A"): True, (3, "B"): False}
    assert got("proportion", Params(min_pop=0.75))[1, "A"]
    assert S.all_pass(df, POPS).count() == 0


@pytest.mark.parametrize("beg,end,ref,doc", [(0, 10000, 9, 10), (0, 10001, 10, 11), (999, 2000, 1, 2), (0, 500, 0, 1)])
def test_windows(spark, beg, end, ref, doc):
    region = Region("c", beg, end)
    for compat, want in (("reference", ref), ("documented", doc)):
        p = Params(window=1000, compat=compat)
        assert n_windows(region, p) == want
        rows = spine(spark, region, p).orderBy("win_id").collect()
        inside = with_window(spark.range(beg, end).selectExpr("'c' as chrom", "cast(id as int) as pos"), region, p)
        seen = {r["win_id"]: (r["a"], r["b"] + 1) for r in inside.groupBy("win_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).collect()}
        assert {r["win_id"]: (r["win_beg"], r["win_end"]) for r in rows} == seen and len(rows) == want


def test_regions():
    contigs = {"c": 100, "HLA:1": 5}
    assert parse_region("c", contigs) == Region("c", 0, 100) and parse_region("HLA:1", contigs) == Region("HLA:1", 0, 5)
    assert parse_region("c:11-20", contigs) == Region("c", 10, 20) and parse_region("c:11", contigs) == Region("c", 10, 100)
    for bad in ("x", "c:20-11", "c:a-b"):
        with pytest.raises(ValueError):
            parse_region(bad, contigs)


def test_params_report_all_errors():
    with pytest.raises(ValueError, match="depths.*output"):
        Params(min_depth=-1, output=7)
    assert math.isclose(Params().min_pop, 1.0)


def test_dictionaries(spark):
    rg = spark.createDataFrame([("rg1", "s0", "popA", 1), ("rg2", "s1", "popA", 2), ("rg3", "s1", "popA", 3), ("rg4", "s2", "popB", 4)], "rg string, sample string, pop string, ord int")
    pops = S.assign_pops(S.sample_table(rg))
    assert [(p.name, p.mask, p.n) for p in pops] == [("popA", 3, 2), ("popB", 4, 1)]
    with pytest.raises(ValueError, match="without a population"):
        S.assign_pops(S.sample_table(rg.withColumn("pop", F.when(F.col("rg") != "rg4", F.col("pop")))))
    assert [p.n for p in S.assign_pops(S.sample_table(rg.withColumn("pop", F.lit(None).cast("string"))))] == [3]
