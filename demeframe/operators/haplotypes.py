"""Haplotype statistics per window: K, diversity, EHHS, pairwise differences and Gmin's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genomics as G
from ..params import Params
from . import sites as S
from .diversity import WIN, on_spine

GROUP = ["win_id", "pop_id"]


def retained(found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """num_sites and snps of each window and population: a retained site has a row for each population."""
    return S.per_pop(found, pops, p, "complete").groupBy(*GROUP).agg(F.count("*").alias("num_sites"), F.count_if(F.expr("fq > 0 and covered and f > 0 and f < n")).alias("snps"))


def haplotypes(found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """win_id, pop_id, sample_id, hap: 0 and 1 at sites where the whole population passes and varies."""
    rows = S.per_pop(found, pops, p, "complete").where("fq > 0 and covered and f > 0 and f < n")
    samples = F.filter(F.sequence(F.lit(0), F.lit(G.MOST_SAMPLES - 1)), lambda i: G.has_bit(F.col("pop_mask"), i))
    per = rows.groupBy(*GROUP, "pop_mask").agg(F.array_sort(F.collect_list(F.struct("pos", "mask"))).alias("sites"))
    one = per.select(*GROUP, "sites", F.explode(samples).alias("sample_id"))
    return one.select(*GROUP, "sample_id", F.array_join(F.transform("sites", lambda x: G.has_bit(x["mask"], F.col("sample_id")).cast("int").cast("string")), "").alias("hap"))


def haplotype_keys(found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """win_id, pop_id, sample_id, hap: a number that equal haplotypes share, without their letters.

    It joins the hashes of the positions where the sample is derived, in any order, so sites are summed up where
    they are and no row holds a window; two haplotypes that differ share it by a chance of 2^-64.
    """
    rows = S.per_pop(found, pops, p, "complete").where("fq > 0 and covered and f > 0 and f < n")
    samples = F.filter(F.sequence(F.lit(0), F.lit(G.MOST_SAMPLES - 1)), lambda i: G.has_bit(F.col("pop_mask"), i))
    one = rows.select(*GROUP, "mask", F.xxhash64("pos").alias("at"), F.explode(samples).alias("sample_id"))
    return one.groupBy(*GROUP, "sample_id").agg(F.bit_xor(F.when(G.has_bit(F.col("mask"), F.col("sample_id")), F.col("at")).otherwise(F.lit(0).cast("long"))).alias("hap"))


def diversity(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """K and Kdiv, the haplotype diversity.  A population that varies nowhere has one haplotype."""
    per = haplotype_keys(found, pops, p).groupBy(*GROUP, "hap").agg(F.count("*").alias("c")).groupBy(*GROUP).agg(F.count("*").alias("k"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    out = on_spine(spine, S.literal(pops), retained(found, pops, p).join(per, GROUP, "left"), ["pop_id"], ["num_sites"])
    n = F.col("n").cast("double")
    diverse = F.lit(1.0) - F.coalesce(F.col("squares").cast("double") / (n * n), F.lit(1.0))
    ratio = F.when(F.col("n") == 2, F.lit(2.0)).otherwise(F.lit(1.0)) if p.reference else F.try_divide(n, n - 1)
    shown = F.col("num_sites") >= p.min_sites
    return out.select(*WIN, "num_sites", "pop", F.when(shown, F.when(F.col("snps") > 0, F.col("k")).otherwise(F.lit(1).cast("long"))).alias("k"), F.when(shown, F.when(F.col("n") > 1, diverse * ratio).otherwise(0.0)).alias("kdiv"))


def ehhs(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """Haplotype diversity over that of the commonest split of two samples or more on either side.

    Populations of four samples or more; of equally common splits the first along the window counts.
    """
    rows = S.per_pop(found, pops, p, "complete").where("fq > 0 and covered and f > 1 and f < n - 1 and n >= 4")
    rows = rows.withColumn("split", G.canonical(F.col("mask"), F.col("pop_mask")))
    splits = rows.groupBy(*GROUP, "split", "n").agg(F.count("*").alias("c"), F.min("pos").alias("at"))
    top = splits.groupBy(*GROUP, "n").agg(F.max_by("split", F.struct(F.col("c"), -F.col("at"))).alias("split"))
    x, n = G.bits(F.col("split")).cast("double"), F.col("n").cast("double")
    site = F.lit(1.0) - (F.lit(1.0) - (x * x + (n - x) * (n - x)) / (n * n)) * F.try_divide(n, n - 1)
    haps = haplotype_keys(found, pops, p).groupBy(*GROUP, "hap").agg(F.count("*").alias("c")).groupBy(*GROUP).agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    whole = F.lit(1.0) - (F.lit(1.0) - F.col("squares").cast("double") / (n * n)) * F.try_divide(n, n - 1)
    per = top.join(haps, GROUP).select(*GROUP, F.try_divide(whole, site).alias("ehhs"))
    out = on_spine(spine, S.literal(pops), retained(found, pops, p).join(per, GROUP, "left"), ["pop_id"], ["num_sites"])
    return out.select(*WIN, "num_sites", "pop", F.when((F.col("num_sites") >= p.min_sites) & (F.col("snps") > 0), F.col("ehhs")).alias("ehhs"))


def sample_pairs(pops: list[S.Pop]) -> Column:
    """All pairs of samples i < j with their populations: a fixed small array."""
    owner = sorted((i, x) for x in pops for i in x.samples)
    made = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(min(a.pop_id, b.pop_id)).alias("pop1_id"), F.lit(max(a.pop_id, b.pop_id)).alias("pop2_id"))
        for k, (i, a) in enumerate(sorted(owner, key=lambda x: x[0]))
        for j, b in sorted(owner, key=lambda x: x[0])[k + 1 :]
    ]
    return F.array(*made) if made else F.array().cast("array<struct<i:int,j:int,pop1_id:int,pop2_id:int>>")


def pair_differences(found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """win_id, i, j, pop1_id, pop2_id, num_sites, aligned, differ for each pair of samples: sites where both pass, and differ.

    A site is first reduced to its distinct bit sets, so few rows meet the pairs.
    """
    few = S.kept(found, pops, p, "complete").groupBy("win_id", "cov_mask", "type_mask").agg(F.count("*").alias("c"))
    rows = few.select("*", F.explode(sample_pairs(pops)).alias("p")).select("*", "p.*")
    both = G.has_bit(F.col("cov_mask"), F.col("i")) & G.has_bit(F.col("cov_mask"), F.col("j"))
    apart = both & (G.has_bit(F.col("type_mask"), F.col("i")) != G.has_bit(F.col("type_mask"), F.col("j")))
    zero = F.lit(0).cast("long")
    return rows.groupBy("win_id", "i", "j", "pop1_id", "pop2_id").agg(F.sum("c").alias("num_sites"), F.sum(F.when(both, F.col("c")).otherwise(zero)).alias("aligned"), F.sum(F.when(apart, F.col("c")).otherwise(zero)).alias("differ"))


def gmin(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """Mean and smallest number of differences between two populations' samples, and their ratio."""
    per = pair_differences(found, pops, p).where("pop1_id <> pop2_id").groupBy("win_id", "pop1_id", "pop2_id").agg(F.first("num_sites").alias("num_sites"), F.avg("differ").alias("mean_dxy"), F.min("differ").alias("min_dxy"))
    out = on_spine(spine, S.literal_pairs(pops), per, ["pop1_id", "pop2_id"], ["num_sites"])
    shown = F.col("num_sites") >= p.min_sites
    values = {"mean_dxy": F.col("mean_dxy"), "min_dxy": F.col("min_dxy"), "gmin": F.try_divide(F.col("min_dxy").cast("double"), "mean_dxy")}
    return out.select(*WIN, "num_sites", "pop1", "pop2", *[F.when(shown, v).alias(k) for k, v in values.items()])


def pairwise_pi(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """Mean number of differences between two samples of a population, per aligned site."""
    per = pair_differences(found, pops, p).where("pop1_id = pop2_id").groupBy("win_id", F.col("pop1_id").alias("pop_id")).agg(F.first("num_sites").alias("num_sites"), F.avg("differ").alias("mean"))
    out = on_spine(spine, S.literal(pops), per, ["pop_id"], ["num_sites"])
    return out.select(*WIN, "num_sites", "pop", F.when(F.col("num_sites") >= p.min_sites, F.try_divide("mean", "num_sites")).alias("pi"))
