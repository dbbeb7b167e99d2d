"""Samples, populations, and sites as bit sets of samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.genomics import MOST_SAMPLES, bit, bits
from ..params import Params


@dataclass(frozen=True)
class Pop:
    pop_id: int
    name: str
    mask: int  # signed 64-bit
    n: int

    @property
    def samples(self) -> list[int]:
        return [i for i in range(MOST_SAMPLES) if self.mask >> i & 1]


def dictionary(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Ids from 0 in order of first appearance (column ``ord``)."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("ord"))
    # at most a few samples or populations: one small sort
    return first.select(F.col(key).alias(name), (F.row_number().over(Window.orderBy("ord", key)) - 1).alias(f"{name}_id"))


def sample_table(read_groups: DataFrame) -> DataFrame:
    """sample_id, sample, pop_id, pop, rg from @RG rows (rg, sample, pop, ord); without any population all are one."""
    named = read_groups.withColumn("sample", F.coalesce("sample", "rg"))
    if not named.where("pop is not null").take(1):
        named = named.withColumn("pop", F.lit("all"))
    samples, pops = dictionary(named, "sample", "sample"), dictionary(named, "pop", "pop")
    return named.join(F.broadcast(samples), "sample").join(F.broadcast(pops), "pop", "left").select("sample_id", "sample", "pop_id", "pop", "rg")


def single_sample(spark: SparkSession, name: str) -> DataFrame:
    """The table of samples where a header has no @RG line: one sample and one population, named after the file."""
    return spark.createDataFrame([(0, name, 0, name, None)], "sample_id int, sample string, pop_id int, pop string, rg string")


def population_of(pops: list[Pop], sample: int) -> Pop:
    """The population that a sample (as the outgroup) belongs to."""
    found = [x for x in pops if sample in x.samples]
    if not found:
        raise ValueError(f"sample {sample} is in no population")
    return found[0]


def assign_pops(samples: DataFrame) -> list[Pop]:
    """The populations with their bit sets; fails if a sample has none, or more than one.

    A site's bit set has 64 bits, so at most 64 samples can be used; the list is that small.
    """
    rows = samples.select("sample_id", "sample", "pop_id", "pop").distinct().orderBy("sample_id").limit(MOST_SAMPLES * 4).collect()
    if lost := [r["sample"] for r in rows if r["pop_id"] is None]:
        raise ValueError(f"samples without a population: {lost}")
    ids = [r["sample_id"] for r in rows]
    if len(set(ids)) != len(ids):
        raise ValueError("a sample is in two populations")
    if ids and max(ids) >= MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    out: dict[int, list] = {}
    for r in rows:
        entry = out.setdefault(r["pop_id"], [r["pop"], 0, 0])
        entry[1] |= 1 << r["sample_id"]
        entry[2] += 1
    return [Pop(k, name, mask - (1 << 64) if mask >> 63 else mask, n) for k, (name, mask, n) in sorted(out.items())]


def literal(pops: list[Pop]) -> Column:
    """The populations as an array of structs."""
    fields = lambda x: F.struct(F.lit(x.pop_id).alias("pop_id"), F.lit(x.name).alias("pop"), F.lit(x.mask).cast("long").alias("pop_mask"), F.lit(x.n).cast("long").alias("n"))
    return F.array(*map(fields, pops))


def literal_pairs(pops: list[Pop]) -> Column:
    pairs = [(a, b) for i, a in enumerate(pops) for b in pops[i + 1 :]]
    one = lambda x, s: [F.lit(x.pop_id).alias(f"pop{s}_id"), F.lit(x.name).alias(f"pop{s}"), F.lit(x.mask).cast("long").alias(f"mask{s}"), F.lit(x.n).cast("long").alias(f"n{s}")]
    made = [F.struct(*one(a, 1), *one(b, 2)) for a, b in pairs]
    return F.array(*made) if made else F.array().cast("array<struct<pop1_id:int,pop1:string,mask1:bigint,n1:bigint,pop2_id:int,pop2:string,mask2:bigint,n2:bigint>>")


def sites(calls: DataFrame) -> DataFrame:
    """One row a position: bit sets of the samples that pass, pass and are derived, and are derived at all."""
    b = bit(F.col("sample_id"))
    mask = lambda cond, name: F.bit_or(F.when(cond, b).otherwise(F.lit(0).cast("long"))).alias(name)
    return calls.groupBy("win_id", "chrom", "pos").agg(F.first("ref").alias("ref"), mask(F.col("pass"), "cov_mask"), mask(F.col("pass") & F.col("derived"), "type_mask"), mask(F.col("derived"), "derived_mask"), F.count_if("derived").alias("fq"))


def required(n: Column, p: Params) -> Column:
    """Samples of n that have to pass."""
    return F.floor(F.lit(float(p.min_pop)) * n + 0.4999).cast("long")


def _need(rule: str, p: Params):
    return (lambda n: n) if rule == "complete" else (lambda n: required(n, p))


def kept(found: DataFrame, pops: list[Pop], p: Params, rule: str = "proportion") -> DataFrame:
    """Retained sites: those that cover any population, in proportion ``min_pop``, or wholly with ``rule="complete"``."""
    need = _need(rule, p)
    return found.where(F.exists(literal(pops), lambda x: bits(F.col("cov_mask").bitwiseAND(x["pop_mask"])) >= need(x["n"])))


def per_pop(found: DataFrame, pops: list[Pop], p: Params, rule: str = "proportion") -> DataFrame:
    """A row for each retained site and population: ncov, f (derived), mask, n, covered."""
    need = _need(rule, p)
    # expressions over a handful of literals: no join and no exchange
    rows = kept(found, pops, p, rule).select("*", F.explode(literal(pops)).alias("p")).select("*", "p.*").drop("p")
    rows = rows.withColumn("mask", F.col("type_mask").bitwiseAND(F.col("pop_mask"))).withColumn("ncov", bits(F.col("cov_mask").bitwiseAND(F.col("pop_mask"))))
    return rows.withColumn("f", bits(F.col("mask"))).withColumn("covered", F.col("ncov") >= need(F.col("n")))


def per_pair(found: DataFrame, pops: list[Pop], p: Params) -> DataFrame:
    """A row for each retained site and pair of populations, with ncov, f and covered of both."""
    need = _need("proportion", p)
    rows = kept(found, pops, p).select("*", F.explode(literal_pairs(pops)).alias("p")).select("*", "p.*").drop("p")
    for s in (1, 2):
        rows = rows.withColumn(f"ncov{s}", bits(F.col("cov_mask").bitwiseAND(F.col(f"mask{s}")))).withColumn(f"f{s}", bits(F.col("type_mask").bitwiseAND(F.col(f"mask{s}"))))
        rows = rows.withColumn(f"covered{s}", F.col(f"ncov{s}") >= need(F.col(f"n{s}")))
    return rows


def all_pass(found: DataFrame, pops: list[Pop]) -> DataFrame:
    """Sites where every sample passes."""
    every = 0
    for x in pops:
        every |= x.mask
    return found.where(F.col("cov_mask").bitwiseAND(F.lit(every).cast("long")) == F.lit(every).cast("long"))


def infinite_sites(calls: DataFrame, p: Params) -> DataFrame:
    """Without the calls of positions whose samples that pass have more than two alleles, if asked for.

    Under the infinite sites model a position changes once; by default all are kept.
    """
    if not p.infinite_sites:
        return calls
    alleles = F.explode(F.array("a1", "a2")).alias("allele")
    many = calls.where("pass").select("chrom", "pos", alleles).distinct().groupBy("chrom", "pos").agg(F.count("*").alias("alleles")).where("alleles > 2")
    return calls.join(many.select("chrom", "pos"), ["chrom", "pos"], "left_anti")


def polarise(f: Column, n: Column, outgroup_derived: Column) -> Column:
    """Counts the other allele where the outgroup has the derived one."""
    return F.when(outgroup_derived, n - f).otherwise(f)
