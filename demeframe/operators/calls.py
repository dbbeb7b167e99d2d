"""Genotype likelihoods and consensus calls.

The error model's dependence on the number of reads is a table of fixed size (at
most 60 qualities times 255 depths), which is broadcast; all else is windows
and sums over (chrom, pos, sample), so one exchange by position serves them all.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import Params

#: Fixed values of the error model: dependence of errors in one direction, its floor, and the deepest pileup it takes.
DEPENDENCE, FLOOR, DEEPEST = float(np.float32(0.17)), 0.03, 255
GENOTYPES = [(i, j) for i in range(4) for j in range(i, 4)]


def strand_weight(rank: Column) -> Column:
    """Weight of the n-th read of one base and strand."""
    return F.when(rank == 0, F.lit(1.0)).otherwise(F.pow(F.lit(1 - DEPENDENCE), rank.cast("double")) * (1 - FLOOR) + FLOOR)


@lru_cache(4)
def error_table(deepest: int) -> list[list[np.ndarray]]:
    """[q - 4][n - 1]: for k errors among n reads of quality q the phred score of one more, k < n.

    Binomial tails, summed from the far end in extended precision.
    """
    log_fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, deepest + 1, dtype=np.longdouble))))).astype(np.longdouble)
    out = []
    for q in range(4, 64):
        e = np.longdouble(10) ** (np.longdouble(-q) / 10)
        rows = []
        for n in range(1, deepest + 1):
            i = np.arange(n + 1)
            terms = np.exp(log_fact[n] - log_fact[i] - log_fact[n - i] + i * np.log(e) + (n - i) * np.log1p(-e))
            tails = np.cumsum(terms[::-1])[::-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                value = -10 / np.log(np.longdouble(10)) * np.log(tails[1:] / tails[:-1])
            rows.append(value.astype(np.float64))
        out.append(rows)
    return out


_frames: dict[tuple[str, int], DataFrame] = {}


def error_frame(spark: SparkSession, deepest: int = DEEPEST) -> DataFrame:
    """qq, n and an array over k; made once a session."""
    key = (spark.sparkContext.applicationId, deepest)
    if key not in _frames:
        table = error_table(deepest)
        q = np.repeat(np.arange(4, 64), deepest)
        n = np.tile(np.arange(1, deepest + 1), 60)
        beta = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), np.concatenate([x for rows in table for x in rows]))
        _frames.clear()
        _frames[key] = spark.createDataFrame(pa.table({"qq": pa.array(q, pa.int32()), "n": pa.array(n, pa.int32()), "beta": beta}))
    return _frames[key]


@lru_cache(1)
def _log_factorials() -> str:
    return f"array({', '.join(f'{math.lgamma(i + 1)!r}D' for i in range(DEEPEST + 1))})"


def likelihoods(bases: DataFrame, p: Params) -> DataFrame:
    """Per chrom, pos, sample_id: depth, rms and the phred likelihoods lk_ij of the ten genotypes.

    ``bases`` has base, qq, strand, mapq, ord; beyond DEEPEST bases a fixed pseudo-random choice counts.
    """
    cell = ["chrom", "pos", "sample_id"]
    if p.max_depth > DEEPEST:
        chosen = Window.partitionBy(*cell).orderBy(F.xxhash64("ord"), "ord")
        bases = bases.withColumn("pick", F.row_number().over(chosen)).where(F.col("pick") <= DEEPEST).drop("pick")
    best = [F.desc("qq"), F.desc("strand"), F.asc("ord")]
    whole = Window.partitionBy(*cell)
    ranked = bases.select(
        *cell,
        "base",
        "qq",
        F.col("mapq").cast("long").alias("mapq"),
        (F.row_number().over(Window.partitionBy(*cell, "base", "strand").orderBy(*best)) - 1).alias("w"),
        (F.row_number().over(Window.partitionBy(*cell, "base").orderBy(*best)) - 1).alias("c"),
        F.count("*").over(whole).cast("int").alias("n"),
    )
    deepest = min(p.max_depth, DEEPEST)
    table = F.broadcast(error_frame(bases.sparkSession, max(1, deepest)))  # 60 * deepest rows
    term = strand_weight(F.col("w")) * F.element_at("beta", F.col("c") + 1)
    scored = ranked.join(table, ["qq", "n"]).withColumn("term", term)
    # texts rather than column objects: a plan of this size is otherwise built for longer than it runs
    sums = [f"sum(case when base = {b} then term else 0D end) as s{b}" for b in range(4)]
    counts = [f"count_if(base = {b}) as c{b}" for b in range(4)]
    rms = "cast(floor(sqrt(sum(mapq * mapq) / count(*)) + 0.499D) as int) as rms"
    cells = scored.groupBy(*cell).agg(*map(F.expr, ["cast(count(*) as int) as depth", rms, *sums, *counts]))
    return cells.withColumn("log_factorials", F.expr(_log_factorials())).selectExpr(*cell, "depth", "rms", *[f"{_likelihood(i, j)} as lk_{i}{j}" for i, j in GENOTYPES])


def _likelihood(i: int, j: int) -> str:
    """Of a genotype: the other bases' errors, and for two alleles the chance of so many reads of each."""
    others = " + ".join(f"s{k}" for k in range(4) if k not in (i, j))
    if i == j:
        return f"greatest({others}, 0D)"
    at = lambda n: f"element_at(log_factorials, cast({n} + 1 as int))"
    return f"greatest({others} - 4.343D * ({at(f'c{i} + c{j}')} - {at(f'c{j}')} - {at(f'c{i}')} - (c{i} + c{j}) * {math.log(2)!r}D), 0D)"


def consensus(cells: DataFrame) -> DataFrame:
    """The likeliest genotype (a1 <= a2; the first of equal ones) and snpq, the gap to the next."""
    ranked = ", ".join(f"struct(lk_{i}{j} as lk, {4 * i + j} as g)" for i, j in GENOTYPES)
    best, second = "element_at(ranked, 1)", "element_at(ranked, 2)"
    with_rank = cells.withColumn("ranked", F.expr(f"array_sort(array({ranked}))"))
    return with_rank.selectExpr("chrom", "pos", "sample_id", f"{best}.g div 4 as a1", f"{best}.g % 4 as a2", "depth", f"cast(floor({second}.lk - {best}.lk + 0.499D) as int) as snpq", "rms").withColumn("a1", F.col("a1").cast("int"))


def call(pileup: DataFrame, p: Params) -> DataFrame:
    """Calls of covered cells, from a raw pileup."""
    from .pileup import cap_depth, filter_bases

    return consensus(likelihoods(filter_bases(cap_depth(pileup, p), p), p))


def clean_heterozygotes(calls: DataFrame, p: Params) -> DataFrame:
    """Confident heterozygotes become homozygous for the other allele than ``ref``, unsure ones for ``ref``.

    Without ``ref`` among their alleles, confident ones stay.  A given ``het_prior`` leaves all as they are.
    """
    if p.het_prior is not None:
        return calls
    a1, a2, ref = F.col("a1"), F.col("a2"), F.col("ref")
    het, sure, own = a1 != a2, F.col("snpq") >= p.min_snpq, (a1 == ref) | (a2 == ref)
    other = F.when(a1 == ref, a2).otherwise(a1)
    unsure = (a2, a1) if p.reference else (ref, ref)
    new = [F.when(het & own, F.when(sure, other).otherwise(ref)).when(het & ~sure, u).otherwise(a) for a, u in zip((a1, a2), unsure, strict=True)]
    return calls.withColumns({"a1": new[0], "a2": new[1]})


def mark_derived(calls: DataFrame, p: Params) -> DataFrame:
    """``derived``: a confident call other than ``ref``; unsure homozygotes go back to ``ref``."""
    a1, a2, ref = F.col("a1"), F.col("a2"), F.col("ref")
    sure, homozygous = F.col("snpq") >= p.min_snpq, a1 == a2
    known = ref.between(0, 3)
    derived = sure & (~homozygous | (a1 != ref))
    back = homozygous & (a1 != ref) & ~sure & known
    return calls.withColumn("derived", F.coalesce(derived, F.lit(False))).withColumns({"a1": F.when(back, ref).otherwise(a1), "a2": F.when(back, ref).otherwise(a2)})


def mark_pass(calls: DataFrame, p: Params) -> DataFrame:
    """``pass``: mapping quality and depth within bounds."""
    return calls.withColumn("pass", (F.col("rms") >= p.min_rms) & F.col("depth").between(p.min_depth, p.max_depth))


def classify(calls: DataFrame, ref_bases: DataFrame, p: Params) -> DataFrame:
    """Calls with ``ref`` (0 to 3), cleaned and marked.

    Sites whose reference is no base are left out; ``compat="reference"`` keeps
    them, as code 4, and takes lower-case reference bases for such as well.
    """
    from ..functions.genomics import base_code

    ref = F.col("ref_base")
    code = base_code(ref)
    if p.reference:
        code = F.coalesce(F.when(ref == F.upper(ref), code), F.lit(4))
    with_ref = calls.join(ref_bases.select("chrom", "pos", F.col("ref").alias("ref_base")), ["chrom", "pos"]).withColumn("ref", code).drop("ref_base").where("ref is not null")
    return mark_pass(mark_derived(clean_heterozygotes(with_ref, p), p), p)
