"""Linkage disequilibrium per window and population: ZnS, omega-max, Wall's B and Q.

Sites are bit sets, so r squared is a few bit counts.  ZnS and Wall's statistics
are relational; ZnS looks at pairs of distinct bit sets only.  Omega-max needs every split of a window, so a grouped Arrow
function takes each window's bit sets (two numbers a site) with prefix sums; it works in blocks of
rows, so its memory grows with the sites and not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genomics as G
from ..params import Params
from . import sites as S
from .diversity import WIN, on_spine, ratio_sums

GROUP = ["win_id", "pop_id"]
#: Tasks over which the pairs of one window and population are dealt; pairs that omega holds at once.
BLOCKS, PAIRS = 16, 4_000_000


def _varies(p: Params) -> Column:
    """Whether a site is a SNP of the population.

    Only sites where the whole population passes count; the established tool takes all retained ones.
    """
    least = 2 if p.no_singletons else 1
    out = (F.col("fq") > 0) & (F.col("f") >= least) & (F.col("f") <= F.col("n") - least)
    return out if p.reference else out & F.col("covered")


def snps(found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """SNPs with x derived of n samples, numbered k by position within window and population."""
    rows = S.per_pop(found, pops, p, "complete").where(_varies(p))
    return rows.select(*GROUP, "pos", "mask", "pop_mask", "n", F.col("f").alias("x"), F.row_number().over(Window.partitionBy(*GROUP).orderBy("pos")).alias("k"))


def counted(found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """s and num_sites of each window and population, from one pass over the same rows as the SNPs.

    A retained site has a row for each population, so rows are sites.  As the established tool has it, the
    last segregating site is counted whether it varies or not.
    """
    rows = S.per_pop(found, pops, p, "complete").withColumn("snp", _varies(p))
    per = rows.groupBy(*GROUP).agg(F.count("*").alias("num_sites"), F.count_if("snp").alias("s"), F.max(F.when(F.col("snp"), F.col("pos"))).alias("last"), F.max(F.when(F.col("fq") > 0, F.col("pos"))).alias("end"))
    s = F.col("s") + F.when(F.col("end").isNotNull() & ~F.col("last").eqNullSafe(F.col("end")), 1).otherwise(0) if p.reference else F.col("s")
    return per.select(*GROUP, "num_sites", s.cast("long").alias("s"))


def _pairs(rows: DataFrame, first: dict[str, str], second: dict[str, str], block: Column) -> DataFrame:
    """Pairs within a window and population: the second's rows are dealt over blocks, to which the first's are copied."""
    a = rows.select(*GROUP, "n", *[F.col(k).alias(v) for k, v in first.items()], F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    b = rows.select(*GROUP, *[F.col(k).alias(v) for k, v in second.items()], F.pmod(block, F.lit(BLOCKS)).cast("int").alias("block"))
    return a.join(b, [*GROUP, "block"])


def _ratio() -> tuple[Column, Column]:
    """r2 as a fraction of whole numbers."""
    x0, x1, n = map(F.col, ("x0", "x1", "n"))
    cov = x0 * x1 - n * G.bits(F.col("m0").bitwiseAND(F.col("m1")))
    return cov * cov, (n - x0) * x0 * (n - x1) * x1


def r_squared(rows: DataFrame) -> DataFrame:
    """r2 of each pair i < j of a window and population's SNPs."""
    pairs = _pairs(rows, {"k": "i", "mask": "m0", "x": "x0"}, {"k": "j", "mask": "m1", "x": "x1"}, F.col("k")).where("i < j")
    num, den = _ratio()
    return pairs.select(*GROUP, "i", "j", F.try_divide(num.cast("double"), den.cast("double")).alias("r2"))


def _shown(per: DataFrame, spine: DataFrame, pops: list[S.Pop], p: Params, values: list[str]) -> DataFrame:
    out = on_spine(spine, S.literal(pops), per, ["pop_id"], ["s", "num_sites"])
    shown = F.col("s") >= p.min_snps
    if not p.reference:
        shown &= F.col("num_sites") >= p.min_sites
    return out.select(*WIN, "num_sites", "pop", "s", *[F.when(shown, F.col(v)).alias(v) for v in values])


def zns(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """Kelly's ZnS: the mean of r squared."""
    few = snps(found, pops, p).groupBy(*GROUP, "mask", "x", "n").agg(F.count("*").alias("c"))
    pairs = _pairs(few, {"mask": "m0", "x": "x0", "c": "c0"}, {"mask": "m1", "x": "x1", "c": "c1"}, F.xxhash64("mask")).where("m0 <= m1")
    times = F.when(F.col("m0") == F.col("m1"), F.expr("c0 * (c0 - 1) div 2")).otherwise(F.col("c0") * F.col("c1"))
    num, den = _ratio()
    total = ratio_sums(pairs.where(den > 0), GROUP, num.cast("decimal(20,0)") * times, den)
    per = counted(found, pops, p).join(total, GROUP, "left")
    per = per.select(*GROUP, "s", "num_sites", F.try_divide(F.lit(2.0) * F.col("total"), (F.col("s") * (F.col("s") - 1)).cast("double")).alias("zns"))
    return _shown(per, spine, pops, p, ["zns"])


def omega_of(mask: np.ndarray, x: np.ndarray, n: int, cumulative: bool = False) -> float | None:
    """The largest omega over all splits with two SNPs on either side; ``cumulative`` adds up sums over splits."""
    s = len(mask)
    if s < 4:
        return None
    xs = x.astype(float)
    spread = (n - xs) * xs
    before, behind = np.zeros(s), np.zeros(s)  # each SNP's sum with those in front of it, and behind it
    for a in range(0, s, step := max(1, PAIRS // s)):
        own = slice(a, a + step)
        both = np.bitwise_count((mask[own, None] & mask[None, a:]).view(np.uint64)).astype(float)
        r2 = np.triu((xs[own, None] * xs[None, a:] - n * both) ** 2 / spread[own, None] / spread[None, a:], 1)
        behind[own] = r2.sum(1)
        before[a:] += r2.sum(0)
    inside = np.concatenate(([0.0], np.cumsum(before)))  # pairs with both among the first l
    after = np.concatenate((np.cumsum(behind[::-1])[::-1], [0.0]))  # pairs from l on
    total, best = before.sum(), None
    left_sum = right_sum = between_sum = 0.0
    for left in range(2, s if cumulative else s - 1):
        a, b = inside[left], after[left]
        c = total - a - b
        if cumulative:
            left_sum, right_sum, between_sum = left_sum + a, right_sum + b, between_sum + c
            a, b, c = left_sum, right_sum, between_sum
        right = s - left
        pairs = left * (left - 1) / 2 + right * (right - 1) / 2
        if c > 1e-12:
            value = (a + b) / pairs * left * right / c
            best = value if best is None or value > best else best
    return best


def omega_max(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    cumulative = p.reference

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        value = omega_of(table.column("mask").to_numpy(), table.column("x").to_numpy(), table.column("n")[0].as_py(), cumulative)
        return pa.table({"win_id": table.column("win_id").slice(0, 1), "pop_id": table.column("pop_id").slice(0, 1), "omega": pa.array([value], pa.float64())})

    rows = snps(found, pops, p).select(*GROUP, "k", "mask", "x", "n")
    best = rows.groupBy(*GROUP).applyInArrow(run, "win_id long, pop_id int, omega double")
    per = counted(found, pops, p).join(best, GROUP, "left")
    return _shown(per, spine, pops, p, ["omega"])


def wall(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """Wall's B and Q: adjacent SNPs that split the population alike, and such splits."""
    rows = snps(found, pops, p).withColumn("split", G.canonical(F.col("mask"), F.col("pop_mask")))
    before = F.lag("split").over(Window.partitionBy(*GROUP).orderBy("pos"))
    rows = rows.withColumn("same", F.coalesce(F.col("split") == before, F.lit(False)))
    found_splits = rows.groupBy(*GROUP).agg(F.count("*").alias("m"), F.count_if("same").alias("b"), F.count_distinct(F.when(F.col("same"), F.col("split"))).alias("a"))
    per = counted(found, pops, p).join(found_splits, GROUP, "left")
    per = per.select(*GROUP, "s", "num_sites", F.try_divide(F.col("b").cast("double"), F.col("m") - 1).alias("wall_b"), F.try_divide((F.col("b") + F.col("a")).cast("double"), "m").alias("wall_q"))
    return _shown(per, spine, pops, p, ["wall_b", "wall_q"])
