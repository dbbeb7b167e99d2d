"""Nucleotide diversity, site-frequency-spectrum tests and divergence, per window.

All take ``sites`` (see :mod:`.sites`), the list of populations and the spine of
windows, and return long tables with a row for every window and population,
pair of populations, or sample.  Sums are partial aggregates over bit counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genomics as G
from ..params import Params
from . import sites as S

WIN = ["win_id", "chrom", "win_beg", "win_end"]


def on_spine(spine: DataFrame, keys: Column | None, found: DataFrame, by: list[str], zero: list[str]) -> DataFrame:
    """Every window (and every struct of ``keys``) with what was found, counts in ``zero`` 0 where nothing was."""
    full = spine if keys is None else spine.select("*", F.explode(keys).alias("k")).select("*", "k.*").drop("k")
    out = full.join(found.drop("chrom"), ["win_id", *by], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})


def enough(count: Column, p: Params, fraction: bool) -> Column:
    """Whether so many aligned sites are reported."""
    if fraction and p.reference:  # the count is taken for a share of the window
        return count >= F.floor((F.col("win_end") - F.col("win_beg")) * F.lit(float(p.min_sites)))
    if fraction and p.min_site_frac is not None:
        return count >= F.floor((F.col("win_end") - F.col("win_beg")) * F.lit(float(p.min_site_frac)))
    return count >= p.min_sites


def ratio_sums(rows: DataFrame, keys: list[str], num: Column, den: Column, **counts: Column) -> DataFrame:
    """``total``, the sum of num / den over whole numbers by ``keys``, and sums of ``counts``.

    Numerators of one denominator are added first, as whole numbers, and these few quotients in order
    of the denominator; so the total is the same in whatever order the rows come.
    """
    per = rows.groupBy(*keys, den.cast("long").alias("den")).agg(F.sum(num).alias("num"), *[c.alias(n) for n, c in counts.items()])
    parts = F.array_sort(F.collect_list(F.struct("den", "num")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["num"].cast("double") / x["den"].cast("double"))
    return per.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in counts], total.alias("total"))


def _square(n: Column, p: Params) -> Column:
    """Pairs' divisor: n (n - 1), or (n - 1) squared as the established tool has it."""
    return (n - 1) * (n - 1) if p.reference else n * (n - 1)


def nucleotide_diversity(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """ns and pi of each window and population."""
    rows = S.per_pop(found, pops, p)
    f, m = F.col("f"), F.col("ncov")
    counts = (F.col("fq") > 0) & (F.col("ncov") > 1)
    if not p.reference:
        counts &= F.col("covered")
    if p.no_singletons:
        counts &= F.col("f") > 1
    num, den = F.when(counts, 2 * f * (m - f)).otherwise(0), F.when(counts, _square(m, p)).otherwise(1)
    per = ratio_sums(rows, ["win_id", "pop_id"], num, den, ns=F.count_if("covered"))
    out = on_spine(spine, S.literal(pops), per, ["pop_id"], ["ns"])
    return out.select(*WIN, "pop", "ns", F.when(enough(F.col("ns"), p, False), F.try_divide("total", "ns")).alias("pi"))


def divergence_between(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """ns and d_xy of each window and pair of populations."""
    rows = S.per_pair(found, pops, p)
    f1, f2, m1, m2 = map(F.col, ("f1", "f2", "ncov1", "ncov2"))
    both = F.col("covered1") & F.col("covered2")
    counts = (F.col("fq") > 0) & (F.col("ncov1") > 0) & (F.col("ncov2") > 0)
    if not p.reference:
        counts &= both
    num, den = F.when(counts, f1 * (m2 - f2) + f2 * (m1 - f1)).otherwise(0), F.when(counts, m1 * m2).otherwise(1)
    per = ratio_sums(rows, ["win_id", "pop1_id", "pop2_id"], num, den, ns=F.count_if(both))
    out = on_spine(spine, S.literal_pairs(pops), per, ["pop1_id", "pop2_id"], ["ns"])
    return out.select(*WIN, "pop1", "pop2", "ns", F.when(enough(F.col("ns"), p, True), F.try_divide("total", "ns")).alias("dxy"))


def spectrum_weights(p: Params) -> tuple[list[list[float]], list[list[float]]]:
    """Per sample size and derived count the weights of D and H."""
    d, h = [], []
    for n in range(G.MOST_SAMPLES + 1):
        a1 = G.harmonic(n)
        square = ((n - 1) ** 2 if p.reference else n * (n - 1)) or 1
        pi = [2 * i * (n - i) / square if n > 1 else 0.0 for i in range(n + 1)]
        low = [i / (n - 1) if n > 1 else 0.0 for i in range(n + 1)]
        d.append([x - 1 / a1 if a1 else 0.0 for x in pi])
        h.append([(1 / a1 if a1 else 0.0) - x if p.reference else y - x for x, y in zip(low, pi, strict=True)])
    return d, h


def spectrum(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params, outgroup: int | None = None) -> DataFrame:
    """ns, S, Tajima's D and Fay and Wu's H of each window and population; ``outgroup`` is a sample."""
    rows = S.per_pop(found, pops, p)
    freq = F.col("f") if outgroup is None else S.polarise(F.col("f"), F.col("ncov"), G.has_bit(F.col("type_mask"), outgroup))
    rows = rows.withColumn("freq", freq)
    counts = (F.col("fq") > 0) & (F.col("freq") > 0) & (F.col("freq") < F.col("ncov"))
    if not p.reference:
        counts &= F.col("covered")
    d, h = spectrum_weights(p)
    most = max((x.n for x in pops), default=0)
    of = lambda table: F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in table[: most + 1]]), F.col("ncov").cast("int") + 1), F.col("freq").cast("int") + 1)
    per = rows.groupBy("win_id", "pop_id").agg(
        F.count_if("covered").alias("ns"),
        F.count_if(counts).alias("seg"),
        F.sum(F.when(counts, F.col("ncov"))).alias("size"),
        F.sum(F.when(counts, of(d))).alias("d_total"),
        F.sum(F.when(counts, of(h))).alias("h_total"),
    )
    out = on_spine(spine, S.literal(pops), per, ["pop_id"], ["ns", "seg"])
    n = F.floor(F.try_divide(F.col("size").cast("double"), F.col("seg")) + 0.4999)
    shown = enough(F.col("ns"), p, True) & (F.col("seg") > 0)
    return out.withColumn("m", n).select(*WIN, "pop", "ns", "seg", F.when(shown, G.tajima_d(F.col("d_total"), F.col("seg"), F.col("m"))).alias("tajima_d"), F.when(shown, G.faywu_h(F.col("h_total"), F.col("seg"), F.col("m"))).alias("faywu_h"))


def _corrected(x: Column, p: Params) -> Column:
    return G.jukes_cantor(x) if p.dist == "jc" else x


def divergence_individual(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params) -> DataFrame:
    """num_sites and each sample's distance from the reference sequence."""
    kept = S.all_pass(found, pops)
    samples = F.array(*[F.lit(i) for i in sorted(i for x in pops for i in x.samples)])
    rows = kept.select("win_id", "type_mask", F.explode(samples).alias("sample_id"))
    per = rows.groupBy("win_id", "sample_id").agg(F.count("*").alias("num_sites"), F.count_if(G.has_bit(F.col("type_mask"), F.col("sample_id"))).alias("differ"))
    out = on_spine(spine, F.transform(samples, lambda x: F.struct(x.alias("sample_id"))), per, ["sample_id"], ["num_sites", "differ"])
    share = F.try_divide(F.col("differ").cast("double"), "num_sites")
    return out.select(*WIN, "sample_id", "num_sites", F.when(F.col("num_sites") >= p.min_sites, _corrected(share, p)).alias("d"))


def divergence_population(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params, outgroup: int | None = None) -> DataFrame:
    """num_sites, fixed and segregating differences from the reference (or outgroup) and d of each population."""
    kept = S.all_pass(found, pops).select("*", F.explode(S.literal(pops)).alias("p")).select("*", "p.*")
    f = G.bits(F.col("type_mask").bitwiseAND(F.col("pop_mask")))
    freq = f if outgroup is None else S.polarise(f, F.col("n"), G.has_bit(F.col("type_mask"), outgroup))
    kept = kept.withColumn("freq", freq)
    per = kept.groupBy("win_id", "pop_id").agg(
        F.count("*").alias("num_sites"), F.count_if((F.col("fq") > 0) & (F.col("freq") == F.col("n"))).alias("fixed"), F.count_if((F.col("fq") > 0) & (F.col("freq") > (1 if p.no_singletons else 0)) & (F.col("freq") < F.col("n"))).alias("seg")
    )
    out = on_spine(spine, S.literal(pops), per, ["pop_id"], ["num_sites", "fixed", "seg"])
    share = F.try_divide((F.col("fixed") if p.substitutions_only else F.col("fixed") + F.col("seg")).cast("double"), "num_sites")
    return out.select(*WIN, "pop", "num_sites", "fixed", "seg", F.when(F.col("num_sites") >= p.min_sites, _corrected(share, p)).alias("d"))
