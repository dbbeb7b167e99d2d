"""Registered queries of the engine over the adapter's pileup, and their SQL for DuckDB.

Each SQL text is written from the formulas, not from the plans, and shares
common table expressions down to the sites.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import genomics as G
from .operators import calls as C
from .operators import diversity, haplotypes, linkage, pileup, snps, tree
from .operators import sites as S
from .operators.windows import parse_region, spine, with_window
from .params import Params
from .plans import formats
from .plans.commands import Prepared, prepare
from .sources import adapter, alignments, fasta, header

#: The adapter's depths are about three, so little depth and quality is asked for.
P = Params(min_depth=1, min_snpq=3, window=100, min_pop=0.75, min_sites=10, min_snps=4)
NAMES = [f"s{i}" for i in range(adapter.SAMPLES)]


def prepared(spark: SparkSession, d: str, p: Params = P) -> Prepared:
    return prepare(spark, adapter.pileup(spark, d), adapter.ref_bases(spark, d), adapter.POPS, NAMES, adapter.region(spark, d), p)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 5) for n in names})


def _on_sites(make: Callable[[Prepared], DataFrame], *floats: str, **over) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rounded(make(prepared(spark, d, replace(P, **over))), *floats)


def _args(x: Prepared) -> tuple:
    return x.sites, x.pops, x.spine, x.params


PILE = """
pile as (
  select 'chr1' as chrom, cast(l_partkey as int) as pos, cast(l_suppkey % 8 as int) as sample_id,
    cast(case when l_linenumber = 7 then (l_partkey + 2) % 4
              when (l_partkey * 7 + (l_suppkey % 8) * 13) % 11 < 3 then (l_partkey + 1) % 4
              else l_partkey % 4 end as int) as base,
    cast(l_quantity as int) as baseq, cast(20 + round(l_discount * 100) * 4 as int) as mapq,
    case when l_linestatus = 'F' then 1 else 0 end as strand, cast(l_orderkey * 10 + l_linenumber as bigint) as ord
  from lineitem),
refs as (select cast(p_partkey as int) as pos, cast(p_partkey % 4 as int) as ref from part),
region as (select cast(max(p_partkey) + 1 as bigint) as stop from part),
spine as (
  select w as win_id, 'chr1' as chrom, cast(w * 100 as int) as win_beg, cast(least((w + 1) * 100, stop) as int) as win_end
  from region, unnest(range(0, (stop + 99) // 100)) as t(w)),
pops as (select * from (values (0, 'popA', cast(15 as bigint), cast(4 as bigint)), (1, 'popB', 240, 4)) as t(pop_id, pop, pop_mask, n)),
capped as (select * from (select *, row_number() over (partition by pos, sample_id order by ord) as rk from pile where pos < (select stop from region)) where rk <= 255),
bases as (
  select *, least(greatest(least(baseq, mapq), 4), 63) as qq from capped
  where baseq >= 13 and mapq >= 13 and base between 0 and 3),
ranked as (
  select *,
    row_number() over (partition by pos, sample_id, base, strand order by qq desc, strand desc, ord) - 1 as w,
    row_number() over (partition by pos, sample_id, base order by qq desc, strand desc, ord) - 1 as c,
    count(*) over (partition by pos, sample_id) as n
  from bases),
terms as (
  select q, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(pow(10e0, -q / 10e0)) + (n - i) * ln(1 - pow(10e0, -q / 10e0))) as t
  from unnest(range(4, 64)) as a(q), (select distinct n from ranked) as b, unnest(range(0, n + 1)) as c(i)),
tails as (select q, n, i, sum(t) over (partition by q, n order by i desc) as tail from terms),
beta as (select a.q, a.n, a.i as k, -10e0 / ln(10e0) * ln(b.tail / a.tail) as v from tails a join tails b on a.q = b.q and a.n = b.n and b.i = a.i + 1),
scored as (
  select r.*, (case when w = 0 then 1e0 else pow(1e0 - 0.17000000178813934e0, w) * 0.97e0 + 0.03e0 end) * v as term
  from ranked r join beta on q = qq and beta.n = r.n and k = c),
cells as (
  select chrom, pos, sample_id, cast(count(*) as int) as depth, cast(floor(sqrt(sum(mapq * mapq) / cast(count(*) as double)) + 0.499e0) as int) as rms,
    sum(case when base = 0 then term else 0e0 end) as s0, sum(case when base = 1 then term else 0e0 end) as s1,
    sum(case when base = 2 then term else 0e0 end) as s2, sum(case when base = 3 then term else 0e0 end) as s3,
    count_if(base = 0) as c0, count_if(base = 1) as c1, count_if(base = 2) as c2, count_if(base = 3) as c3
  from scored group by chrom, pos, sample_id),
lks as (
  select chrom, pos, sample_id, depth, rms, {lks}
  from cells),
long_lk as (
  select chrom, pos, sample_id, depth, rms, g, lk
  from (select chrom, pos, sample_id, depth, rms, unnest([{names}]) as lk, unnest([{codes}]) as g from lks)),
placed as (select *, row_number() over (partition by pos, sample_id order by lk, g) as r from long_lk),
calls as (
  select chrom, pos, sample_id, cast(max(case when r = 1 then g // 4 end) as int) as a1, cast(max(case when r = 1 then g % 4 end) as int) as a2, max(depth) as depth,
    cast(floor(max(case when r = 2 then lk end) - max(case when r = 1 then lk end) + 0.499e0) as int) as snpq, max(rms) as rms
  from placed where r <= 2 group by chrom, pos, sample_id),
with_ref as (select calls.*, ref, cast(pos // 100 as bigint) as win_id from calls join refs using (pos)),
clean as (
  select * exclude (a1, a2),
    case when a1 = a2 then a1 when a1 = ref then (case when snpq >= 3 then a2 else ref end) when a2 = ref then (case when snpq >= 3 then a1 else ref end) when snpq >= 3 then a1 else ref end as a1,
    case when a1 = a2 then a2 when a1 = ref then (case when snpq >= 3 then a2 else ref end) when a2 = ref then (case when snpq >= 3 then a1 else ref end) when snpq >= 3 then a2 else ref end as a2
  from with_ref),
marked as (
  select chrom, pos, sample_id, win_id, ref, depth, snpq, rms,
    case when a1 = a2 and a1 <> ref and snpq < 3 then ref else a1 end as a1, case when a1 = a2 and a1 <> ref and snpq < 3 then ref else a2 end as a2,
    snpq >= 3 and (a1 <> a2 or a1 <> ref) as derived, rms >= 25 and depth between 1 and 255 as ok
  from clean),
sites as (
  select win_id, chrom, pos, max(ref) as ref,
    cast(bit_or(case when ok then cast(1 as bigint) << sample_id else 0 end) as bigint) as cov_mask,
    cast(bit_or(case when ok and derived then cast(1 as bigint) << sample_id else 0 end) as bigint) as type_mask,
    cast(bit_or(case when derived then cast(1 as bigint) << sample_id else 0 end) as bigint) as derived_mask, count_if(derived) as fq
  from marked group by win_id, chrom, pos),
popped as (
  select s.*, p.*, s.type_mask & p.pop_mask as mask, cast(bit_count(s.cov_mask & p.pop_mask) as bigint) as ncov, cast(bit_count(s.type_mask & p.pop_mask) as bigint) as f
  from sites s, pops p),
per_pop as (
  select * from (select *, ncov >= 3 as covered, max(case when ncov >= 3 then 1 else 0 end) over (partition by pos) as kept from popped) where kept = 1),
per_full as (
  select * from (select *, ncov = n as covered, max(case when ncov = n then 1 else 0 end) over (partition by pos) as kept from popped) where kept = 1),
per_pair as (
  select a.win_id, a.pos, a.fq, a.pop as pop1, b.pop as pop2, a.f as f1, b.f as f2, a.ncov as ncov1, b.ncov as ncov2, a.covered as covered1, b.covered as covered2, a.n as n1, b.n as n2
  from per_pop a join per_pop b on a.pos = b.pos and a.pop_id < b.pop_id),
windows_pop as (select spine.*, pops.* from spine, pops),
aligned as (select win_id, count(distinct pos) as num_sites from per_full group by win_id),
full_cov as (select * from sites where cov_mask & 255 = 255),
snps as (
  select *, row_number() over (partition by win_id, pop_id order by pos) as k
  from per_full where covered and fq > 0 and f >= 1 and f <= n - 1),
split as (select *, case when mask & (pop_mask & -pop_mask) <> 0 then xor(pop_mask, mask) else mask end as side from snps),
lags as (select *, coalesce(side = lag(side) over (partition by win_id, pop_id order by pos), false) as same from split),
r2 as (
  select a.win_id, a.pop_id, a.k as i, b.k as j,
    pow(cast(a.f * b.f - a.n * cast(bit_count(a.mask & b.mask) as bigint) as double), 2) / ((a.n - a.f) * a.f * (a.n - b.f) * b.f) as r2,
    (a.n - a.f) * a.f * (a.n - b.f) * b.f as den, (a.f * b.f - a.n * cast(bit_count(a.mask & b.mask) as bigint)) * (a.f * b.f - a.n * cast(bit_count(a.mask & b.mask) as bigint)) as num
  from snps a join snps b on a.win_id = b.win_id and a.pop_id = b.pop_id and a.k < b.k),
counts as (select win_id, pop_id, count(*) as s from snps group by 1, 2),
haps as (
  select win_id, pop_id, sample_id, string_agg(case when (mask >> sample_id) & 1 = 1 then '1' else '0' end, '' order by pos) as hap
  from snps, (select unnest(range(0, 8)) as sample_id) where (pop_mask >> sample_id) & 1 = 1 group by 1, 2, 3),
hap_counts as (select win_id, pop_id, hap, count(*) as c from haps group by 1, 2, 3),
hap_div as (select win_id, pop_id, count(*) as k, cast(sum(c * c) as double) / 16 as hom from hap_counts group by 1, 2),
samples as (select unnest(range(0, 8)) as sample_id),
pair_diff as (
  select win_id, i, j, sum(case when (cov_mask >> i) & 1 = 1 and (cov_mask >> j) & 1 = 1 then 1 else 0 end) as aligned,
    sum(case when (cov_mask >> i) & 1 = 1 and (cov_mask >> j) & 1 = 1 and (type_mask >> i) & 1 <> (type_mask >> j) & 1 then 1 else 0 end) as differ
  from (select distinct win_id, pos, cov_mask, type_mask from per_full), (select a.sample_id as i, b.sample_id as j from samples a join samples b on a.sample_id < b.sample_id)
  group by 1, 2, 3),
diffs as (
  select win_id, i, j, count(*) as num_sites, count_if(fq > 0) as seg,
    count_if((case when i = 0 then 0 else (type_mask >> (i - 1)) & 1 end) <> ((type_mask >> (j - 1)) & 1)) as differ
  from full_cov, (select a.t as i, b.t as j from unnest(range(0, 9)) as a(t) join unnest(range(1, 9)) as b(t) on a.t < b.t)
  group by 1, 2, 3)
"""


def _lk(i: int, j: int) -> str:
    others = " + ".join(f"s{k}" for k in range(4) if k not in (i, j))
    if i == j:
        return f"greatest({others}, 0e0) as lk_{i}{j}"
    n, k = f"(c{i} + c{j})", f"c{j}"
    return f"greatest({others} - 4.343e0 * (lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) - {n} * ln(2e0)), 0e0) as lk_{i}{j}"


BASE = PILE.format(lks=", ".join(_lk(*g) for g in C.GENOTYPES), names=", ".join(f"lk_{i}{j}" for i, j in C.GENOTYPES), codes=", ".join(str(4 * i + j) for i, j in C.GENOTYPES))


def sql(select: str) -> str:
    return f"with {BASE}\n{select}"


WIN_SQL = "w.win_id, w.chrom, w.win_beg, w.win_end"
A1 = "(1e0 + 1e0 / 2 + 1e0 / 3)"
SPECTRUM = f"""
select {WIN_SQL}, w.pop, coalesce(ns, 0) as ns, coalesce(seg, 0) as seg,
  case when ns >= 10 and seg > 0 and m >= 4 then round(d / nullif(sqrt(e1 * seg + e2 * seg * (seg - 1)), 0), 5) end as tajima_d,
  case when ns >= 10 and seg > 0 and m > 1 and v > 0 then round(h / sqrt(v), 5) end as faywu_h
from windows_pop w left join (
  select *, (b1 - 1 / a1) / a1 as e1, (b2 - (m + 2) / (a1 * m) + a2 / (a1 * a1)) / (a1 * a1 + a2) as e2,
    (m - 2) * (seg / a1) / (6 * (m - 1)) + seg * (seg - 1) / (a1 * a1 + a2) * (18 * m * m * (3 * m + 2) * (a2 + 1 / (m * m)) - (88 * m * m * m + 9 * m * m - 13 * m + 6)) / (9 * m * (m - 1) * (m - 1)) as v
  from (
    select *, list_sum([1e0 / x for x in range(1, cast(m as bigint))]) as a1, list_sum([1e0 / (x * x) for x in range(1, cast(m as bigint))]) as a2,
      (m + 1) / (3 * (m - 1)) as b1, 2 * (m * m + m + 3) / (9 * m * (m - 1)) as b2
    from (
      select win_id, pop_id, count_if(covered) as ns, count_if(use) as seg, floor(sum(case when use then ncov end) / cast(nullif(count_if(use), 0) as double) + 0.4999e0) as m,
        sum(case when use then pi - 1 / (case when ncov = 4 then {A1} when ncov = 3 then 1.5e0 else 1e0 end) end) as d, sum(case when use then pi - freq / cast(ncov - 1 as double) end) as h
      from (select *, fq > 0 and freq > 0 and freq < ncov and covered as use, 2 * freq * (ncov - freq) / nullif(cast(ncov * (ncov - 1) as double), 0) as pi
            from (select *, {{freq}} as freq from per_pop))
      group by 1, 2)
    )) x on x.win_id = w.win_id and x.pop_id = w.pop_id"""

ALIGNED = "left join aligned a on a.win_id = w.win_id"
LD = f"""select {WIN_SQL}, coalesce(num_sites, 0) as num_sites, w.pop, coalesce(s, 0) as s, %s
from windows_pop w left join counts c on c.win_id = w.win_id and c.pop_id = w.pop_id {ALIGNED}
left join (%s) x on x.win_id = w.win_id and x.pop_id = w.pop_id"""
SHOWN = "s >= 4 and num_sites >= 10"
DIV_POP = f"""select {WIN_SQL}, w.pop, coalesce(num_sites, 0) as num_sites, coalesce(fixed, 0) as fixed, coalesce(seg, 0) as seg, case when num_sites >= 10 then %s end as d
from windows_pop w left join (
  select win_id, pop_id, count(*) as num_sites, count_if(fq > 0 and f = n) as fixed, count_if(fq > 0 and f > 0 and f < n) as seg
  from popped where cov_mask & 255 = 255 group by 1, 2) x on x.win_id = w.win_id and x.pop_id = w.pop_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], select: str | None = None) -> None:
    QUERIES[name] = query
    if select:
        ORACLE_SQL[name] = sql(select)


_add("w2_windows", lambda s, d: spine(s, adapter.region(s, d), P), "select * from spine")
_add("w4_window_counts", lambda s, d: with_window(adapter.pileup(s, d), adapter.region(s, d), P).groupBy("win_id").agg(F.count("*").alias("n_bases")), "select cast(pos // 100 as bigint) as win_id, count(*) as n_bases from pile where pos < (select stop from region) group by 1")
_add("p7_depth_cap", lambda s, d: pileup.cap_depth(adapter.pileup(s, d), replace(P, max_depth=2)).groupBy("pos", "sample_id").agg(F.count("*").alias("kept"), F.max("ord").alias("last_ord")), "select pos, sample_id, count(*) as kept, max(ord) as last_ord from (select *, row_number() over (partition by pos, sample_id order by ord) as r from pile) where r <= 2 group by 1, 2")
_add("p8_illumina", lambda s, d: adapter.pileup(s, d).select("ord", pileup.base_quality(F.col("baseq"), replace(P, illumina=True)).alias("q")), "select ord, greatest(baseq - 31, 0) as q from pile")
_add("p9_filter", lambda s, d: pileup.filter_bases(adapter.pileup(s, d), P).select("ord", "pos", "sample_id", "base"), "select ord, pos, sample_id, base from pile where baseq >= 13 and mapq >= 13")
_add("p11_effective_quality", lambda s, d: pileup.filter_bases(adapter.pileup(s, d), P).select("ord", "qq"), "select ord, least(greatest(least(baseq, mapq), 4), 63) as qq from pile where baseq >= 13 and mapq >= 13")


def _cells(s: SparkSession, d: str) -> DataFrame:
    inside = with_window(adapter.pileup(s, d), adapter.region(s, d), P)
    return C.likelihoods(pileup.filter_bases(pileup.cap_depth(inside, P), P), P)


_add("p13_rms", lambda s, d: _cells(s, d).select("pos", "sample_id", "depth", "rms"), "select pos, sample_id, depth, rms from cells")
_add("g6_likelihood", lambda s, d: _cells(s, d).select("pos", "sample_id", *[F.round(f"lk_{i}{j}", 5).alias(f"lk_{i}{j}") for i, j in C.GENOTYPES]), "select pos, sample_id, " + ", ".join(f"round(lk_{i}{j}, 5) as lk_{i}{j}" for i, j in C.GENOTYPES) + " from lks")
_add("g7_consensus", lambda s, d: C.consensus(_cells(s, d)).select("pos", "sample_id", "a1", "a2", "depth", "snpq", "rms"), "select pos, sample_id, a1, a2, depth, snpq, rms from calls")


def _with_ref(s: SparkSession, d: str) -> DataFrame:
    refs = adapter.ref_bases(s, d).select("pos", G.base_code(F.col("ref")).alias("ref"))
    return C.consensus(_cells(s, d)).join(refs, "pos")


_add("c1_clean_het", lambda s, d: C.clean_heterozygotes(_with_ref(s, d), P).select("pos", "sample_id", "a1", "a2"), "select pos, sample_id, a1, a2 from clean")
_add("c2_segregating", lambda s, d: C.mark_derived(C.clean_heterozygotes(_with_ref(s, d), P), P).select("pos", "sample_id", "a1", "a2", "derived"), "select pos, sample_id, a1, a2, derived from marked")
_add("c3_qual_filter", lambda s, d: C.mark_pass(_with_ref(s, d), P).select("pos", "sample_id", "pass"), "select pos, sample_id, ok as pass from marked")
_add("c4_site_type", _on_sites(lambda x: x.sites.select("win_id", "pos", "ref", "cov_mask", "type_mask", "derived_mask", "fq")), "select win_id, pos, ref, cov_mask, type_mask, derived_mask, fq from sites")
_add("c6_bit_count", _on_sites(lambda x: x.sites.select("pos", G.bits(F.col("cov_mask")).alias("n_pass"), G.hamming(F.col("cov_mask"), F.col("type_mask")).alias("apart"))), "select pos, cast(bit_count(cov_mask) as bigint) as n_pass, cast(bit_count(xor(cov_mask, type_mask)) as bigint) as apart from sites")
_add("j3_sample_population", lambda s, d: adapter.pileup(s, d).join(F.broadcast(S.sample_table(header.read_groups(adapter.header_lines(s))).select("sample_id", "pop")), "sample_id").groupBy("pop").agg(F.count("*").alias("n_bases")), "select case when sample_id < 4 then 'popA' else 'popB' end as pop, count(*) as n_bases from pile group by 1")
_add("j7_pop_coverage", _on_sites(lambda x: S.per_pop(x.sites, x.pops, x.params).select("pos", "pop", "ncov", "f", "covered")), "select pos, pop, ncov, f, covered from per_pop")
_add("j8_complete_coverage", _on_sites(lambda x: S.per_pop(x.sites, x.pops, x.params, "complete").select("pos", "pop", "ncov", "covered")), "select pos, pop, ncov, covered from per_full")
_add("j9_all_pass", _on_sites(lambda x: S.all_pass(x.sites, x.pops).select("pos", "type_mask")), "select pos, type_mask from full_cov")
_add("j13_polarise", _on_sites(lambda x: S.per_pop(x.sites, x.pops, x.params).select("pos", "pop", S.polarise(F.col("f"), F.col("ncov"), G.has_bit(F.col("type_mask"), 7)).alias("freq"))), "select pos, pop, case when (type_mask >> 7) & 1 = 1 then ncov - f else f end as freq from per_pop")
_add("n3_pi", _on_sites(lambda x: diversity.nucleotide_diversity(*_args(x))), f"""select {WIN_SQL}, w.pop, coalesce(ns, 0) as ns, case when ns >= 10 then total / ns end as pi
from windows_pop w left join (
  select win_id, pop_id, cast(sum(ns) as bigint) as ns, sum(cast(num as double) / den order by den) as total from (
    select win_id, pop_id, case when use then ncov * (ncov - 1) else 1 end as den, sum(case when use then 2 * f * (ncov - f) else 0 end) as num, count_if(covered) as ns
    from (select *, fq > 0 and ncov > 1 and covered as use from per_pop) group by 1, 2, 3)
  group by 1, 2) x on x.win_id = w.win_id and x.pop_id = w.pop_id""")
_add("n3_pi_no_singletons", _on_sites(lambda x: diversity.nucleotide_diversity(*_args(x)), no_singletons=True), f"""select {WIN_SQL}, w.pop, coalesce(ns, 0) as ns, case when ns >= 10 then total / ns end as pi
from windows_pop w left join (
  select win_id, pop_id, cast(sum(ns) as bigint) as ns, sum(cast(num as double) / den order by den) as total from (
    select win_id, pop_id, case when use then ncov * (ncov - 1) else 1 end as den, sum(case when use then 2 * f * (ncov - f) else 0 end) as num, count_if(covered) as ns
    from (select *, fq > 0 and ncov > 1 and covered and f > 1 as use from per_pop) group by 1, 2, 3)
  group by 1, 2) x on x.win_id = w.win_id and x.pop_id = w.pop_id""")
_add("n4_dxy", _on_sites(lambda x: diversity.divergence_between(*_args(x))), f"""select {WIN_SQL}, 'popA' as pop1, 'popB' as pop2, coalesce(ns, 0) as ns, case when ns >= 10 then total / ns end as dxy
from spine w left join (
  select win_id, cast(sum(ns) as bigint) as ns, sum(cast(num as double) / den order by den) as total from (
    select win_id, case when use then ncov1 * ncov2 else 1 end as den, sum(case when use then f1 * (ncov2 - f2) + f2 * (ncov1 - f1) else 0 end) as num, count_if(covered1 and covered2) as ns
    from (select *, fq > 0 and ncov1 > 0 and ncov2 > 0 and covered1 and covered2 as use from per_pair) group by 1, 2)
  group by 1) x on x.win_id = w.win_id""")
_add("f10_tajima_faywu", _on_sites(lambda x: diversity.spectrum(*_args(x)), "tajima_d", "faywu_h"), SPECTRUM.format(freq="f"))
_add("f11_spectrum_outgroup", _on_sites(lambda x: diversity.spectrum(*_args(x), x.outgroup), "tajima_d", "faywu_h", outgroup="s7"), SPECTRUM.format(freq="case when (type_mask >> 7) & 1 = 1 then ncov - f else f end"))
_add("v1_divergence_individual", _on_sites(lambda x: diversity.divergence_individual(*_args(x)), "d"), f"""select {WIN_SQL}, cast(s.sample_id as int) as sample_id, coalesce(num_sites, 0) as num_sites, case when num_sites >= 10 then round(differ / cast(num_sites as double), 5) end as d
from spine w cross join samples s left join (
  select win_id, sample_id, count(*) as num_sites, count_if((type_mask >> sample_id) & 1 = 1) as differ from full_cov, samples group by 1, 2) x on x.win_id = w.win_id and x.sample_id = s.sample_id""")
_add("v3_divergence_population", _on_sites(lambda x: diversity.divergence_population(*_args(x)), "d"), DIV_POP % "round((fixed + seg) / cast(num_sites as double), 5)")
_add("v4_jukes_cantor", _on_sites(lambda x: diversity.divergence_population(*_args(x)), "d", dist="jc", substitutions_only=True), DIV_POP % "case when 1 - 4 * fixed / (3e0 * num_sites) > 0 then round(-0.75e0 * ln(1 - 4 * fixed / (3e0 * num_sites)), 5) end")
_add("h1_haplotypes", _on_sites(lambda x: haplotypes.haplotypes(x.sites, x.pops, x.params)), "select win_id, pop_id, cast(sample_id as int) as sample_id, hap from haps")
_add("h3_haplotype_diversity", _on_sites(lambda x: haplotypes.diversity(*_args(x)), "kdiv"), f"""select {WIN_SQL}, coalesce(num_sites, 0) as num_sites, w.pop, case when num_sites >= 10 then coalesce(k, 1) end as k, case when num_sites >= 10 then round((1 - coalesce(hom, 1e0)) * 4 / 3, 5) end as kdiv
from windows_pop w left join hap_div h on h.win_id = w.win_id and h.pop_id = w.pop_id {ALIGNED}""")
_add("h4_ehhs", _on_sites(lambda x: haplotypes.ehhs(*_args(x)), "ehhs"), f"""select {WIN_SQL}, coalesce(num_sites, 0) as num_sites, w.pop, case when num_sites >= 10 and x.side is not null then round((1 - (1 - hom) * 4 / 3) / (1 - (1 - (pow(cast(bit_count(x.side) as double), 2) + pow(4e0 - cast(bit_count(x.side) as double), 2)) / 16) * 4 / 3), 5) end as ehhs
from windows_pop w left join hap_div h on h.win_id = w.win_id and h.pop_id = w.pop_id {ALIGNED}
left join (select * from (select *, row_number() over (partition by win_id, pop_id order by c desc, first) as r from (
  select win_id, pop_id, side, count(*) as c, min(pos) as first from split where f > 1 and f < n - 1 group by 1, 2, 3)) where r = 1) x on x.win_id = w.win_id and x.pop_id = w.pop_id""")
_add("h5_gmin", _on_sites(lambda x: haplotypes.gmin(*_args(x)), "mean_dxy", "gmin"), f"""select {WIN_SQL}, coalesce(num_sites, 0) as num_sites, 'popA' as pop1, 'popB' as pop2, case when num_sites >= 10 then round(mean_dxy, 5) end as mean_dxy, case when num_sites >= 10 then min_dxy end as min_dxy, case when num_sites >= 10 then round(min_dxy / nullif(mean_dxy, 0), 5) end as gmin
from spine w {ALIGNED} left join (
  select win_id, avg(differ) as mean_dxy, cast(min(differ) as bigint) as min_dxy from pair_diff where i < 4 and j >= 4 group by 1) x on x.win_id = w.win_id""")
_add("h6_pair_differences", _on_sites(lambda x: haplotypes.pair_differences(x.sites, x.pops, x.params).select("win_id", "i", "j", "aligned", "differ")), "select win_id, cast(i as int) as i, cast(j as int) as j, cast(aligned as bigint) as aligned, cast(differ as bigint) as differ from pair_diff")
_add("h7_pairwise_pi", _on_sites(lambda x: haplotypes.pairwise_pi(*_args(x)), "pi"), f"""select {WIN_SQL}, coalesce(num_sites, 0) as num_sites, w.pop, case when num_sites >= 10 then round(mean / num_sites, 5) end as pi
from windows_pop w {ALIGNED} left join (
  select win_id, i // 4 as pop_id, avg(differ) as mean from pair_diff where i // 4 = j // 4 group by 1, 2) x on x.win_id = w.win_id and x.pop_id = w.pop_id""")
_add("l2_r_squared", _on_sites(lambda x: linkage.r_squared(linkage.snps(x.sites, x.pops, x.params)), "r2"), "select win_id, pop_id, cast(i as int) as i, cast(j as int) as j, round(r2, 5) as r2 from r2")
_add("l3_zns", _on_sites(lambda x: linkage.zns(*_args(x))), LD % (f"case when {SHOWN} then 2e0 * total / (s * (s - 1)) end as zns", "select win_id, pop_id, sum(cast(num as double) / den order by den) as total from (select win_id, pop_id, den, sum(num) as num from r2 group by 1, 2, 3) group by 1, 2"))
_add("l4_omega", _on_sites(lambda x: linkage.omega_max(*_args(x)), "omega"), LD % (f"case when {SHOWN} then round(omega, 5) end as omega", """
  select win_id, pop_id, max(case when b > 1e-12 then (l + r) / (cut * (cut - 1) / 2e0 + (s - cut) * (s - cut - 1) / 2e0) * cut * (s - cut) / b end) as omega from (
    select r.win_id, r.pop_id, s, cut, sum(case when j <= cut then r2 else 0e0 end) as l, sum(case when i > cut then r2 else 0e0 end) as r, sum(case when i <= cut and j > cut then r2 else 0e0 end) as b
    from r2 r join counts c on c.win_id = r.win_id and c.pop_id = r.pop_id, unnest(range(2, s - 1)) as t(cut) group by 1, 2, 3, 4) group by 1, 2"""))
_add("l5_wall", _on_sites(lambda x: linkage.wall(*_args(x)), "wall_b", "wall_q"), LD % (f"case when {SHOWN} then round(b / cast(nullif(s - 1, 0) as double), 5) end as wall_b, case when {SHOWN} then round((b + q) / cast(s as double), 5) end as wall_q", "select win_id, pop_id, count_if(same) as b, count(distinct case when same then side end) as q from lags group by 1, 2"))
_add("t1_difference_matrix", _on_sites(lambda x: tree.differences(x.sites, x.pops)), "select win_id, cast(i as int) as i, cast(j as int) as j, num_sites, seg, differ from diffs")
_add("t2_distance_matrix", _on_sites(lambda x: tree.distances(x.sites, x.pops, x.params).select("win_id", "i", "j", "d"), "d", dist="jc"), "select win_id, cast(i as int) as i, cast(j as int) as j, case when 1 - 4 * differ / (3e0 * num_sites) > 0 then round(-0.75e0 * ln(1 - 4 * differ / (3e0 * num_sites)), 5) end as d from diffs")
_add("t3_newick", _on_sites(lambda x: tree.trees(*_args(x), ["ref", *x.names])))
_add("s19_snp_rows", _on_sites(lambda x: snps.table(x.calls, x.sites, x.pops, replace(x.params, variable_only=True)).select("pos", "ref", F.explode("samples").alias("c")).select("pos", "ref", "c.*")), """
select k.pos, 'ACGT'[k.ref + 1] as ref, cast(s.sample_id as int) as sample_id, coalesce('AMRWNCSYNNGKNNNT'[4 * least(a1, a2) + greatest(a1, a2) + 1], 'A') as symbol, coalesce(snpq, 0) as snpq, coalesce(rms, 0) as rms, coalesce(depth, 0) as depth
from (select distinct pos, ref from per_pop where fq > 0) k cross join samples s left join marked m on m.pos = k.pos and m.sample_id = s.sample_id""")
_add("s20_sweepfinder", _on_sites(lambda x: snps.sweepfinder(x.sites, x.pops, x.params).select("pos", "pop", "x", "n")), "select pos, pop, f as x, ncov as n from per_pop where fq > 0")
_add("s21_ms", _on_sites(lambda x: snps.ms_blocks(x.sites, x.pops, x.spine, x.params).select("win_id", "segsites", "positions", F.array_join("haplotypes", "/").alias("rows"))), """
select w.win_id, coalesce(segsites, 0) as segsites, coalesce(positions, '') as positions, coalesce(rows, '///////') as rows
from spine w left join (
  select win_id, max(n) as segsites, max(case when sample_id = 0 then places end) as positions, string_agg(hap, '/' order by sample_id) as rows from (
    select k.win_id, sample_id, count(*) as n, string_agg(case when (type_mask >> sample_id) & 1 = 1 then '1' else '0' end, '' order by pos) as hap, string_agg(printf('%.8f', (pos - win_beg) / cast(win_end - win_beg as double)), ' ' order by pos) as places
    from (select distinct win_id, pos, type_mask from per_pop where fq > 0) k join spine using (win_id), samples group by 1, 2) group by 1) x on x.win_id = w.win_id""")
_add("s22_fasta", _on_sites(lambda x: snps.fasta(x.calls, x.spine, x.pops)), """
select win_id, cast(sample_id as int) as sample_id, string_agg(case when ok then 'AMRWNCSYNNGKNNNT'[4 * least(a1, a2) + greatest(a1, a2) + 1] else 'N' end, '' order by p.pos) as sequence
from (select win_id, win_beg + i as pos, sample_id from spine, unnest(range(0, win_end - win_beg)) as t(i), samples) p left join (select pos, sample_id, ok, a1, a2 from marked) m using (pos, sample_id) group by 1, 2""")

# text outputs: the SQL puts together what the tables above have
LINE = """select win_id, concat_ws(chr(9), chrom, cast(win_beg + 1 as varchar), cast(win_end as varchar), {shared}string_agg({cell}, chr(9) order by {by})) as value
from ({table}) group by win_id, chrom, win_beg, win_end{group}"""


def _cell(label: str, **values: str) -> str:
    return " || chr(9) || ".join(f"'{k}[' || {label} || ']:' || chr(9) || {v}" for k, v in values.items())


def _shown(x: str) -> str:
    return f"coalesce(printf('%.5f', round(cast({x} as double), 5)), '     NA')"


def _table(name: str) -> str:
    return ORACLE_SQL[name].removeprefix(f"with {BASE}\n")


def _lines(name: str, cell: str, by: str = "pop", shared: str = "") -> str:
    return LINE.format(shared=f"cast({shared} as varchar), " if shared else "", cell=cell, by=by, table=_table(name), group=f", {shared}" if shared else "")


def _text(name: str, command: str, select: str | None = None, **over) -> None:
    _add(name, lambda s, d: formats.text(command, prepared(s, d, replace(P, **over))), select)


PAIR = "pop1 || '-' || pop2"
_text("s18_nucdiv_text", "nucdiv", f"""select a.win_id, a.value || chr(9) || b.cell as value
from ({_lines("n3_pi", _cell("pop", ns="ns", pi=_shown("pi")))}) a join (select win_id, string_agg({_cell(PAIR, ns="ns", dxy=_shown("dxy"))}, chr(9) order by pop1, pop2) as cell from ({_table("n4_dxy")}) group by 1) b using (win_id)""")
_text("s18_sfs_text", "sfs", _lines("f10_tajima_faywu", _cell("pop", ns="ns", D=_shown("tajima_d"), H=_shown("faywu_h"))))
_text("s18_ld_text", "ld", _lines("l5_wall", _cell("pop", S="s", B=_shown("wall_b"), Q=_shown("wall_q")), shared="num_sites"), output=2)
_text("s18_ld_zns_text", "ld", _lines("l3_zns", _cell("pop", S="s", Zns=_shown("zns")), shared="num_sites"))
_text("s18_ld_omega_text", "ld", _lines("l4_omega", _cell("pop", S="s", omax=_shown("omega")), shared="num_sites"), output=1)
_text("s18_diverge_text", "diverge", _lines("v1_divergence_individual", _cell("'s' || sample_id", d=_shown("d")), "sample_id", "num_sites"))
_text("s18_diverge_pop_text", "diverge", _lines("v3_divergence_population", _cell("pop", Fixed="fixed", Seg="seg", d=_shown("d")), shared="num_sites"), output=1)
_text("s18_haplo_text", "haplo", _lines("h3_haplotype_diversity", _cell("pop", K="coalesce(cast(k as varchar), '     NA')", Kdiv=_shown("kdiv")), shared="num_sites"))
_text("s18_ehhs_text", "haplo", _lines("h4_ehhs", _cell("pop", EHHS=_shown("ehhs")), shared="num_sites"), output=1)
_text("s18_pairwise_text", "haplo", f"""select a.win_id, a.value || chr(9) || b.cell as value
from ({_lines("h7_pairwise_pi", _cell("pop", pi=_shown("pi")), shared="num_sites")}) a join (select win_id, string_agg({_cell(PAIR, dxy=_shown("mean_dxy"), min=_shown("min_dxy"))}, chr(9) order by pop1, pop2) as cell from ({_table("h5_gmin")}) group by 1) b using (win_id)""", output=2)
_text("s18_tree_text", "tree")
_text("s18_snp_text", "snp", f"""select cast(pos as int) as win_id, concat_ws(chr(9), 'chr1', cast(pos + 1 as varchar), ref, string_agg(concat_ws(chr(9), symbol, cast(snpq as varchar), cast(rms as varchar), cast(depth as varchar)), chr(9) order by sample_id)) as value
from ({_table("s19_snp_rows")}) group by pos, ref""", variable_only=True)
_text("s18_sweepfinder_text", "snp", f"""select cast(pos as int) as win_id, concat_ws(chr(9), 'chr1', cast(pos + 1 as varchar), string_agg(concat_ws(chr(9), cast(x as varchar), cast(n as varchar)), chr(9) order by pop)) as value
from ({_table("s20_sweepfinder")}) group by pos""", output=1)
_text("s18_ms_text", "snp", f"""select win_id, chr(10) || '//' || chr(10) || 'segsites: ' || segsites || case when segsites > 0 then chr(10) || 'positions: ' || positions || chr(10) || replace(rows, '/', chr(10)) else '' end as value
from ({_table("s21_ms")})""", output=2)
_text("s18_fasta_text", "fasta", f"""select win_id, '>s' || sample_id || chr(10) || rtrim(regexp_replace(sequence, '(.{{{snps.FASTA_WIDTH}}})', '\\1' || chr(10), 'g'), chr(10)) as value
from ({_table("s22_fasta")})""")

# reads, headers and references
_CIGAR_SQL = ", ".join(f"({k}, '{c}')" for k, c in enumerate(adapter.CIGARS))
#: By hand: per alignment the length on the reference and of the query, and (place on the reference, place in the read) of its bases.
_PLACED = {
    0: (5, 5, [(i, i) for i in range(5)]), 1: (4, 5, [(0, 0), (1, 1), (2, 3), (3, 4)]), 2: (7, 5, [(0, 0), (1, 1), (4, 2), (5, 3), (6, 4)]), 3: (3, 5, [(0, 2), (1, 3), (2, 4)]),
    4: (8, 5, [(0, 0), (4, 1), (5, 2), (6, 3), (7, 4)]), 5: (5, 5, [(i, i) for i in range(5)]), 6: (4, 5, [(i, i) for i in range(4)]),
}
READS = f"""with reads as (
  select l_orderkey * 10 + l_linenumber as ord, cast(l_partkey as int) as pos, l_suppkey % 8 as sample, l_linenumber as ln, l_orderkey % {len(adapter.CIGARS)} as kind,
    cast(case when l_linestatus = 'F' then 16 else 0 end + case l_linenumber when 5 then 4 when 4 then 1024 else 0 end as int) as flag, cast(20 + round(l_discount * 100) * 4 as int) as mapq,
    substr('ACGTNACGTN', cast(l_partkey % 5 + 1 as bigint), 5) as seq, cast(l_quantity as int) as q
  from lineitem),
cigars as (select * from (values {_CIGAR_SQL}) as t(kind, cigar)),
lengths as (select * from (values {", ".join(f"({k}, {r}, {n})" for k, (r, n, _) in _PLACED.items())}) as t(kind, on_ref, on_read)),
placed as (select * from (values {", ".join(f"({k}, {r}, {x})" for k, (_, _, at) in _PLACED.items() for r, x in at)}) as t(kind, r, x)),
bases as (select *, cast(pos + r as int) as place, substr(seq, x + 1, 1) as base, q + x as baseq from reads join placed using (kind))
"""


def _reads(name: str, query: Callable[[SparkSession, str], DataFrame], select: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = READS + select


def _piled(s: SparkSession, d: str, p: Params = P) -> DataFrame:
    return pileup.to_pileup(adapter.reads(s, d), S.sample_table(header.read_groups(adapter.header_lines(s))).select("rg", "sample_id"), p)


_reads("s3_region_scan", lambda s, d: alignments.overlapping(adapter.reads(s, d), "chr1", 50, 120).select("ord", "pos", "ref_end"), "select ord, pos, cast(pos + on_ref as int) as ref_end from reads join lengths using (kind) where pos < 120 and pos + on_ref > 50")
_reads("s4_flag_mask", lambda s, d: pileup.pass_flags(adapter.reads(s, d), 4 | 256 | 512 | 1024).groupBy("flag").agg(F.count("*").alias("n")), "select flag, count(*) as n from reads where ln not in (4, 5) group by 1")
_reads("s14_sam_text", lambda s, d: alignments.to_sam(adapter.reads(s, d)), """select ord, concat_ws(chr(9), 'q' || ord, cast(flag as varchar), 'chr1', cast(pos + 1 as varchar), cast(mapq as varchar), cigar, '*', '0', '0', seq,
  chr(q + 33) || chr(q + 34) || chr(q + 35) || chr(q + 36) || chr(q + 37), case when ln <> 6 then 'RG:Z:rg' || sample end) as value from reads join cigars using (kind)""")
_reads("s14_valid", lambda s, d: adapter.reads(s, d).select("ord", alignments.is_valid(F.lit(100)).alias("valid")), "select ord, pos < 100 as valid from reads")
_reads("s15_library", lambda s, d: header.libraries(adapter.reads(s, d), header.read_groups(adapter.header_lines(s))).groupBy("library").agg(F.count("*").alias("n")), "select case when ln <> 6 and sample <> 5 then 'lib' || (sample % 3) end as library, count(*) as n from reads group by 1")
_reads("s26_geometry", lambda s, d: adapter.reads(s, d).select("ord", pileup.reference_end(F.col("pos"), F.col("cigar")).alias("ref_end"), pileup.query_length(F.col("cigar")).alias("qlen"), pileup.bin_of(F.col("pos"), F.col("ref_end")).alias("bin")), "select ord, cast(pos + on_ref as int) as ref_end, cast(on_read as int) as qlen, cast(case when pos // 16384 = (pos + on_ref - 1) // 16384 then 4681 + pos // 16384 when pos // 131072 = (pos + on_ref - 1) // 131072 then 585 + pos // 131072 end as int) as bin from reads join lengths using (kind)")
_reads("p1_pileup", lambda s, d: _piled(s, d).groupBy("pos", "strand").agg(F.count("*").alias("depth"), F.sum("baseq").alias("quality")), "select place as pos, cast(flag // 16 % 2 as int) as strand, count(*) as depth, cast(sum(baseq) as bigint) as quality from bases where ln not in (5, 6) group by 1, 2")
_reads("p3_aligned_bases", lambda s, d: pileup.explode_bases(adapter.reads(s, d)).select("ord", "pos", "qpos"), "select ord, place as pos, cast(x as int) as qpos from bases")
_reads("p4_exclude_flags", lambda s, d: _piled(s, d, replace(P, exclude_flags=4 | 1024)).groupBy("sample_id").agg(F.count("*").alias("n")), "select cast(sample as int) as sample_id, count(*) as n from bases where ln not in (4, 5, 6) group by 1")
_reads("p5_without_group", lambda s, d: _piled(s, d).agg(F.count("*").alias("n"), F.count_distinct("ord").alias("reads")), "select count(*) as n, count(distinct ord) as reads from bases where ln not in (5, 6)")
_reads("p6_read_group_sample", lambda s, d: _piled(s, d).select("ord", "sample_id").distinct(), "select distinct ord, cast(sample as int) as sample_id from bases where ln not in (5, 6)")
_reads("p10_unknown_bases", lambda s, d: pileup.filter_bases(_piled(s, d), P).groupBy("base").agg(F.count("*").alias("n")), "select cast(instr('ACGT', base) - 1 as int) as base, count(*) as n from bases where ln not in (5, 6) and base <> 'N' and baseq >= 13 and mapq >= 13 group by 1")
_reads("j6_no_read_groups", lambda s, d: pileup.to_pileup(adapter.reads(s, d), None, P).groupBy("sample_id").agg(F.count("*").alias("n")), "select cast(0 as int) as sample_id, count(*) as n from bases where ln <> 5")

_GROUPS = ", ".join(f"('rg{i}', 's{i}', '{'popA' if i < 4 else 'popB'}', {'null' if i == 5 else repr(f'lib{i % 3}')}, {i})" for i in range(8))


def _made(name: str, query: Callable[[SparkSession, str], DataFrame], select: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = select


_RG = f"(values {_GROUPS}) as t(rg, sample, pop, library, k)"
_made("s7_fasta", lambda s, d: fasta.ref_bases(fasta.chunks(adapter.fasta_lines(s, d))), "select 'chr1' as chrom, cast(p as int) as pos, 'ACGT'[p % 4 + 1] as ref from (select unnest(range(0, max(p_partkey) + 1)) as p from part) union all select * from (values ('chr2', 0, 'A'), ('chr2', 1, 'C'), ('chr2', 2, 'G'))")
_made("s10_read_groups", lambda s, d: header.read_groups(adapter.header_lines(s)), f"select rg, sample, pop, library, cast(k + 3 as int) as ord from {_RG}")
_made("s11_assembly", lambda s, d: s.createDataFrame([(header.assembly(adapter.header_lines(s)),)], "name string"), "select 'refv1' as name")
_made("s12_targets", lambda s, d: header.contigs(adapter.header_lines(s)).select("chrom", "length"), "select * from (values ('chr1', 1000000), ('chr2', 500)) as t(chrom, length)")
_made("s13_problems", lambda s, d: header.problems(adapter.header_lines(s, adapter.HEADER + "\n@SQ\tSN:chr2\n@ZZ\ta:b\n@RG\tID:x\tSM:y\tFO:*\tQQ:1")), "select * from (values (12, 'missing LN'), (12, 'used twice: chr2'), (13, 'unknown type ZZ'), (14, 'unknown tag QQ')) as t(line, problem)")
_made("s13_table", lambda s, d: header.table(adapter.header_lines(s), "RG", "ID", "LB"), f"select rg as key, library as value from {_RG} where library is not null")
_made("s13_merge", lambda s, d: header.to_text(header.merge(adapter.header_lines(s), adapter.header_lines(s, "@SQ\tSN:chr2\tM5:ab\n@SQ\tSN:chr3\tLN:7\n@CO\tmade of order lines"))).select("value"), f"""
select '@HD' || chr(9) || 'VN:1.0' || chr(9) || 'SO:coordinate' as value union all select '@SQ' || chr(9) || 'SN:chr1' || chr(9) || 'LN:1000000' || chr(9) || 'AS:refv1' union all select '@SQ' || chr(9) || 'SN:chr2' || chr(9) || 'LN:500' || chr(9) || 'M5:ab'
union all select '@SQ' || chr(9) || 'SN:chr3' || chr(9) || 'LN:7' union all select '@CO' || chr(9) || 'made of order lines'
union all select concat_ws(chr(9), '@RG', 'ID:' || rg, 'SM:' || sample, 'LB:' || library, 'PO:' || pop) from {_RG}""")
_made("j1_sample_dictionary", lambda s, d: S.dictionary(adapter.reads(s, d).withColumnRenamed("read_group", "rg"), "rg", "sample").select("sample", "sample_id"), READS + "select sample, cast(row_number() over (order by first, sample) - 1 as int) as sample_id from (select 'rg' || sample as sample, min(ord) as first from reads where ln <> 6 group by 1)")
_made("j2_population_dictionary", lambda s, d: S.dictionary(header.read_groups(adapter.header_lines(s)), "pop", "pop").select("pop", "pop_id"), "select * from (values ('popA', 0), ('popB', 1)) as t(pop, pop_id)")
_made("j4_assign_pops", lambda s, d: s.createDataFrame([(x.pop_id, x.name, x.mask, x.n) for x in S.assign_pops(S.sample_table(header.read_groups(adapter.header_lines(s))))], "pop_id int, pop string, mask long, n long"), f"select cast(k // 4 as int) as pop_id, pop, cast(sum(1 << k) as bigint) as mask, count(*) as n from {_RG} group by 1, 2")
_made("j12_outgroup_population", lambda s, d: s.createDataFrame([(i, S.population_of(adapter.POPS, i).name) for i in range(adapter.SAMPLES)], "sample_id int, pop string"), f"select k as sample_id, pop from {_RG}")

_REGIONS = ["chr1", "chr2", "chr1:5", "chr1:1,001-2,000", "chr2:400-900", "chr1:1-1", "chr2:0-10"]


def _regions(spark: SparkSession, d: str) -> DataFrame:
    lengths = {r["chrom"]: r["length"] for r in header.contigs(adapter.header_lines(spark)).collect()}
    found = [(x, parse_region(x, lengths)) for x in _REGIONS]
    return spark.createDataFrame([(x, r.chrom, r.beg, r.end) for x, r in found], "region string, chrom string, beg long, stop long")


_made("w1_region", _regions, f"""
select region, chrom, greatest(0, coalesce(cast(nullif(regexp_extract(x, ':(\\d+)', 1), '') as bigint), 1) - 1) as beg, least(coalesce(cast(nullif(regexp_extract(x, '-(\\d+)$', 1), '') as bigint), length), length) as stop
from (select region, replace(region, ',', '') as x, split_part(region, ':', 1) as chrom from (values {", ".join(f"('{x}')" for x in _REGIONS)}) as t(region))
join (values ('chr1', cast(1000000 as bigint)), ('chr2', 500)) as c(chrom, length) using (chrom)""")
