"""Row-returning outputs: SNP tables, SweepFinder rows, ms blocks, and FASTA per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genomics as G
from ..params import Params
from . import sites as S

#: The header of an ms file.
MS_HEADER, MS_POPS = "ms {samples} {windows} -t 5.0", " -I {pops} {sizes}"
MS_SEED = "1350154902"
FASTA_WIDTH = 60


def kept_sites(found: DataFrame, pops: list[S.Pop], p: Params, segregating: bool) -> DataFrame:
    """Sites that some population covers; with ``segregating`` those with a derived call."""
    kept = S.kept(found, pops, p)
    return kept.where("fq > 0") if segregating else kept


def table(calls: DataFrame, found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """win_id, chrom, pos, ref, and per sample its IUPAC symbol, snpq, rms and depth.

    All covered sites, or with ``variable_only`` (and always under the established tool's behaviour) segregating ones.
    """
    kept = kept_sites(found, pops, p, p.variable_only or p.reference).select("win_id", "chrom", "pos")
    entry = F.struct("sample_id", G.iupac(F.least("a1", "a2"), F.greatest("a1", "a2")).alias("symbol"), "snpq", "rms", "depth")
    rows = calls.join(kept, ["win_id", "chrom", "pos"]).groupBy("win_id", "chrom", "pos").agg(F.first("ref").alias("ref"), F.array_sort(F.collect_list(entry)).alias("samples"))
    samples = F.array(*[F.lit(i) for i in sorted(i for x in pops for i in x.samples)])
    empty = lambda i: F.struct(i.alias("sample_id"), G.iupac(F.lit(0), F.lit(0)).alias("symbol"), F.lit(0).alias("snpq"), F.lit(0).alias("rms"), F.lit(0).alias("depth"))
    full = F.transform(samples, lambda i: F.coalesce(F.get(F.filter("samples", lambda x: x["sample_id"] == i), F.lit(0)), empty(i)))
    return rows.select("win_id", "chrom", "pos", G.base_letter(F.col("ref")).alias("ref"), full.alias("samples"))


def table_text(rows: DataFrame) -> DataFrame:
    cells = F.transform("samples", lambda x: F.concat_ws("\t", x["symbol"], x["snpq"].cast("string"), x["rms"].cast("string"), x["depth"].cast("string")))
    return rows.select("chrom", "pos", F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), "ref", F.array_join(cells, "\t")).alias("value"))


def sweepfinder(found: DataFrame, pops: list[S.Pop], p: Params, outgroup: int | None = None) -> DataFrame:
    """chrom, pos, pop, x derived of n covered samples at each segregating site."""
    rows = S.per_pop(found.where("fq > 0"), pops, p)
    x = F.col("f") if outgroup is None else S.polarise(F.col("f"), F.col("ncov"), G.has_bit(F.col("type_mask"), outgroup))
    return rows.select("win_id", "chrom", "pos", "pop_id", "pop", x.alias("x"), F.col("ncov").alias("n"))


def ms_blocks(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params, outgroup: int | None = None) -> DataFrame:
    """win_id, segsites, positions (0 to 1 within the window) and a 0/1 row for each sample.

    Where the outgroup has the derived allele, the other one is 1.
    """
    sites = kept_sites(found, pops, p, True)
    if outgroup is not None:
        flipped = F.col("type_mask").bitwiseXOR(F.lit(-1).cast("long"))
        sites = sites.withColumn("type_mask", F.when(G.has_bit(F.col("type_mask"), outgroup), flipped).otherwise(F.col("type_mask")))
    kept = sites.groupBy("win_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type_mask"))).alias("sites"))
    out = spine.join(kept, "win_id", "left").withColumn("sites", F.coalesce("sites", F.array().cast("array<struct<pos:int,type_mask:bigint>>")))
    samples = F.array(*[F.lit(i) for i in sorted(i for x in pops for i in x.samples)])
    width = (F.col("win_end") - F.col("win_beg")).cast("double")
    place = F.transform("sites", lambda x: F.format_string("%.8f", (x["pos"] - F.col("win_beg")).cast("double") / width))
    rows = F.transform(samples, lambda i: F.array_join(F.transform("sites", lambda x: G.has_bit(x["type_mask"], i).cast("int").cast("string")), ""))
    return out.select("win_id", "chrom", F.size("sites").cast("long").alias("segsites"), F.array_join(place, " ").alias("positions"), rows.alias("haplotypes"))


def ms_text(blocks: DataFrame) -> DataFrame:
    body = F.concat(F.lit("\n//\nsegsites: "), F.col("segsites").cast("string"), F.when(F.col("segsites") > 0, F.concat(F.lit("\npositions: "), "positions", F.lit("\n"), F.array_join("haplotypes", "\n"))).otherwise(F.lit("")))
    return blocks.select("win_id", body.alias("value"))


def ms_header(pops: list[S.Pop], windows: int) -> str:
    head = MS_HEADER + (MS_POPS if len(pops) > 1 else "")
    return head.format(samples=sum(x.n for x in pops), windows=windows, pops=len(pops), sizes=" ".join(str(x.n) for x in pops)) + "\n" + MS_SEED + "\n"


def fasta(calls: DataFrame, spine: DataFrame, pops: list[S.Pop]) -> DataFrame:
    """win_id, sample_id and its sequence over the window; N where a sample has no call that passes.

    Sequences are joined of blocks of a thousand positions, so a group is never larger than a window's blocks.
    """
    symbol = F.when(F.col("pass"), G.iupac(F.least("a1", "a2"), F.greatest("a1", "a2"))).otherwise(F.lit("N"))
    blocks = spine.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("win_end") - F.col("win_beg")) / 1000).cast("int") - 1, F.lit(0)))).alias("block"))
    samples = F.array(*[F.lit(i) for i in sorted(i for x in pops for i in x.samples)])
    blocks = blocks.select("*", F.explode(samples).alias("sample_id"))
    placed = calls.join(F.broadcast(spine.select("win_id", "win_beg")) if spine.count() <= 10_000 else spine.select("win_id", "win_beg"), "win_id")
    per = placed.select("win_id", "sample_id", F.floor((F.col("pos") - F.col("win_beg")) / 1000).cast("int").alias("block"), F.struct(F.pmod(F.col("pos") - F.col("win_beg"), F.lit(1000)).alias("i"), symbol.alias("s")).alias("at"))
    per = per.groupBy("win_id", "sample_id", "block").agg(F.map_from_entries(F.collect_list("at")).alias("at"))
    width = F.least(F.lit(1000), F.col("win_end") - F.col("win_beg") - F.col("block") * 1000)
    letters = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.try_element_at(F.col("at"), i), F.lit("N")))
    text = F.when(width > 0, F.array_join(letters, "")).otherwise(F.lit(""))
    whole = blocks.join(per, ["win_id", "sample_id", "block"], "left").select("win_id", "sample_id", "block", text.alias("text"))
    return whole.groupBy("win_id", "sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("sequence"))
