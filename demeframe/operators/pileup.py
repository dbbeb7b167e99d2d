"""From aligned reads to filtered bases, one row a base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genomics import base_code
from ..params import Params

REFERENCE_OPS, QUERY_OPS, BASE_OPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("M", "=", "X")

#: op and len of every CIGAR operation.
CIGAR = "array<struct<op:string,len:int>>"


def parse_cigar(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=XB])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.substring(x, F.length(x), F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def _length(cigar: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0), lambda s, x: s + x["len"])


def reference_end(pos: Column, cigar: Column) -> Column:
    """Position behind the last reference base of an alignment."""
    return pos + _length(cigar, REFERENCE_OPS)


def query_length(cigar: Column) -> Column:
    return _length(cigar, QUERY_OPS)


def bin_of(beg: Column, end: Column) -> Column:
    """The smallest bin of the five-level binning index that holds [beg, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.shiftright(beg, shift) + first).otherwise(out)
    return out


def pass_flags(reads: DataFrame, mask: int) -> DataFrame:
    """Whole-file pileups' filter: reads with none of the flags."""
    return reads.where(F.col("flag").bitwiseAND(mask) == 0)


def explode_bases(reads: DataFrame) -> DataFrame:
    """One row a base that is aligned to the reference: chrom, pos, qpos and the read's columns.

    Deletions, skips, insertions and clips give none.  ``ord`` is the order of reads.
    """
    start = F.struct(F.col("pos").cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,len:int>>").alias("blocks"))

    def step(s: Column, x: Column) -> Column:
        block = F.array(F.struct(s["r"].alias("r"), s["q"].alias("q"), x["len"].alias("len")))
        return F.struct(
            (s["r"] + F.when(x["op"].isin(*REFERENCE_OPS), x["len"]).otherwise(0)).alias("r"),
            (s["q"] + F.when(x["op"].isin(*QUERY_OPS), x["len"]).otherwise(0)).alias("q"),
            F.when(x["op"].isin(*BASE_OPS) & (x["len"] > 0), F.concat(s["blocks"], block)).otherwise(s["blocks"]).alias("blocks"),
        )

    blocks = F.aggregate("cigar", start, step, lambda s: s["blocks"])
    spans = reads.withColumn("block", F.explode(blocks)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block.len") - 1)))
    return spans.withColumn("pos", F.col("block.r") + F.col("i")).withColumn("qpos", F.col("block.q") + F.col("i")).drop("block", "i")


def to_pileup(reads: DataFrame, read_groups: DataFrame | None, p: Params) -> DataFrame:
    """chrom, pos, sample_id, base, baseq, mapq, strand, ord from reads.

    Reads without a read group are left out; an unknown one is an error.
    ``read_groups`` (rg, sample_id) has a row for each @RG line of a header.  None stands for a
    header without such lines: all reads are of sample 0 (as the established tool has it, those with a group).
    """
    used = reads.where(F.col("flag").bitwiseAND(p.exclude_flags | 4) == 0)
    if read_groups is not None or p.reference:
        used = used.where(F.col("read_group").isNotNull())
    if read_groups is None:
        used = used.withColumn("sample_id", F.lit(0))
    else:
        used = used.join(F.broadcast(read_groups.select(F.col("rg").alias("read_group"), "sample_id")), "read_group", "left")
        unknown = F.raise_error(F.concat(F.lit("no sample for read group "), F.col("read_group"))).cast("int")
        used = used.withColumn("sample_id", F.coalesce("sample_id", unknown))
    bases = explode_bases(used)
    return bases.select(
        "chrom",
        "pos",
        "sample_id",
        base_code(F.substring("seq", F.col("qpos") + 1, F.lit(1))).alias("base"),
        F.element_at("qual", F.col("qpos") + 1).alias("baseq"),
        "mapq",
        F.shiftright(F.col("flag").bitwiseAND(16), 4).alias("strand"),
        "ord",
    )


def cap_depth(pileup: DataFrame, p: Params) -> DataFrame:
    """The first ``max_depth`` bases of each position and sample, in order of reads."""
    w = Window.partitionBy("chrom", "pos", "sample_id").orderBy("ord")
    return pileup.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.max_depth).drop("rank")


def effective_quality(baseq: Column, mapq: Column) -> Column:
    return F.least(F.greatest(F.least(baseq, mapq), F.lit(4)), F.lit(63))


def base_quality(baseq: Column, p: Params) -> Column:
    return F.greatest(baseq - 31, F.lit(0)) if p.illumina else baseq


def filter_bases(pileup: DataFrame, p: Params) -> DataFrame:
    """Quality filters and the effective quality ``qq``; after the depth cap, as the order matters."""
    scaled = pileup.withColumn("baseq", base_quality(F.col("baseq"), p))
    kept = scaled.where((F.col("baseq") >= p.min_baseq) & (F.col("mapq") >= p.min_mapq) & F.col("base").between(0, 3))
    return kept.withColumn("qq", effective_quality(F.col("baseq"), F.col("mapq")))
