"""A deterministic pileup, reads, a header and a reference made of a star schema, for checks and benchmarks.

Eight samples in two populations; positions are parts.  See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sites as S
from ..operators.pileup import parse_cigar, reference_end
from ..operators.windows import Region
from . import header

SAMPLES, PER_POP = 8, 4
POPS = [S.Pop(0, "popA", 0x0F, 4), S.Pop(1, "popB", 0xF0, 4)]
CHROM = "chr1"
#: What reads' alignments look like, by order modulo their number; all have READ bases.
CIGARS, READ = ("5M", "2M1I2M", "2M2D3M", "2S3M", "1M3N4M", "2=1X2=", "1H4M1S2H"), 5
LINE = 10
HEADER = "\n".join(
    [
        "@HD\tVN:1.0\tSO:coordinate",
        "@SQ\tSN:chr1\tLN:1000000\tAS:refv1",
        "@SQ\tSN:chr2\tLN:500",
        *(f"@RG\tID:rg{i}\tSM:s{i}\tPO:{'popA' if i < PER_POP else 'popB'}" + (f"\tLB:lib{i % 3}" if i != 5 else "") for i in range(SAMPLES)),
        "@CO\tmade of order lines",
    ]
)


def header_lines(spark: SparkSession, text: str = HEADER) -> DataFrame:
    return header.from_text(spark, text)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of five bases: with duplicates, unmapped ones, unknown bases and some without a read group."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order, part = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_partkey")
    flag = F.when(F.col("l_linestatus") == "F", 16).otherwise(0) + F.when(F.col("l_linenumber") == 5, 4).when(F.col("l_linenumber") == 4, 1024).otherwise(0)
    kinds = F.array(*map(F.lit, CIGARS))
    out = x.select(
        F.concat(F.lit("q"), order.cast("string")).alias("qname"),
        flag.cast("int").alias("flag"),
        F.lit(CHROM).alias("chrom"),
        part.cast("int").alias("pos"),
        (20 + F.round(F.col("l_discount") * 100) * 4).cast("int").alias("mapq"),
        parse_cigar(F.element_at(kinds, (F.col("l_orderkey") % len(CIGARS) + 1).cast("int"))).alias("cigar"),
        F.substring(F.lit("ACGTNACGTN"), (part % 5 + 1).cast("int"), F.lit(READ)).alias("seq"),
        F.transform(F.sequence(F.lit(0), F.lit(READ - 1)), lambda i: F.col("l_quantity").cast("int") + i).alias("qual"),
        F.when(F.col("l_linenumber") != 6, F.concat(F.lit("rg"), (F.col("l_suppkey") % SAMPLES).cast("string"))).alias("read_group"),
        order.cast("long").alias("ord"),
    )
    return out.withColumn("ref_end", reference_end(F.col("pos"), F.col("cigar")))


def fasta_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value``: a FASTA file's lines, in order; position p has the base p modulo four, the second contig is short."""
    end = region(spark, sf_dir).end
    lines = -(-end // LINE)
    bases = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(LINE), F.lit(end) - (F.col("id") - 1) * LINE).cast("int") - 1), lambda i: F.substring(F.lit("ACGT"), (((F.col("id") - 1) * LINE + i) % 4 + 1).cast("int"), F.lit(1))), "")
    value = F.when(F.col("id") == 0, F.lit(f">{CHROM} made")).when(F.col("id") <= lines, bases).when(F.col("id") == lines + 1, F.lit(">chr2")).otherwise(F.lit("ACG"))
    return spark.range(lines + 3).select(value.alias("value"))


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, sample_id, base, baseq, mapq, strand, ord; four columns more of the scan than it needs would be read else."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sample = (F.col("l_suppkey") % SAMPLES).cast("int")
    part = F.col("l_partkey")
    base = F.when(F.col("l_linenumber") == 7, (part + 2) % 4).when((part * 7 + F.col("l_suppkey") % SAMPLES * 13) % 11 < 3, (part + 1) % 4).otherwise(part % 4)
    return x.select(
        F.lit(CHROM).alias("chrom"),
        part.cast("int").alias("pos"),
        sample.alias("sample_id"),
        base.cast("int").alias("base"),
        F.col("l_quantity").cast("int").alias("baseq"),
        (20 + F.round(F.col("l_discount") * 100) * 4).cast("int").alias("mapq"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("strand"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"),
    )


def ref_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos and the base, from the parts themselves."""
    part = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(CHROM).alias("chrom"), part.cast("int").alias("pos"), F.substring(F.lit("ACGT"), (part % 4 + 1).cast("int"), F.lit(1)).alias("ref"))


def region(spark: SparkSession, sf_dir: str) -> Region:
    last = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0] or 0
    return Region(CHROM, 0, int(last) + 1)
