"""python -m demeframe.cli COMMAND [options] READS REGION"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sites as S
from .operators.pileup import to_pileup
from .operators.snps import ms_header
from .operators.windows import n_windows, parse_region
from .params import Params
from .plans.commands import COMMANDS, Prepared, prepare
from .plans.formats import text
from .sources import alignments, fasta, header

HELP = {
    "snp": "variable sites, as rows (0), SweepFinder input (1) or ms blocks (2)",
    "fasta": "each sample's sequence",
    "haplo": "haplotype number and diversity (0), EHHS (1), pairwise differences (2)",
    "diverge": "divergence from the reference of samples (0) or populations (1)",
    "tree": "neighbour-joining trees",
    "nucdiv": "nucleotide diversity within and between populations",
    "ld": "linkage disequilibrium: ZnS (0), omega-max (1), Wall's B and Q (2)",
    "sfs": "Tajima's D and Fay and Wu's H",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="demeframe", description="Population-genetic statistics of aligned reads, per window.")
    verbs = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        v = verbs.add_parser(name, help=HELP[name], description=HELP[name], add_help=False)
        v.add_argument("--help", action="help")
        v.add_argument("reads", help="a BAM or SAM file, or a folder of BAM files")
        v.add_argument("region", help="chrom, chrom:beg or chrom:beg-end")
        v.add_argument("-f", dest="fasta", required=True, help="reference sequence")
        v.add_argument("-h", dest="header", help="a header that replaces that of the reads")
        v.add_argument("-i", dest="illumina", action="store_true", help="qualities of Illumina 1.3+")
        d = Params()
        for flag, field, kind in (("-m", "min_depth", int), ("-x", "max_depth", int), ("-q", "min_rms", int), ("-s", "min_snpq", int), ("-a", "min_mapq", int), ("-b", "min_baseq", int), ("-k", "min_sites", int), ("-o", "output", int), ("-z", "het_prior", float), ("-p", "outgroup", str)):
            v.add_argument(flag, dest=field, type=kind, default=getattr(d, field), help=f"{field.replace('_', ' ')} [{getattr(d, field)}]")
        v.add_argument("-n", dest="least", type=float, help="proportion of a population that has to pass; for ld the least number of SNPs")
        v.add_argument("-w", dest="window_kb", type=float, help="window in kilobases [the whole region]")
        v.add_argument("-d", dest="dist", default="pdist", choices=["pdist", "jc"])
        v.add_argument("-e", dest="no_singletons", action="store_true", help="leave out singletons")
        v.add_argument("-t", dest="substitutions_only", action="store_true", help="count fixed differences only")
        v.add_argument("-v", dest="variable_only", action="store_true", help="variable sites only")
        v.add_argument("--infinite-sites", dest="infinite_sites", action="store_true", help="only positions with two alleles at most")
        v.add_argument("--min-site-frac", dest="min_site_frac", type=float, help="aligned sites as a share of the window")
        v.add_argument("--compat", default="documented", choices=["documented", "reference"])
    return top


def params(a: argparse.Namespace) -> Params:
    names = Params.__dataclass_fields__
    given = {k: v for k, v in vars(a).items() if k in names}
    if a.window_kb is not None:
        given["window"] = int(a.window_kb * 1000)
    if a.least is not None:
        given |= {"min_snps": int(a.least)} if a.command == "ld" else {"min_pop": a.least}
    return Params(**given)


def load(spark: SparkSession, a: argparse.Namespace, p: Params) -> Prepared:
    bam = not a.reads.endswith(".sam")
    if a.header:
        head = header.from_file(spark, a.header)
    elif bam:
        head = header.from_text(spark, alignments.bam_header_text(a.reads))
    else:
        head = header.lines(spark.read.text(a.reads).where("value like '@%'").select("value", F.monotonically_increasing_id().cast("int").alias("line")))
    lengths = {r["chrom"]: r["length"] for r in header.contigs(head).collect()}
    region = parse_region(a.region, lengths)
    reads = alignments.read_bam(spark, a.reads, region) if bam else alignments.read_sam(spark, a.reads)
    groups = header.read_groups(head)
    named = bool(groups.take(1))
    samples = (S.sample_table(groups) if named else S.single_sample(spark, os.path.basename(a.reads.rstrip("/")))).persist()
    names = [r["sample"] for r in samples.select("sample_id", "sample").distinct().orderBy("sample_id").collect()]
    near = alignments.overlapping(reads, region.chrom, region.beg, region.end)
    ref = fasta.ref_bases(fasta.read_chunks(spark, a.fasta), region.chrom, region.beg, region.end)
    return prepare(spark, to_pileup(near, samples.select("rg", "sample_id") if named else None, p), ref, S.assign_pops(samples), names, region, p)


def lines(spark: SparkSession, argv: list[str]) -> DataFrame:
    """win_id and value; an ms file's header comes first, as win_id -1."""
    a = parser().parse_args(argv)
    x = load(spark, a, params(a))
    out = text(a.command, x)
    if a.command == "snp" and x.params.output == 2:
        head = spark.createDataFrame([(-1, ms_header(x.pops, n_windows(x.region, x.params)))], "win_id long, value string")
        out = head.unionByName(out.select(F.col("win_id").cast("long").alias("win_id"), "value"))
    return out


def main(argv: list[str] | None = None) -> int:
    a = sys.argv[1:] if argv is None else argv
    parser().parse_args(a)
    spark = SparkSession.builder.appName("demeframe").getOrCreate()
    for row in lines(spark, a).orderBy("win_id").toLocalIterator():
        print(row["value"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
