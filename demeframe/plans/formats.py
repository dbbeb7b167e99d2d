"""Tab-separated text of each command, one line a window, as ``value`` in order of ``win_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import diversity, haplotypes, snps
from .commands import Prepared, run

NA = "     NA"


def number(x: Column) -> Column:
    """Five places, or NA."""
    return F.when(x.isNull(), F.lit(NA)).otherwise(F.format_string("%.5f", x.cast("double")))


def wide(rows: DataFrame, by: list[Column], label: Column, values: dict[str, Column], shared: list[str]) -> DataFrame:
    """A line for each window: chrom, 1-based first and last base, ``shared`` counts, then labelled values in order of ``by``."""
    cell = F.array_join(F.array(*[F.concat(F.lit(name + "["), label, F.lit("]:\t"), v) for name, v in values.items()]), "\t")
    per = rows.groupBy("win_id", "chrom", "win_beg", "win_end", *shared).agg(F.array_sort(F.collect_list(F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], cell.alias("cell")))).alias("cells"))
    cells = F.array_join(F.transform("cells", lambda x: x["cell"]), "\t")
    return per.select("win_id", F.concat_ws("\t", "chrom", (F.col("win_beg") + 1).cast("string"), F.col("win_end").cast("string"), *[F.col(c).cast("string") for c in shared], cells).alias("value"))


def _by_pop(x: Prepared, rows: DataFrame) -> DataFrame:
    order = F.create_map(*[y for p in x.pops for y in (F.lit(p.name), F.lit(p.pop_id))])
    return rows.withColumn("o", order[F.col("pop")])


def text(command: str, x: Prepared) -> DataFrame:
    """win_id and value; write it ordered by win_id with ``write.text``."""
    rows = run(command, x)

    def line(rows: DataFrame, *how) -> DataFrame:
        # the established tool prints the end of a shortened window a base later
        return wide(rows.withColumn("win_end", F.col("win_end") + 1) if x.params.reference else rows, *how)

    count, o = (lambda c: F.col(c).cast("string")), x.params.output
    if command == "nucdiv":
        left = line(_by_pop(x, rows), [F.col("o")], F.col("pop"), {"ns": count("ns"), "pi": number(F.col("pi"))}, [])
        if len(x.pops) < 2:
            return left
        order = F.create_map(*[y for p in x.pops for y in (F.lit(p.name), F.lit(p.pop_id))])
        pairs = diversity.divergence_between(x.sites, x.pops, x.spine, x.params)
        right = line(pairs, [order[F.col("pop1")], order[F.col("pop2")]], F.concat_ws("-", "pop1", "pop2"), {"ns": count("ns"), "dxy": number(F.col("dxy"))}, [])
        tail = F.substring_index("r", "\t", -4 * (len(x.pops) * (len(x.pops) - 1) // 2))
        return left.join(right.withColumnRenamed("value", "r"), "win_id").select("win_id", F.concat_ws("\t", "value", tail).alias("value"))
    if command == "sfs":
        return line(_by_pop(x, rows), [F.col("o")], F.col("pop"), {"ns": count("ns"), "D": number(F.col("tajima_d")), "H": number(F.col("faywu_h"))}, [])
    if command == "diverge" and o:
        return line(_by_pop(x, rows), [F.col("o")], F.col("pop"), {"Fixed": count("fixed"), "Seg": count("seg"), "d": number(F.col("d"))}, ["num_sites"])
    if command == "diverge":
        names = F.array(*map(F.lit, x.names))
        return line(rows, [F.col("sample_id")], F.element_at(names, F.col("sample_id") + 1), {"d": number(F.col("d"))}, ["num_sites"])
    if command == "ld":
        values = ({"Zns": "zns"}, {"omax": "omega"}, {"B": "wall_b", "Q": "wall_q"})[o]
        return line(_by_pop(x, rows), [F.col("o")], F.col("pop"), {"S": count("s")} | {k: number(F.col(v)) for k, v in values.items()}, ["num_sites"])
    if command == "haplo" and o == 2:
        order = F.create_map(*[y for p in x.pops for y in (F.lit(p.name), F.lit(p.pop_id))])
        within = line(_by_pop(x, haplotypes.pairwise_pi(x.sites, x.pops, x.spine, x.params)), [F.col("o")], F.col("pop"), {"pi": number(F.col("pi"))}, ["num_sites"])
        if len(x.pops) < 2:
            return within
        between = line(rows, [order[F.col("pop1")], order[F.col("pop2")]], F.concat_ws("-", "pop1", "pop2"), {"dxy": number(F.col("mean_dxy")), "min": number(F.col("min_dxy"))}, ["num_sites"])
        tail = F.substring_index("r", "\t", -4 * (len(x.pops) * (len(x.pops) - 1) // 2))
        return within.join(between.withColumnRenamed("value", "r"), "win_id").select("win_id", F.concat_ws("\t", "value", tail).alias("value"))
    if command == "haplo":
        values = {"EHHS": number(F.col("ehhs"))} if o else {"K": F.coalesce(count("k"), F.lit(NA)), "Kdiv": number(F.col("kdiv"))}
        return line(_by_pop(x, rows), [F.col("o")], F.col("pop"), values, ["num_sites"])
    if command == "tree":
        return rows.select("win_id", F.concat_ws("\t", "chrom", (F.col("win_beg") + 1).cast("string"), F.col("win_end").cast("string"), count("num_sites"), F.coalesce("newick", F.lit("NA"))).alias("value"))
    if command == "snp" and o == 0:
        return snps.table_text(rows).select("pos", "value").withColumnRenamed("pos", "win_id")
    if command == "snp" and o == 1:
        per = rows.groupBy("win_id", "chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("pop_id", "x", "n"))).alias("p"))
        cells = F.array_join(F.transform("p", lambda c: F.concat_ws("\t", c["x"].cast("string"), c["n"].cast("string"))), "\t")
        return per.select(F.col("pos").alias("win_id"), F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), cells).alias("value"))
    if command == "snp":
        return snps.ms_text(rows)
    names = F.array(*map(F.lit, x.names))
    lines = F.regexp_replace("sequence", f"(.{{{snps.FASTA_WIDTH}}})(?!$)", "$1\n")
    return rows.select("win_id", F.concat(F.lit(">"), F.element_at(names, F.col("sample_id") + 1), F.lit("\n"), lines).alias("value"))
