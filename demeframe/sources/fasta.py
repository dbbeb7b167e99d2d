"""Reference sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chrom, beg and a line's bases, for each line of a FASTA file."""
    return chunks(spark.read.text(path))


def chunks(text: DataFrame) -> DataFrame:
    """The same from the file's lines (``value``), in the order of the table.

    Lines get their places from sums of lengths: within parts of the file first,
    then over the parts' totals, so no task holds a contig.
    """
    text = text.select("value").withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    rows = text.select("part", "id", F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S+)", 1)).alias("name"), F.when(F.col("value").startswith(">"), F.lit("")).otherwise(F.trim("value")).alias("bases"))
    w = Window.partitionBy("part").orderBy("id")
    rows = rows.withColumns({"own": F.last("name", True).over(w), "head": F.max(F.when(F.col("name").isNotNull(), F.col("id"))).over(w)})
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("bases")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at_head = F.coalesce(F.max(F.when(F.col("name").isNotNull(), F.col("before"))).over(w), F.lit(0))
    rows = rows.withColumn("inside", F.col("before") - at_head)
    # of each part: the last name in it and the bases behind that
    ends = rows.groupBy("part").agg(F.max_by("own", "id").alias("last"), F.max_by(F.col("inside") + F.length("bases"), "id").alias("tail"), F.count("name").alias("names"))
    order = Window.orderBy("part")
    ends = ends.withColumn("group", F.sum(F.when(F.col("names") > 0, 1).otherwise(0)).over(order))
    # a handful of rows: one for each part of the file
    ends = ends.withColumns({"filled": F.last("last", True).over(order), "run": F.sum("tail").over(Window.partitionBy("group").orderBy("part"))})
    carried = ends.select("part", F.lag("filled").over(order).alias("from"), F.coalesce(F.lag("run").over(order), F.lit(0)).alias("offset"))
    placed = rows.join(carried, "part")
    chrom = F.coalesce("own", "from")
    beg = F.when(F.col("own").isNull(), F.col("inside") + F.col("offset")).otherwise(F.col("inside"))
    return placed.where(F.length("bases") > 0).select(chrom.alias("chrom"), beg.cast("int").alias("beg"), "bases")


def ref_bases(chunks: DataFrame, chrom: str | None = None, beg: int = 0, end: int = 1 << 31) -> DataFrame:
    """chrom, pos, ref: a row each position of the region."""
    kept = chunks.where((F.col("beg") < end) & (F.col("beg") + F.length("bases") > beg))
    if chrom is not None:
        kept = kept.where(F.col("chrom") == chrom)
    rows = kept.select("chrom", "beg", F.posexplode(F.split("bases", "")).alias("i", "ref")).where("ref <> ''")
    return rows.select("chrom", (F.col("beg") + F.col("i")).alias("pos"), "ref").where((F.col("pos") >= beg) & (F.col("pos") < end))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chrom").agg(F.max(F.col("beg") + F.length("bases")).alias("length"))
