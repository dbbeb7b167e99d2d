"""Alignment headers: parse, validate, merge, write, tables of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Required and optional tags of each line type, and the tag that names a line.
REQUIRED = {"HD": ("VN",), "SQ": ("SN", "LN"), "RG": ("ID", "SM"), "PG": ("ID",), "CO": ()}
OPTIONAL = {"HD": ("SO", "GO"), "SQ": ("AS", "M5", "UR", "SP"), "RG": ("CN", "DS", "DT", "FO", "KS", "LB", "PG", "PI", "PL", "PO", "PU"), "PG": ("VN", "CL", "PN", "PP"), "CO": ()}
UNIQUE = {"SQ": "SN", "RG": "ID", "PG": "ID"}

LINES = "line int, type string, tags map<string,string>, comment string"


def lines(text: DataFrame) -> DataFrame:
    """line, type, tags (a map) and comment, from a DataFrame with ``value`` (a line) and ``line`` (its number)."""
    fields = F.split("value", "\t")
    kind = F.substring(F.element_at(fields, 1), 2, 2)
    pairs = F.transform(F.filter(F.slice(fields, 2, F.size(fields)), lambda x: F.substring(x, 3, 1) == ":"), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(4), F.length(x))))
    tags = F.when(kind != "CO", F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>"))
    return text.where(F.col("value").startswith("@")).select("line", kind.alias("type"), tags.alias("tags"), F.when(kind == "CO", F.substring("value", F.lit(5), F.length("value"))).alias("comment"))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i, x) for i, x in enumerate(text.splitlines()) if x]
    return lines(spark.createDataFrame(rows, "line int, value string"))


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """A header file; it replaces the one of the alignments.  The order is that of the text, which one task reads."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return lines(whole)


def problems(header: DataFrame) -> DataFrame:
    """line and problem: unknown types, missing or unknown tags, names used twice."""
    required = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in REQUIRED.items() for x in kv])
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in ((k, REQUIRED[k] + OPTIONAL[k]) for k in REQUIRED) for x in kv])
    keys = F.map_keys("tags")
    unknown = header.where(~F.col("type").isin(*REQUIRED)).select("line", F.concat(F.lit("unknown type "), "type").alias("problem"))
    typed = header.where(F.col("type").isin(*REQUIRED))
    missing = typed.select("line", F.explode(F.array_except(required[F.col("type")], keys)).alias("tag")).select("line", F.concat(F.lit("missing "), "tag").alias("problem"))
    # lower-case tags are free
    extra = typed.select("line", F.explode(F.filter(F.array_except(keys, known[F.col("type")]), lambda t: t.rlike("^[A-Z]"))).alias("tag")).select("line", F.concat(F.lit("unknown tag "), "tag").alias("problem"))
    name = F.create_map(*[F.lit(x) for kv in UNIQUE.items() for x in kv])
    named = typed.where(F.col("type").isin(*UNIQUE)).select("line", "type", F.try_element_at("tags", name[F.col("type")]).alias("name"))
    twice = named.groupBy("type", "name").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1").select("line", F.concat(F.lit("used twice: "), F.coalesce("name", F.lit(""))).alias("problem"))
    return unknown.unionByName(missing).unionByName(extra).unionByName(twice)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both headers' lines; those of one name are joined tag by tag.

    Tags that differ are an error.  Equal comments and lines without a name occur once.
    """
    name = F.create_map(*[F.lit(x) for kv in UNIQUE.items() for x in kv])
    side = lambda h, k: h.withColumns({"side": F.lit(k), "name": F.when(F.col("type") == "HD", F.lit("HD")).otherwise(F.try_element_at("tags", name[F.col("type")]))})
    both = side(a, 0).unionByName(side(b, 1))
    key = F.coalesce("name", "comment", F.to_json("tags"))
    tags = both.where("size(tags) > 0").select("type", key.alias("key"), F.explode("tags").alias("tag", "value")).groupBy("type", "key", "tag").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    clash = F.raise_error(F.concat_ws(" ", F.lit("headers differ in"), "type", "key", "tag")).cast("string")
    tags = tags.withColumn("value", F.when(F.col("value") == F.col("other"), F.col("value")).otherwise(clash))
    joined = tags.groupBy("type", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")))).alias("tags"))
    order = both.groupBy("type", key.alias("key")).agg(F.min(F.struct("side", "line")).alias("at"), F.first("comment").alias("comment"))
    out = order.join(joined, ["type", "key"], "left").select("at", "type", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), "comment")
    from pyspark.sql import Window

    return out.withColumn("line", (F.row_number().over(Window.orderBy("at")) - 1)).select("line", "type", "tags", "comment")


def to_text(header: DataFrame) -> DataFrame:
    """line and value, the written line: required tags first, then the others by name."""
    first = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in REQUIRED.items() for x in kv])[F.col("type")]
    keys = F.concat(F.filter(first, lambda t: F.map_contains_key("tags", t)), F.array_sort(F.array_except(F.map_keys("tags"), first)))
    body = F.array_join(F.transform(keys, lambda t: F.concat(t, F.lit(":"), F.col("tags")[t])), "\t")
    return header.select("line", F.concat_ws("\t", F.concat(F.lit("@"), "type"), F.when(F.col("type") == "CO", F.col("comment")).otherwise(body)).alias("value"))


def table(header: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    """key and value of two tags of all lines of a type."""
    return header.where(F.col("type") == kind).select(F.try_element_at("tags", F.lit(key)).alias("key"), F.try_element_at("tags", F.lit(value)).alias("value")).where("key is not null and value is not null")


def values(header: DataFrame, kind: str, tag: str) -> DataFrame:
    return header.where(F.col("type") == kind).select("line", F.try_element_at("tags", F.lit(tag)).alias("value")).where("value is not null")


def contigs(header: DataFrame) -> DataFrame:
    return header.where("type = 'SQ'").select((F.col("line")).alias("ord"), F.col("tags")["SN"].alias("chrom"), F.try_element_at("tags", F.lit("LN")).cast("int").alias("length"))


def read_groups(header: DataFrame) -> DataFrame:
    """rg, sample, pop, library, ord of each @RG line; a tag is taken from its own line only."""
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    return header.where("type = 'RG'").select(tag("ID").alias("rg"), tag("SM").alias("sample"), tag("PO").alias("pop"), tag("LB").alias("library"), F.col("line").alias("ord")).where("rg is not null")


def assembly(header: DataFrame) -> str:
    """The first AS tag's value: the name of the reference."""
    row = values(header, "SQ", "AS").orderBy("line").first()
    if row is None:
        raise ValueError("no AS tag in the header")
    return row["value"]


def libraries(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Reads with their library; a header's read groups are few."""
    return reads.join(F.broadcast(groups.select(F.col("rg").alias("read_group"), "library")), "read_group", "left")


def target_list(spark: SparkSession, path: str) -> DataFrame:
    """contigs from a file of names and lengths, tab separated, plain or gzip."""
    schema = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("length", T.IntegerType())])
    return spark.read.csv(path, sep="\t", schema=schema)
