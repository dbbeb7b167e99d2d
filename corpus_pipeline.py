"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor;
its result is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demeframe.llm import bpe, common, decontaminate, jaccard, pii, ppm

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = ("lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that no learned language explains; a missing lang is filled in."""
    common.arrow_limits(spark)
    predicted = ppm.predict(docs, ppm.train(ppm.training_rows(docs)), ("text", *REST))
    kept = predicted.where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("bits_per_byte") <= ppm.REJECT_BITS))
    return kept.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked ones; rows without an id stay.

    Of linked rows that share this id, those with the text of the least hash are the document, and of rows
    that share id and text the one with the least other columns stays.
    """
    found = jaccard.classified(docs).where("doc_id = component_id")
    # without words a row is linked with nothing
    alone = found.where("part is null").select("doc_id", "same").distinct()
    first = found.where("part is not null").groupBy("part", "doc_id").agg(F.min("same").alias("same")).select("doc_id", "same").unionByName(alone)
    known = docs.select(*COLUMNS, F.xxhash64("text").alias("same")).where("doc_id is not null").join(first, ["doc_id", "same"], "left_semi")
    once = known.groupBy("doc_id", "same").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return once.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages cover by a twentieth or more."""
    found = decontaminate.removal_spans(docs, common.read_table(spark, sf_dir, "benchmark"), carry=("text", *REST))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    kept = found.where(~((hit > 0) & (20 * hit >= F.col("n_words"))))
    return kept.select("doc_id", F.col("text").cast("string").alias("text"), *REST)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels personal data and generalises or removes terms that disclose it."""
    clean = pii.sanitised(docs, ("lang", "source"))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digests of ids and of what they decode to."""
    return bpe.round_trip(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: PPM code lengths and suffix searches have no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{k}-{name}")
    return docs
