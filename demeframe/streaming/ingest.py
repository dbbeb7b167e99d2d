"""Incremental ingestion: new shards of a pileup arrive as a stream, and windows they touch are counted again.

Positions aren't event time, so there is no watermark: each batch is stored and
the statistic recomputed for its windows alone, from all shards stored so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import Region, with_window
from ..params import Params


def ingest(spark: SparkSession, source: str, store: str, out: str, checkpoint: str, schema: str, region: Region, p: Params, statistic: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Starts a query over Parquet files that appear in ``source``.

    ``statistic`` takes the pileup of the touched windows and returns rows with
    win_id.  Each batch's results go to ``out/batch=<n>``; a batch that is run
    again overwrites its own, so results are exact once.
    """

    def each(batch: DataFrame, number: int) -> None:
        with_window(batch, region, p).write.mode("overwrite").partitionBy("win_id").parquet(f"{store}/batch={number}")
        touched = spark.read.parquet(f"{store}/batch={number}").select(F.col("win_id").cast("long").alias("win_id")).distinct()
        stored = spark.read.option("basePath", store).parquet(f"{store}/batch=*").where(F.col("batch") <= number)
        whole = stored.withColumn("win_id", F.col("win_id").cast("long")).join(touched, "win_id", "left_semi")
        statistic(whole.drop("batch")).join(touched, "win_id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Each window's rows of the last batch that touched it."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = rows.groupBy("win_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["win_id", "batch"], "left_semi").drop("batch")
