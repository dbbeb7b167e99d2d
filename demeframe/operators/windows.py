"""Regions and tumbling windows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params


@dataclass(frozen=True)
class Region:
    """0-based, half-open."""

    chrom: str
    beg: int
    end: int


def parse_region(text: str, contigs: dict[str, int]) -> Region:
    """``chr``, ``chr:beg`` or ``chr:beg-end`` with 1-based, inclusive coordinates; clipped to the contig."""
    text = text.replace(",", "").strip()
    if text in contigs:
        return Region(text, 0, contigs[text])
    m = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", text)
    if not m or m[1] not in contigs:
        raise ValueError(f"no contig for region {text!r}")
    beg, end = max(0, int(m[2]) - 1), min(int(m[3]) if m[3] else contigs[m[1]], contigs[m[1]])
    if beg > end:
        raise ValueError(f"region {text!r} ends before it begins")
    return Region(m[1], beg, end)


def in_region(region: Region, pos: str = "pos") -> Column:
    """A filter on literals, so it reaches the scan."""
    return (F.col("chrom") == region.chrom) & (F.col(pos) >= region.beg) & (F.col(pos) < region.end)


def n_windows(region: Region, p: Params) -> int:
    if p.window is None:
        return 1
    length = region.end - region.beg
    return max(0, (length - 1) // p.window) if p.reference else -(-length // p.window)


def spine(spark: SparkSession, region: Region, p: Params) -> DataFrame:
    """Every window of the region, with or without sites; win_beg and win_end are 0-based, half-open."""
    w = p.window or region.end - region.beg
    beg = F.lit(region.beg).cast("long") + F.col("id") * w
    end = beg + w - (1 if p.reference and p.window else 0)
    return spark.range(n_windows(region, p)).select(F.col("id").alias("win_id"), F.lit(region.chrom).alias("chrom"), beg.cast("int").alias("win_beg"), F.least(end, F.lit(region.end).cast("long")).cast("int").alias("win_end"))


def with_window(df: DataFrame, region: Region, p: Params, pos: str = "pos") -> DataFrame:
    """Rows inside a window of the region, with its win_id: arithmetic, no range join."""
    df = df.where(in_region(region, pos))
    if p.window is None:
        return df.withColumn("win_id", F.lit(0).cast("long"))
    df = df.withColumn("win_id", F.floor((F.col(pos) - F.lit(region.beg)) / F.lit(p.window)).cast("long"))
    if p.reference:  # each window ends a base early, and a part of a window isn't one
        df = df.where((F.pmod(F.col(pos) - F.lit(region.beg), F.lit(p.window)) < p.window - 1) & (F.col("win_id") < n_windows(region, p)))
    return df
