"""Connected components of a graph given as edges, in Spark alone.

Alternates the large-star and small-star steps until nothing changes, so the
rounds grow with the logarithm of a component's breadth and no vertex ever
holds the members of a large component.  Each round's edges are written to the
shared folder: that cuts the lineage and outlives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    out = common.written(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "edges")
    # count and sums tell whether the set of edges has changed
    seen = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return out, tuple(seen)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of all vertices of the edges (u, v); the component is its smallest vertex."""
    both = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and u < v").distinct()
    now, mark = _written(both)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # large star: every larger neighbour of a vertex goes to the smallest of it and its neighbours
        sides = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.join(least, "a").where("b > a and m < b").select(F.col("m").alias("u"), F.col("b").alias("v")).distinct()
        # small star: a vertex and its smaller neighbours go to the smallest of these
        down = large.select(F.col("v").alias("a"), F.col("u").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b > m").select(F.col("m").alias("u"), F.col("b").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("a").alias("v"))).distinct()
        then, after = _written(small)
        if after == mark:
            break
        now, mark = then, after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
