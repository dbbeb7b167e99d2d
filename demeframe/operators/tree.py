"""Distance matrices with the reference as taxon 0, and neighbour-joining trees per window."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genomics as G
from ..params import Params
from . import sites as S
from .diversity import WIN


def differences(found: DataFrame, pops: list[S.Pop]) -> DataFrame:
    """win_id, num_sites, i, j, differ of all pairs of taxa; taxon t > 0 is sample t - 1.

    Sites collapse to their distinct bit sets first; the reference is a bit that is never set.
    """
    kept = S.all_pass(found, pops)
    few = kept.groupBy("win_id", "type_mask").agg(F.count("*").alias("c"), F.count_if(F.col("fq") > 0).alias("seg"))
    samples = sorted(i for x in pops for i in x.samples)
    pairs = [(-1, j) for j in samples] + [(i, j) for k, i in enumerate(samples) for j in samples[k + 1 :]]
    taxa = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j")) for i, j in pairs])
    rows = few.select("*", F.explode(taxa).alias("t")).select("*", "t.*")
    has = lambda t: F.when(F.col(t) > 0, G.has_bit(F.col("type_mask"), F.greatest(F.col(t) - 1, F.lit(0)))).otherwise(F.lit(False))
    return rows.groupBy("win_id", "i", "j").agg(F.sum("c").alias("num_sites"), F.sum("seg").alias("seg"), F.sum(F.when(has("i") != has("j"), F.col("c")).otherwise(F.lit(0).cast("long"))).alias("differ"))


def distances(found: DataFrame, pops: list[S.Pop], p: Params) -> DataFrame:
    """differences with ``d``, the share of sites, corrected if asked for."""
    share = F.col("differ").cast("double") / F.col("num_sites")
    return differences(found, pops).withColumn("d", G.jukes_cantor(share) if p.dist == "jc" else share)


def neighbour_joining(d: np.ndarray) -> list[list[tuple[int, float]]]:
    """Unrooted tree as neighbours with branch lengths; leaves first.  Of equal choices the first in order of (i, j)."""
    n = len(d)
    links: list[list[tuple[int, float]]] = [[] for _ in range(n)]

    def connect(a: int, b: int, length: float) -> None:
        links[a].append((b, length))
        links[b].append((a, length))

    names, d = list(range(n)), d.astype(float).copy()
    while len(names) > 3:
        m = len(names)
        total = d.sum(1)
        q = (m - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(m)] = np.inf
        i, j = divmod(int(np.argmin(q)), m)
        near = d[i, j] / 2 + (total[i] - total[j]) / (2 * (m - 2))
        node = len(links)
        links.append([])
        connect(names[i], node, near)
        connect(names[j], node, d[i, j] - near)
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(m) if k != j]
        d[i], d[:, i] = row, row
        d[i, i] = 0.0
        d = d[np.ix_(keep, keep)]
        names[i] = node
        names = [names[k] for k in keep]
    if len(names) == 3:
        node = len(links)
        links.append([])
        a, b, c = d[0, 1], d[0, 2], d[1, 2]
        for name, length in zip(names, ((a + b - c) / 2, (a + c - b) / 2, (b + c - a) / 2), strict=True):
            connect(name, node, length)
    elif len(names) == 2:
        connect(names[0], names[1], d[0, 1])
    return links


def newick(links: list[list[tuple[int, float]]], names: list[str]) -> str:
    """Rooted at the node beside taxon 0; negative branches are 0."""
    root, length = links[0][0]

    def text(node: int, parent: int) -> str:
        below = [f"{text(k, node)}:{max(0.0, x):.5f}" for k, x in links[node] if k != parent]
        return f"({','.join(below)})" if below else names[node]

    return f"({names[0]}:{max(0.0, length):.5f},{','.join(f'{text(k, root)}:{max(0.0, x):.5f}' for k, x in links[root] if k != 0)});"


def register_sql(spark: SparkSession) -> None:
    """nj_newick(names, distances) as a SQL function: the tree of a small matrix given row by row, null where a distance is."""

    @F.pandas_udf("string")
    def nj_newick(names: pd.Series, distances: pd.Series) -> pd.Series:
        def one(taxa, d) -> str | None:
            if taxa is None or d is None or len(d) != len(taxa) ** 2 or len(taxa) < 3:
                return None
            d = np.array(d, float).reshape(len(taxa), -1)
            return None if np.isnan(d).any() else newick(neighbour_joining(d), list(taxa))

        return pd.Series([one(a, b) for a, b in zip(names, distances, strict=True)])

    spark.udf.register("nj_newick", nj_newick)


def trees(found: DataFrame, pops: list[S.Pop], spine: DataFrame, p: Params, names: list[str]) -> DataFrame:
    """num_sites and the tree of each window; ``names`` starts with the reference's.

    Null where there are too few sites, no segregating one, fewer than three taxa or a distance without correction.
    One small matrix of at most 65 taxa goes to each call.
    """
    taxa = [0, *(i + 1 for i in sorted(i for x in pops for i in x.samples))]
    place = {t: k for k, t in enumerate(taxa)}
    shown = [names[t] for t in taxa]
    least = p.min_sites

    def run(table: pa.Table) -> pa.Table:
        sites = table.column("num_sites")[0].as_py()
        tree = None
        if sites >= least and pc.sum(table.column("seg")).as_py() and len(taxa) >= 3 and not table.column("d").null_count:
            d = np.zeros((len(taxa), len(taxa)))
            for i, j, x in zip(table.column("i").to_pylist(), table.column("j").to_pylist(), table.column("d").to_pylist(), strict=True):
                d[place[i], place[j]] = d[place[j], place[i]] = x
            tree = newick(neighbour_joining(d), shown)
        return pa.table({"win_id": table.column("win_id").slice(0, 1), "num_sites": pa.array([sites], pa.int64()), "newick": pa.array([tree], pa.string())})

    made = distances(found, pops, p).groupBy("win_id").applyInArrow(run, "win_id long, num_sites long, newick string")
    return spine.join(made, "win_id", "left").select(*WIN, F.coalesce("num_sites", F.lit(0).cast("long")).alias("num_sites"), "newick")
