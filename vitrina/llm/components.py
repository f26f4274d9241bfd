"""Connected components of a link table, by alternating large and small stars.

Each round points every node at the least node of its neighbourhood; the edge set shrinks to
stars. Rounds grow with the logarithm of the longest chain. A node's least neighbour comes from an
aggregation with map-side combine and is joined back by node; the nodes with very many links (the centres of
large stars) are split off that join and broadcast, a bounded number of them, so none of them is a task of its
own size. Every round is cut by checkpoint() into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import join_unique, shared_dir


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (a, b): b is a neighbour of a. Links of a's larger (large) or not larger neighbours to a's least one."""
    seen = pairs if large else pairs.filter("b < a")
    stats = seen.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n").checkpoint()
    least = stats.select("a", "m")
    joined = join_unique(seen, least, "a", counted=stats.select("a", "n"), grows=True)
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of one orderable type, without nulls -> node, component (its least node); linked nodes only."""
    shared_dir(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now = _star(_star(_both_ways(now), large=True).checkpoint(), large=False).checkpoint()
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
