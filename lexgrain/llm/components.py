"""Connected components of links by alternating large and small stars, with DataFrame operations only.

Each round is written to the shared folder; the driver sees one checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). large: neighbours above a node move to its least neighbour; small: those below, and the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.join(least, both.a == least.u).where(F.col("b") > F.col("u") if large else F.col("b") < F.col("u"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a > b")
    return out if large else out.distinct()  # a large star repeats no edge


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id that is reachable) of every id in links(a, b); null ends and loops are ignored."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = table(edges, "links")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        edges = table(_star(_star(edges, True), False), "stars", mark[0])  # a round adds no edges but for the nodes' own
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components did not settle")
