"""Connected components by alternating stars, on the executors; used by the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (u, v), for all nodes of an edge but the
    smallest ones themselves.

    Each round hangs every node's larger neighbours, then its smaller ones, onto its smallest neighbour; the edges are
    combined before each shuffle and written once per round. It ends when a round changes nothing, which takes a number
    of rounds that grows with the logarithm of the longest path.
    """
    edges = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "large-star")
        large = materialize(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), "small-star")
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = materialize(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
