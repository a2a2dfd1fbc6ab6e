"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.stage import stage


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node with an edge.

    ``edges`` has bigint columns a, b; direction, loops and repeats don't matter, rows with nulls are left out. Each
    round joins the edge table with one map-side combined minimum per node, as a plain join of two stored
    tables whose hot nodes adaptive execution splits. Rounds are logarithmic in practice; they end when the
    links form stars around their smallest nodes. Every round is a stored table, so a lost executor repeats one round.
    """
    edges = _stored(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct())
    for _ in range(rounds):
        least = _neighbours(edges)
        # settled: every node is either the root of a star or has one neighbour, its root
        if least.where("smaller > 1 or (smaller = 1 and larger > 0)").isEmpty():
            break
        edges = _small_star(_large_star(edges, least))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _stored(edges: DataFrame) -> DataFrame:
    """Links are far fewer than the rows the session's partitions are made for: an eighth of them holds the links."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(edges.coalesce(max(2, parts // 8)))


def _neighbours(edges: DataFrame) -> DataFrame:
    """(a, m, smaller, larger): the smallest of a node and its neighbours, and how many are smaller and larger."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _stored(both.groupBy("a").agg(
        F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") < F.col("a")).alias("smaller"),
        F.count_if(F.col("b") > F.col("a")).alias("larger"),
    ))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest of the node and its neighbours."""
    # edges (a, b) have b < a: a is b's larger neighbour
    return _stored(edges.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node's smaller neighbours, and the node, with the smallest of them."""
    least = _stored(edges.groupBy("a").agg(F.min("b").alias("m")))
    joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return _stored(joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
