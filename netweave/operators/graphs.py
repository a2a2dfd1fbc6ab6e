"""Views and metrics over one graph per key: ``(*keys, i, j, w)`` with i < j."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.operators.tensor import mirrored, positive_edges

TINY = 1e-12
# Count matrices a task keeps open before it passes them on to the shuffle.
MAX_OPEN_KEYS = 256


def strongest_edges(graphs: DataFrame, keys: list[str], k: int = 35) -> DataFrame:
    """Top ``k`` positive edges per key, ties in row-major order, with their rank.

    The rank filter reaches the sort as a group limit, so each task keeps k rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("w").desc(), "i", "j")
    return positive_edges(graphs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def display_scale(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(w - min) / (max - min) within the key, 1 when all weights agree."""
    w = Window.partitionBy(*keys)
    low, high = F.min("w").over(w), F.max("w").over(w)
    flat = (high - low) <= TINY
    return edges.withColumn("scaled", F.when(flat, 1.0).otherwise((F.col("w") - low) / F.when(flat, 1.0).otherwise(high - low)))


def node_metrics(graphs: DataFrame, labels: DataFrame, keys: list[str], k: int = 35) -> DataFrame:
    """Per node: strength, and degree and strength within the top ``k`` edges."""
    order = Window.partitionBy(*keys).orderBy(F.col("w").desc(), "i", "j")
    top = F.when((F.row_number().over(order) <= k) & (F.col("w") > 0), F.col("w"))
    ends = mirrored(graphs.select(*keys, "i", "j", "w", top.alias("tw")))
    per_node = ends.groupBy(*keys, F.col("i").alias("node")).agg(
        F.sum("w").alias("strength"), F.count("tw").alias("top_degree"),
        F.coalesce(F.sum("tw"), F.lit(0.0)).alias("top_strength"),
    )
    shared = [c for c in keys if c in labels.columns] + ["node"]
    return per_node.join(labels, shared)


def isolated_nodes(graphs: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes without positive weight inside their community: (*keys, node, community)."""
    shared = [c for c in keys if c in labels.columns]
    kin = labels.select(*shared, F.col("node").alias("j"), F.col("community").alias("other"))
    inside = mirrored(graphs).withColumnRenamed("i", "node").join(labels, [*shared, "node"]).join(kin, [*shared, "j"])
    linked = (
        inside.filter("community = other").groupBy(*keys, "node").agg(F.sum("w").alias("w")).filter(F.col("w") > TINY)
    )
    if shared == keys:
        everyone = labels
    elif shared:
        everyone = graphs.select(*keys).distinct().join(labels, shared)
    else:
        everyone = with_keys(labels, graphs, keys)
    return everyone.select(*keys, "node", "community").join(linked.select(*keys, "node"), [*keys, "node"], "left_anti")


def with_keys(labels: DataFrame, graphs: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat one common partition (one entry per node) for every key, as a scalar array."""
    everyone = labels.agg(F.collect_list(F.struct("node", "community"))).scalar()
    return graphs.select(*keys).distinct().withColumn("all", everyone).select(*keys, F.inline("all"))


def community_order(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Matrix position of each node when rows are sorted by community, then node."""
    w = Window.partitionBy(*keys).orderBy("community", "node")
    return labels.withColumn("position", F.row_number().over(w) - 1)


def relabel(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Communities renumbered 1, 2, ... by their smallest node."""
    first = F.min("node").over(Window.partitionBy(*keys, "community"))
    return labels.withColumn("_first", first).select(
        *[c for c in labels.columns if c != "community"],
        F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")).cast("bigint").alias("community"),
    )


def first_occurrences(values: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Distinct values in the order they first appear."""
    return values.groupBy(*keys, value).agg(F.min(position).alias(position)).orderBy(*keys, position)


def modularity(graphs: DataFrame, labels: DataFrame, keys: list[str], empty: float | None = 0.0) -> DataFrame:
    """Weighted modularity per key: sum over communities of inside/total - (degree/total)^2.

    Both ends of an edge are labelled by an equi-join; the value of a graph without weight
    is ``empty``.
    """
    shared = [c for c in keys if c in labels.columns]
    extra = [c for c in labels.columns if c not in ("node", "community") and c not in shared]
    other = labels.select(*shared, *extra, F.col("node").alias("j"), F.col("community").alias("other"))
    ends = mirrored(graphs).withColumnRenamed("i", "node").join(labels, [*shared, "node"]).join(other, [*shared, *extra, "j"])
    out = [*keys, *extra]
    per = ends.groupBy(*out, "community").agg(
        F.sum("w").alias("degree"), F.sum(F.when(F.col("community") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inside")
    )
    total = F.sum("degree").over(Window.partitionBy(*out))
    share = per.withColumn("total", total)
    safe = F.when(F.col("total") > TINY, F.col("total"))
    return share.groupBy(*out).agg(
        F.coalesce(F.sum(F.col("inside") / safe - (F.col("degree") / safe) * (F.col("degree") / safe)), F.lit(empty)).alias("q")
    )


def cooccurrence(labels: DataFrame, keys: list[str], graph_keys: list[str], n_nodes: int) -> DataFrame:
    """Share of graphs in which two nodes carry the same label: (*keys, i, j, w), i < j.

    ``labels(*keys, *graph_keys, node, community)``. Each graph is packed to one row; a task
    adds its graphs into one nodes x nodes count per key before anything is shuffled.
    """
    packed = labels.groupBy(*keys, *graph_keys).agg(F.sort_array(F.collect_list(F.struct("node", "community"))).alias("p"))
    packed = packed.select(*keys, F.transform("p", lambda x: x["node"]).alias("nodes"), F.transform("p", lambda x: x["community"]).alias("comms"))
    return share_counts(agreement_counts(packed, keys, n_nodes), keys)


def agreement_counts(packed: DataFrame, keys: list[str], n_nodes: int) -> DataFrame:
    """Per key and pair: number of graphs agreeing; (i, i) rows carry the number of graphs."""
    import numpy as np
    import pandas as pd

    def cells(sums):
        for key, total in sums.items():
            i, j = np.nonzero(np.triu(total))
            yield pd.DataFrame({**dict(zip(keys, key)), "i": i, "j": j, "n": total[i, j].astype("int64")}, index=range(i.size))

    def run(pdfs):
        sums: dict = {}
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                nodes = np.asarray(row.nodes, dtype=int)
                comms = np.asarray(row.comms)
                total = sums.setdefault(key, np.zeros((n_nodes, n_nodes)))
                total[np.ix_(nodes, nodes)] += comms[:, None] == comms[None, :]
                if len(sums) > MAX_OPEN_KEYS:
                    yield from cells(sums)
                    sums = {}
        yield from cells(sums)

    types = dict(packed.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", i bigint, j bigint, n bigint"
    return packed.mapInPandas(run, schema).groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))


def share_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    graphs = F.max(F.when(F.col("i") == F.col("j"), F.col("n"))).over(Window.partitionBy(*keys))
    return counts.select(*keys, "i", "j", (F.col("n") / graphs).alias("w")).filter("i < j")
