"""Projections, reductions and contractions of connectivity tensors in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.scalar import finite_or_zero, soft_threshold
from netweave.shape import TensorShape, densify

PAPER_LAYOUT = ["i", "j", "subj", "t"]
SUBJECT_FIRST_LAYOUT = ["subj", "i", "j", "t"]


def reorder(edges: DataFrame, layout: list[str]) -> DataFrame:
    """Axis order is only column order in long form."""
    return edges.select("cond", *layout, "w")


def symmetrise(directed: DataFrame, clip: bool = True) -> DataFrame:
    """Non-finite -> 0, (W + W')/2, then negatives -> 0 if ``clip``, diagonal dropped.

    ``directed`` has at most one row per ordered pair; a missing direction counts as 0.
    """
    keys = [c for c in directed.columns if c not in ("i", "j", "w")]
    w = F.sum(finite_or_zero(F.col("w"))) / 2.0
    return (
        directed.filter("i <> j")
        .groupBy(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .agg((F.greatest(w, F.lit(0.0)) if clip else w).alias("w"))
    )


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every stored pair."""
    rest = [c for c in edges.columns if c not in ("i", "j")]
    ends = F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return edges.select(*rest, F.inline(ends))


def positive_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("w > 0")


def shrink(edges: DataFrame, tau: float) -> DataFrame:
    return edges.withColumn("w", soft_threshold(F.col("w"), tau))


def subject_mean(edges: DataFrame, shape: TensorShape) -> DataFrame:
    """Mean over all subjects, absent ones counting as 0."""
    return edges.groupBy("cond", "i", "j", "t").agg((F.sum("w") / F.lit(float(shape.n_subjects))).alias("w"))


def global_profile(edges: DataFrame, shape: TensorShape) -> DataFrame:
    """Mean over subjects and the full square (zero diagonal included) per frame."""
    cells = float(shape.n_subjects * shape.n_nodes * shape.n_nodes)
    return edges.groupBy("cond", "t").agg((F.sum("w") * 2.0 / F.lit(cells)).alias("mean_w"))


def mean_graph_energy(edges: DataFrame, shape: TensorShape) -> DataFrame:
    """Frobenius norm of the subject-mean graph per frame."""
    mean = subject_mean(edges, shape)
    return mean.groupBy("cond", "t").agg(F.sqrt(2.0 * F.sum(F.col("w") * F.col("w"))).alias("v"))


def component_energy(edges: DataFrame, shape: TensorShape) -> DataFrame:
    """Mean over subjects of the Frobenius norm, and mean square cell, per frame."""
    per_subject = edges.groupBy("cond", "t", "subj").agg((2.0 * F.sum(F.col("w") * F.col("w"))).alias("ss"))
    s, n = float(shape.n_subjects), float(shape.n_nodes)
    return per_subject.groupBy("cond", "t").agg(
        (F.sum(F.sqrt("ss")) / F.lit(s)).alias("mean_norm"),
        (F.sum("ss") / F.lit(s * n * n)).alias("mean_square"),
    )


def zscore_features(mean_edges: DataFrame, shape: TensorShape) -> DataFrame:
    """Edge series scaled by mean and population deviation over time; constants become 0."""
    w = Window.partitionBy("cond", "i", "j")
    dense = densify(mean_edges.withColumn("w", finite_or_zero(F.col("w"))), shape)
    return (
        dense.select("*", F.avg("w").over(w).alias("mu"), F.stddev_pop("w").over(w).alias("sd"))
        .select("cond", "i", "j", "t", F.when(F.col("sd") > 0, (F.col("w") - F.col("mu")) / F.col("sd"))
                .otherwise(0.0).alias("z"))
    )


def interval_slice(edges: DataFrame, intervals: DataFrame) -> DataFrame:
    """Attach the interval of each frame (``start <= t < end``).

    Intervals expand to their frames, so this is an equi-join on (cond, t).
    """
    frames = intervals.filter("end > start").select(
        "cond", "interval",
        F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"),
        (F.col("end") - F.col("start")).alias("n_frames"),
    )
    return edges.join(frames, ["cond", "t"])


def interval_graphs(edges: DataFrame, intervals: DataFrame, clip: bool = True, single: bool = True) -> DataFrame:
    """Mean graph per subject and interval; ``single`` rounds to float32 as stored stacks do."""
    w = F.sum("w") / F.first("n_frames")
    w = F.greatest(w, F.lit(0.0)) if clip else w
    w = w.cast("float").cast("double") if single else w
    return interval_slice(edges, intervals).groupBy("cond", "interval", "subj", "i", "j").agg(w.alias("w"))


def group_mean(graphs: DataFrame, shape: TensorShape) -> DataFrame:
    """Mean over subjects of clipped interval graphs."""
    return graphs.groupBy("cond", "interval", "i", "j").agg((F.sum("w") / F.lit(float(shape.n_subjects))).alias("w"))


def pooled_mean(edges: DataFrame, intervals: DataFrame, shape: TensorShape) -> DataFrame:
    """Mean over subjects and frames together, clipped only afterwards."""
    w = F.sum("w") / (F.first("n_frames") * F.lit(float(shape.n_subjects)))
    return (
        interval_slice(edges, intervals).groupBy("cond", "interval", "i", "j")
        .agg(F.greatest(w, F.lit(0.0)).alias("w"))
    )


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keep pairs whose ends are both in ``nodes(node)``."""
    return (
        edges.join(nodes.select(F.col("node").alias("i")), "i", "left_semi")
        .join(nodes.select(F.col("node").alias("j")), "j", "left_semi")
    )


def mode_product(cells: DataFrame, matrix: DataFrame, axis: str) -> DataFrame:
    """Contract ``axis`` of ``cells(..., w)`` with ``matrix(row, col, m)``: axis becomes row (see `contraction`)."""
    from netweave.operators.contraction import contract_cells

    return contract_cells(cells, matrix, axis)
