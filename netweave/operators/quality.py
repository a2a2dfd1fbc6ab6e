"""Rank-based quality of a partition: homogeneity, completeness and their harmonic mean.

Ranks of all graphs of a key are first pooled to counts per (i, j, rank), whose size does
not depend on the number of graphs; partitions are scored against that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.operators.tensor import mirrored

KEYS = ["cond", "interval"]


def rank_bins(graphs: DataFrame, n_nodes: int, subjects: tuple[str, ...], keys: DataFrame) -> DataFrame:
    """Rank of every other node j seen from i by descending weight, ties by j, zeros included.

    ``graphs(cond, interval, subj, i, j, w)`` need not store zero edges; they are completed
    for every (cond, interval) of ``keys`` and all ``subjects``.
    """
    nodes = F.sequence(F.lit(0).cast("bigint"), F.lit(n_nodes - 1).cast("bigint"))
    spine = (
        keys.select(*KEYS, F.explode(F.array(*[F.lit(s) for s in subjects])).alias("subj"))
        .select("*", F.explode(nodes).alias("i"))
        .select("*", F.explode(nodes).alias("j"))
        .filter("i <> j")
    )
    dense = spine.join(mirrored(graphs), [*KEYS, "subj", "i", "j"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    w = Window.partitionBy(*KEYS, "subj", "i").orderBy(F.col("w").desc(), "j")
    return dense.select(*KEYS, "subj", "i", "j", F.row_number().over(w).cast("bigint").alias("rank"))


def pooled_ranks(ranks: DataFrame) -> DataFrame:
    """Counts over all graphs of a key: (cond, interval, i, j, rank, n)."""
    return ranks.groupBy(*KEYS, "i", "j", "rank").agg(F.count("*").alias("n"))


def rank_histograms(pooled: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of rank per community, inside it and from it to the outside.

    ``labels(cond, interval[, k], node, community)``. Rows: rank 1..n for every community.
    A key's pooled counts are bounded by the cube of the node count, so they are brought
    together per (cond, interval) once and everything after reuses that partitioning.
    """
    extra = [c for c in labels.columns if c not in (*KEYS, "node", "community")]
    whole = Window.partitionBy(*KEYS, *extra)
    sized = labels.select(
        *labels.columns, F.count("*").over(whole).alias("n_nodes"),
        F.count("*").over(Window.partitionBy(*KEYS, *extra, "community")).alias("size"),
        F.min("node").over(Window.partitionBy(*KEYS, *extra, "community")).alias("_head"),
    )
    carry = [*KEYS, *extra, "community", "size", "n_nodes"]
    seen = sized.select(*carry, F.col("node").alias("i"))
    other = labels.select(*KEYS, *extra, F.col("node").alias("j"), F.col("community").alias("other"))
    same = F.col("community") == F.col("other")
    zero = F.lit(0).cast("bigint")
    counted = pooled.join(seen, [*KEYS, "i"]).join(other, [*KEYS, *extra, "j"]).select(
        *carry, "rank", F.when(same, F.col("n")).otherwise(0).alias("intra"), F.when(same, 0).otherwise(F.col("n")).alias("inter")
    )
    blank = sized.filter("node = _head").select(
        *carry, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_nodes"))).alias("rank"),
        zero.alias("intra"), zero.alias("inter"),
    )
    return (
        counted.unionByName(blank).groupBy(*carry, "rank")
        .agg(F.sum("intra").alias("intra"), F.sum("inter").alias("inter"))
    )


def rank_shares(histograms: DataFrame) -> DataFrame:
    """Histograms as distributions; an empty one is uniform."""
    keys = [c for c in histograms.columns if c not in ("rank", "intra", "inter", "size", "n_nodes")]
    w = Window.partitionBy(*keys)

    def share(c):
        total = F.sum(c).over(w)
        return F.when(total > 0, F.col(c) / F.when(total > 0, total)).otherwise(F.lit(1.0) / F.col("n_nodes"))

    return histograms.select("*", share("intra").alias("p"), share("inter").alias("q"))


def entropy_bits(p) -> F.Column:
    return F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def divergence_bits(p, m) -> F.Column:
    return F.sum(F.when((p > 0) & (m > 0), p * F.log2(p / m)).otherwise(0.0))


def cluster_quality(histograms: DataFrame) -> DataFrame:
    """Entropy, homogeneity h and completeness c per community."""
    keys = [c for c in histograms.columns if c not in ("rank", "intra", "inter", "size", "n_nodes")]
    p, q = F.col("p"), F.col("q")
    shares = rank_shares(histograms).withColumn("m", 0.5 * (p + q))
    per = shares.groupBy(*keys).agg(
        F.first("size").alias("size"), F.first("n_nodes").alias("n_nodes"),
        entropy_bits(p).alias("entropy"),
        (0.5 * divergence_bits(p, F.col("m")) + 0.5 * divergence_bits(q, F.col("m"))).alias("js"),
    )
    bits = F.greatest(F.log2(F.col("n_nodes").cast("double")), F.lit(1e-12))
    h = F.col("size") / F.col("n_nodes") * F.greatest(F.lit(0.0), 1.0 - F.col("entropy") / bits)
    return per.select(
        *keys, "size", "n_nodes", "entropy", h.alias("h"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "js")).alias("c")
    )


def partition_quality(clusters: DataFrame) -> DataFrame:
    """Mean homogeneity h, mean completeness c and harmonic mean u per partition."""
    keys = [c for c in clusters.columns if c not in ("community", "size", "n_nodes", "entropy", "h", "c")]
    means = clusters.groupBy(*keys).agg(F.avg("h").alias("h"), F.avg("c").alias("c"))
    ok = (F.col("h") > 0) & (F.col("c") > 0)
    u = F.when(ok, 2.0 / (1.0 / F.when(ok, F.col("h")) + 1.0 / F.when(ok, F.col("c")))).otherwise(0.0)
    return means.withColumn("u", u)


def choose_split(clusters: DataFrame, min_size: int) -> DataFrame:
    """Community to split next, by votes over the mixes gamma = 0, 0.1, ..., 1.

    Each gamma votes for the splittable community with the smallest c*gamma + h*(1-gamma);
    ties go to the lower number. No row for a key without a splittable community.
    """
    keys = [c for c in clusters.columns if c not in ("community", "size", "n_nodes", "entropy", "h", "c")]
    gammas = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda x: x * F.lit(0.1))
    able = clusters.filter(F.col("size") >= 2 * min_size).withColumn("gamma", F.explode(gammas))
    zeta = F.col("c") * F.col("gamma") + F.col("h") * (1.0 - F.col("gamma"))
    votes = able.groupBy(*keys, "gamma").agg(F.min_by("community", F.struct(zeta, "community")).alias("community"))
    counts = votes.groupBy(*keys, "community").agg(F.count("*").alias("votes"))
    return counts.groupBy(*keys).agg(
        F.max_by("community", F.struct(F.col("votes"), -F.col("community"))).alias("community"),
        F.max("votes").alias("votes"),
    )


def selection_score(quality: DataFrame, criterion: str = "u") -> DataFrame:
    """Add ``selection_score``: u, or u * max(q, 0) unless no partition of the key has q > 0."""
    if criterion == "u":
        return quality.withColumn("selection_score", F.col("u"))
    if criterion != "u_times_positive_q":
        raise ValueError(f"unknown selection criterion: {criterion}")
    q = F.greatest(F.coalesce(F.nanvl("q", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    any_positive = F.max(q).over(Window.partitionBy(*KEYS)) > 0
    return quality.withColumn("selection_score", F.when(any_positive, F.col("u") * q).otherwise(F.col("u")))


def best_partition(scored: DataFrame) -> DataFrame:
    """Row with the highest selection score per key; the smallest k wins ties."""
    cols = [c for c in scored.columns if c not in KEYS]
    return scored.groupBy(*KEYS).agg(
        F.max_by(F.struct(*cols), F.struct(F.col("selection_score"), -F.col("k"))).alias("b")
    ).select(*KEYS, "b.*")
