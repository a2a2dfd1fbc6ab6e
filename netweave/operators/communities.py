"""Spectral and modularity communities of many small graphs, and consensus over them.

A packed graph is one row ``(*keys, pos, w)`` (see `frames.pair_index`); splits run as one
small eigen-decomposition per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.linalg import square
from netweave.operators import quality as ql
from netweave.operators.frames import pair_index
from netweave.operators.spectral import by_size, gap_parts, split_trees
from netweave.operators.graphs import agreement_counts, modularity, relabel, share_counts
from netweave.operators.tensor import group_mean
from netweave.shape import MAX_MODE_SIZE, TensorShape
from netweave.stage import stage

KEYS = ["cond", "interval"]
#: cells of the adjacency matrices that a task decomposes at once
BLOCK_CELLS = 1 << 22


def pack_graphs(graphs: DataFrame, keys: list[str], n_nodes: int) -> DataFrame:
    if n_nodes > MAX_MODE_SIZE:
        raise ValueError("graph too large for a per-row decomposition")
    cells = graphs.filter("w <> 0").select(*keys, pair_index(n_nodes).alias("pos"), "w")
    return cells.groupBy(*keys).agg(F.collect_list("pos").alias("pos"), F.collect_list("w").alias("w"))


def _adjacency(pos, w, n: int) -> np.ndarray:
    flat = np.zeros(n * (n - 1) // 2)
    flat[np.asarray(pos, dtype=int)] = np.nan_to_num(np.asarray(w, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
    return square(np.maximum(flat, 0.0), n)


# ---- communities of a stack of adjacency matrices ----------------------------------------


def graph_modularity(a: np.ndarray, labels: np.ndarray) -> float:
    total = a.sum()
    if total <= 0:
        return float("nan")
    member = (labels[:, None] == np.unique(labels)[None, :]).astype(float)
    inside = np.einsum("ik,ij,jk->k", member, a, member)
    return float((inside / total - (a.sum(axis=1) @ member / total) ** 2).sum())


def _first_seen(labels: np.ndarray) -> np.ndarray:
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def greedy_moves(a: np.ndarray) -> np.ndarray:
    """Louvain communities with a fixed visiting order (0, 1, ...): local moves by modularity
    gain, then the same on the graph of communities, until nothing moves."""
    total = a.sum()
    member = np.arange(a.shape[0])
    level = a.copy()
    while True:
        n = level.shape[0]
        degree = level.sum(axis=1)
        own = np.arange(n)
        load = degree.copy()
        moved = True
        improved = False
        while moved:
            moved = False
            for v in range(n):
                load[own[v]] -= degree[v]
                links = np.bincount(own, weights=level[v], minlength=n)
                links[own[v]] -= level[v, v]
                gain = links - load * degree[v] / total
                best = int(np.argmax(gain))
                if gain[best] > gain[own[v]] + 1e-12:
                    own[v], moved, improved = best, True, True
                load[own[v]] += degree[v]
        if not improved:
            return _first_seen(member)
        own = _first_seen(own)
        member = own[member]
        fold = np.eye(own.max() + 1)[own]
        level = fold.T @ level @ fold


# Tolerated modularity loss and smallest part per profile (fixed values of the method).
PROFILES = {"detailed": (0.08, 3), "compact": (0.0, 6), "balanced": (0.06, 3)}


def recursive_parts(stack: np.ndarray, min_size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Labels and modularity of every graph's recursive sign splits."""
    labels = np.array([_first_seen(row) for row in split_trees(stack, min_size)]).reshape(stack.shape[:2])
    return labels, np.array([graph_modularity(a, row) for a, row in zip(stack, labels)])


def arbitrated(stack: np.ndarray, profiles: list[str]) -> tuple[np.ndarray, list[float], list[str]]:
    """Better of recursive splits and greedy moves for every graph; the finer recursive partition also wins
    when it loses at most its profile's tolerance."""
    labels = np.zeros(stack.shape[:2], dtype=int)
    scores, names = [float("nan")] * len(stack), ["empty graph"] * len(stack)
    busy = np.zeros(len(stack), dtype=bool) if stack.shape[1] < 2 else ~np.isclose(stack, 0).all(axis=(1, 2))
    for profile, (tolerance, smallest) in PROFILES.items():
        rows = np.flatnonzero(busy & (np.array(profiles, dtype=object) == profile))
        for k, split, split_q in zip(rows, *recursive_parts(stack[rows], smallest)):
            moves = greedy_moves(stack[k])
            moves_q = graph_modularity(stack[k], moves)
            if split_q >= moves_q or (split.max() > moves.max() and split_q >= moves_q - tolerance):
                labels[k], scores[k], names[k] = split, split_q, "recursive spectral"
            else:
                labels[k], scores[k], names[k] = moves, moves_q, "greedy modularity"
    return labels, scores, names


# ---- many graphs -------------------------------------------------------------------------


def map_graphs(packed: DataFrame, keys: list[str], n_nodes: int, method) -> DataFrame:
    """Label every packed graph: ``method(stack, rows) -> (labels, scores, names)`` on blocks of graphs.

    Result: (*keys, nodes, comms, score, method), one row per graph, no shuffle.
    """
    types = dict(packed.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", nodes array<bigint>, comms array<bigint>, score double, method string"
    block = max(1, BLOCK_CELLS // n_nodes**2)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for lo in range(0, len(pdf), block):
                rows = pdf.iloc[lo:lo + block]
                stack = np.stack([_adjacency(pos, w, n_nodes) for pos, w in zip(rows.pos, rows.w)])
                labels, scores, names = method(stack, rows)
                yield rows[keys].assign(nodes=[np.arange(n_nodes)] * len(rows), comms=list(labels), score=scores, method=names)

    return packed.mapInPandas(run, schema)


def frame_communities(edges: DataFrame, shape: TensorShape, profile: str = "balanced") -> DataFrame:
    """Communities of every subject's graph at every frame: one packed row per graph."""
    keys = ["cond", "subj", "t"]
    graphs = edges.withColumn("w", F.greatest("w", F.lit(0.0)))
    return map_graphs(pack_graphs(graphs, keys, shape.n_nodes), keys, shape.n_nodes, lambda stack, _: arbitrated(stack, [profile] * len(stack)))


def label_rows(labelled: DataFrame, keys: list[str], base: int = 0) -> DataFrame:
    zipped = F.arrays_zip("nodes", "comms")
    return labelled.select(*keys, F.explode(zipped).alias("x")).select(
        *keys, F.col("x.nodes").alias("node"), (F.col("x.comms") + base).alias("community")
    )


def interval_agreement(labelled: DataFrame, intervals: DataFrame, shape: TensorShape) -> DataFrame:
    """Share of (subject, frame) graphs of an interval in which two nodes agree.

    Graphs that were not stored (no edges) put all nodes together and are counted as such.
    """
    frames = intervals.select(
        "cond", "interval", (F.col("end") - F.col("start")).alias("n_frames"),
        F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"),
    )
    sliced = labelled.join(frames, ["cond", "t"]).select(*KEYS, "nodes", "comms")
    counts = stage(agreement_counts(sliced, KEYS, shape.n_nodes))
    n = intervals.select(*KEYS, ((F.col("end") - F.col("start")) * shape.n_subjects).alias("total"))
    stored = counts.filter("i = 0 and j = 0").select(*KEYS, F.col("n").alias("stored"))
    share = (F.col("n") + F.col("total") - F.col("stored")) / F.col("total")
    spine = intervals.select(*KEYS).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shape.n_nodes - 2).cast("bigint")))
    ).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(shape.n_nodes - 1).cast("bigint"))))
    full = spine.join(n, KEYS).join(stored, KEYS, "left").join(counts, [*KEYS, "i", "j"], "left").na.fill(0, ["n", "stored"])
    return full.select(*KEYS, "i", "j", share.alias("w"))


def interval_profile(interval: str) -> str:
    """Granularity by interval: the core one detailed, its neighbours compact."""
    return {"core": "detailed", "pre": "compact", "post": "compact"}.get(interval, "balanced")


def consensus_communities(agreement: DataFrame, shape: TensorShape) -> DataFrame:
    """Communities of each interval's agreement matrix, granularity by interval name."""
    packed = pack_graphs(agreement, KEYS, shape.n_nodes)
    return map_graphs(packed, KEYS, shape.n_nodes, lambda stack, rows: arbitrated(stack, [interval_profile(x) for x in rows.interval]))


# ---- consensus splitting with model selection --------------------------------------------


def _subset_agreement(packed: DataFrame, chosen: DataFrame, n_nodes: int, on_disconnected: str) -> DataFrame:
    """Split the chosen community in every subject's graph and count agreeing pairs; the
    (i, i) rows name the community's nodes and carry the number of graphs."""
    schema = "cond string, interval string, nodes array<bigint>, comms array<bigint>"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            members = [np.sort(np.asarray(m, dtype=int)) for m in pdf.members]
            parts: list = [None] * len(pdf)
            for n, at in by_size(members):
                for lo in range(0, len(at), max(1, BLOCK_CELLS // n_nodes**2)):
                    some = at[lo:lo + max(1, BLOCK_CELLS // n_nodes**2)]
                    stack = np.stack([_adjacency(pdf.pos.iloc[k], pdf.w.iloc[k], n_nodes)[np.ix_(members[k], members[k])] for k in some])
                    for k, part in zip(some, gap_parts(stack, on_disconnected)):
                        parts[k] = part
            yield pdf[["cond", "interval"]].assign(nodes=members, comms=parts)

    split = packed.join(chosen, KEYS).mapInPandas(run, schema)
    return agreement_counts(split, KEYS, n_nodes)


def _consensus_parts(counts: DataFrame, min_size: int, on_disconnected: str) -> DataFrame:
    """Split each key's agreement matrix: (cond, interval, node, part), valid splits only."""
    cells = counts.groupBy(*KEYS).agg(
        F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("n").alias("n")
    )

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                i, j, n = (np.asarray(x, dtype=int) for x in (row.i, row.j, row.n))
                nodes = np.sort(i[i == j])
                a = np.zeros((nodes.size, nodes.size))
                r, c = np.searchsorted(nodes, i), np.searchsorted(nodes, j)
                a[r, c] = a[c, r] = n / n[i == j].max()
                np.fill_diagonal(a, 0.0)
                part = gap_parts(a[None], on_disconnected)[0]
                if min((part == 1).sum(), (part == 2).sum()) >= max(min_size, 1):
                    yield pd.DataFrame({"cond": row.cond, "interval": row.interval, "node": nodes, "part": part})

    return cells.mapInPandas(run, "cond string, interval string, node bigint, part int")


def requested_levels(requested, k_range: tuple[int, int], names: tuple[str, ...]) -> dict[str, list[int]]:
    """Community counts to consider per interval: the whole range, one count for all
    intervals, or one count for each."""
    if requested is None or (not np.isscalar(requested) and len(requested) == 0):
        return {name: list(range(k_range[0], k_range[1] + 1)) for name in names}
    counts = [requested] if np.isscalar(requested) else list(requested)
    if len(counts) not in (1, len(names)):
        raise ValueError(f"request no count, one count, or {len(names)} counts")
    counts = [round(float(k)) for k in counts]
    if min(counts) < 2:
        raise ValueError("a requested count must be at least 2")
    return {name: [counts[n] if len(counts) > 1 else counts[0]] for n, name in enumerate(names)}


def select_communities(
    graphs: DataFrame,
    shape: TensorShape,
    k_max: int = 5,
    k_min: int = 2,
    min_size: int = 2,
    criterion: str = "u",
    on_disconnected: str = "components",
    levels: dict[str, list[int]] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split the worst community by consensus until ``k_max``, then keep the best k.

    ``graphs(cond, interval, subj, i, j, w)``. All keys advance together, one round per k:
    score the current partition, choose a community by vote, split it in every subject's
    graph, and split the agreement of those. A key whose split is too small stops there.
    Returns (labels of the best k, quality table, agreement behind the best k's last split);
    a key without any valid k has no rows. ``levels`` narrows the counts considered per
    interval (see `requested_levels`).
    """
    n = shape.n_nodes
    graphs = stage(graphs)
    keys = stage(graphs.select(*KEYS).distinct())
    packed = stage(complete_subjects(pack_graphs(graphs, [*KEYS, "subj"], n), keys, shape))
    pooled = stage(ql.pooled_ranks(ql.rank_bins(graphs, n, shape.subjects, keys)))
    current = keys.select(
        *KEYS, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("node"),
        F.lit(1).cast("bigint").alias("community"),
    )
    partitions, agreements = [], []
    if levels:
        k_max = max(max(ks) for ks in levels.values())
    for k in range(2, k_max + 1):
        if k == 2:
            pick = current.groupBy(*KEYS).agg(F.min("community").alias("community"), F.count("*").alias("_n"))
            pick = pick.filter(F.col("_n") >= 2 * min_size).drop("_n")
        else:
            pick = ql.choose_split(ql.cluster_quality(ql.rank_histograms(pooled, current)), min_size).drop("votes")
        chosen = current.join(pick, [*KEYS, "community"]).groupBy(*KEYS).agg(F.collect_list("node").alias("members"))
        counts = stage(_subset_agreement(packed, chosen, n, on_disconnected))
        parts = _consensus_parts(counts, min_size, on_disconnected)
        fresh = current.join(parts, [*KEYS, "node"], "left")
        fresh = fresh.withColumn("went_on", F.max("part").over(Window.partitionBy(*KEYS))).filter("went_on is not null")
        fresh = fresh.select(
            *KEYS, "node", "part", (F.col("community") * 4 + F.coalesce("part", F.lit(0))).alias("community")
        )
        current = stage(relabel(fresh.drop("part"), KEYS))
        if current.isEmpty():
            break
        partitions.append(current.withColumn("k", F.lit(k)))
        agreements.append(share_counts(counts, KEYS).withColumn("k", F.lit(k)))
    if not partitions:
        partitions, agreements = [current.withColumn("k", F.lit(k_max))], [share_counts(counts, KEYS).withColumn("k", F.lit(k_max))]
    labels = partitions[0]
    cooc = agreements[0]
    for more, cells in zip(partitions[1:], agreements[1:]):
        labels, cooc = labels.unionByName(more), cooc.unionByName(cells)
    labels = labels.filter(F.col("k") >= k_min)
    for name, ks in (levels or {}).items():
        labels = labels.filter((F.col("interval") != name) | F.col("k").isin(ks))
    scored = ql.partition_quality(ql.cluster_quality(ql.rank_histograms(pooled, labels)))
    q = modularity(group_mean(graphs, shape), labels, KEYS)
    table = stage(ql.selection_score(scored.join(q, [*KEYS, "k"]), criterion).select(*KEYS, "k", "selection_score", "u", "h", "c", "q"))
    best = ql.best_partition(table).select(*KEYS, "k")
    return labels.join(best, [*KEYS, "k"]), table, cooc.join(best, [*KEYS, "k"])


def complete_subjects(packed: DataFrame, keys: DataFrame, shape: TensorShape) -> DataFrame:
    """Give subjects without any edge an empty graph, which counts in the consensus."""
    spine = keys.withColumn("subj", F.explode(F.array(*[F.lit(s) for s in shape.subjects])))
    return spine.join(packed, [*KEYS, "subj"], "left").select(
        *KEYS, "subj",
        F.coalesce("pos", F.array().cast("array<bigint>")).alias("pos"),
        F.coalesce("w", F.array().cast("array<double>")).alias("w"),
    )
