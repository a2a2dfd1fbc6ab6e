"""Frame signals that rise at regime changes, and change points read off such signals.

A signal is ``(cond, t, v)``: one number per frame.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.linalg import gram_spectrum
from netweave.functions.scalar import edge_fade
from netweave.operators import long_signals as ls
from netweave.operators.frames import node_gram, pack_frames, unpack
from netweave.operators.tensor import mirrored, subject_mean
from netweave.shape import TensorShape, frame_spine, literal_array
from netweave.stage import stage

SIGNAL = "cond string, t bigint, v double"


def rank1_shift(edges: DataFrame, shape: TensorShape, window: int) -> DataFrame:
    """1 - |cosine| between the node-strength signatures of successive trailing windows.

    Frames up to and including ``window`` have no predecessor and score 0.
    """
    strength = mirrored(edges).groupBy("cond", F.col("i").alias("node"), "t").agg(F.sum("w").alias("w"))
    spine = (
        edges.sparkSession.range(0, shape.n_nodes).withColumnRenamed("id", "node")
        .withColumn("cond", F.explode(literal_array(shape.conds)))
        .withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shape.n_frames - 1).cast("bigint"))))
    )
    per_node = Window.partitionBy("cond", "node").orderBy("t")
    sums = spine.join(strength, ["cond", "node", "t"], "left").select(
        "cond", "node", "t", F.sum(F.coalesce("w", F.lit(0.0))).over(per_node.rowsBetween(-window, -1)).alias("u")
    )
    pairs = sums.withColumn("p", F.lag("u").over(per_node))
    sums = pairs.groupBy("cond", "t").agg(
        F.sum(F.col("u") * F.col("p")).alias("up"), F.sum(F.col("u") * F.col("u")).alias("uu"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    cosine = F.abs(F.col("up")) / ((F.sqrt("uu") + 1e-8) * (F.sqrt("pp") + 1e-8))
    return sums.select("cond", "t", F.when(F.col("t") > window, 1.0 - cosine).otherwise(0.0).alias("v"))


def grassmann_shift(frames: DataFrame, shape: TensorShape, window: int, rank: int = 5) -> DataFrame:
    """Distance of the leading node subspaces of trailing windows half a window apart.

    Chunks of the time axis carry the frames of the windows before them; a window's Gram matrix is a difference of
    running sums within its chunk, and a distance needs the chunk's own subspaces only. Matrices never leave a task.
    """
    shape.require_modes_fit()
    step = max(window // 2, 1)
    reach = window + step

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t0, halo = int(pdf["t"].iloc[0]), pdf["halo"].to_numpy()
        sums = [np.zeros((shape.n_nodes, shape.n_nodes))]
        for row in pdf.itertuples(index=False):
            sums.append(sums[-1] + node_gram(unpack(row.pos, row.w, shape)))
        known: dict[int, np.ndarray] = {}

        def space(t: int) -> np.ndarray:
            if t not in known:
                known[t] = gram_spectrum(sums[t - t0] - sums[t - t0 - window])[0][:, :rank]
            return known[t]

        rows = []
        for k, t in enumerate(pdf["t"]):
            if halo[k] or t < reach or (t - window) % step:
                continue
            overlap = np.linalg.norm(space(t).T @ space(t - step)) ** 2
            rows.append((pdf["cond"].iloc[0], t - step // 2, 1.0 - overlap / rank))
        return pd.DataFrame(rows, columns=["cond", "t", "v"])

    chunked = sliding_chunks(frames, reach, max(4 * window, 64))
    return fill_signal(chunked.groupBy("cond", "chunk").applyInPandas(run, SIGNAL), shape)


def fill_signal(signal: DataFrame, shape: TensorShape) -> DataFrame:
    """All frames, 0 where the signal has no value."""
    return frame_spine(signal.sparkSession, shape).join(signal, ["cond", "t"], "left").select(
        "cond", "t", F.coalesce("v", F.lit(0.0)).alias("v")
    )


def window_centres(frames: DataFrame, shape: TensorShape, window: int, rank: int = 5) -> DataFrame:
    """Low-rank and residual parts of the frames at the window centres, projected onto the
    window's node subspace from one side. Long rows with i, j over the full square."""
    n, step = shape.n_nodes, max(window // 2, 1)
    chunked = sliding_chunks(frames, window, max(window * 4, 64))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_t = {row.t: row for row in pdf.itertuples(index=False)}
        for t in sorted(by_t):
            if by_t[t].halo or t < window or (t - window) % step:
                continue
            grams = sum(node_gram(unpack(by_t[u].pos, by_t[u].w, shape)) for u in range(t - window, t))
            u, _ = gram_spectrum(grams)
            u = u[:, :rank]
            centre = by_t[t - step // 2]
            graph = unpack(centre.pos, centre.w, shape)
            low = (u @ u.T) @ graph
            s, i, j = (x.ravel() for x in np.indices(low.shape))
            out.append(pd.DataFrame({
                "cond": centre.cond, "subj": np.asarray(shape.subjects, dtype=object)[s], "i": i, "j": j, "t": centre.t,
                "low_rank": low.ravel(), "residual": (graph - low).ravel(),
            }))
        cols = ["cond", "subj", "i", "j", "t", "low_rank", "residual"]
        return pd.concat(out) if out else pd.DataFrame(columns=cols)

    return chunked.groupBy("cond", "chunk").applyInPandas(
        run, "cond string, subj string, i bigint, j bigint, t bigint, low_rank double, residual double"
    )


def sliding_chunks(frames: DataFrame, reach: int, size: int) -> DataFrame:
    """Cut the time axis into chunks that also carry the ``reach`` frames before them.

    Each frame is copied at most 1 + ceil(reach / size) times and every chunk has at most
    ``size + reach`` frames, so trailing-window kernels run in parallel along time.
    """
    own = F.floor(F.col("t") / size)
    last = F.floor((F.col("t") + reach) / size)
    return frames.withColumn("chunk", F.explode(F.sequence(own, last))).withColumn("halo", F.col("chunk") > own)


def dmd_shift(edges: DataFrame, shape: TensorShape, window: int, rank: int = 5) -> DataFrame:
    """Change of the sorted eigenvalue moduli of the linear dynamics fitted to each trailing
    window of the subject-mean network (dynamic mode decomposition).

    Subjects are averaged before frames are packed, so one small frame of each time is shuffled with its halos.
    Edges are weighted by sqrt(2), which keeps all inner products of the full square.
    Directions with vanishing singular value are left out of the fit (their modulus is 0).
    """
    n_p = shape.n_pairs
    alone = replace(shape, subjects=("mean",))
    frames = pack_frames(subject_mean(edges, shape).withColumn("subj", F.lit("mean")), alone)

    def moduli(block: np.ndarray) -> np.ndarray:
        first, second = block[:, :-1], block[:, 1:]
        u, s, vt = np.linalg.svd(first, full_matrices=False)
        r = min(rank, first.shape[1])
        solid = int((s[:r] > 1e-12 * max(s[0], 1e-300)).sum())
        out = np.zeros(r)
        if solid:
            fit = u[:, :solid].T @ second @ vt[:solid].T / s[:solid]
            out[:solid] = np.abs(np.linalg.eigvals(fit))
        return np.sort(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t0 = int(pdf["t"].iloc[0])
        series = np.zeros((n_p, len(pdf)))
        for k, row in enumerate(pdf.itertuples(index=False)):
            np.add.at(series[:, k], np.asarray(row.pos, dtype=int), np.asarray(row.w))
        series *= np.sqrt(2.0)
        rows, previous = [], None
        for k, row in enumerate(pdf.itertuples(index=False)):
            if k < window or (row.halo and not (k + 1 < len(pdf) and not pdf["halo"].iloc[k + 1])):
                previous = None
                continue
            current = moduli(series[:, k - window:k])
            if previous is not None and not row.halo:
                rows.append((row.cond, t0 + k, float(np.linalg.norm(current - previous))))
            previous = current
        return pd.DataFrame(rows, columns=["cond", "t", "v"])

    chunked = sliding_chunks(frames, window + 1, max(4 * window, 64))
    return fill_signal(chunked.groupBy("cond", "chunk").applyInPandas(run, SIGNAL), shape)


def box_smooth(signal: DataFrame, width: int) -> DataFrame:
    """Zero-padded moving average of the same length as the signal."""
    w = Window.partitionBy("cond").orderBy("t").rowsBetween(-(width // 2), (width - 1) // 2)
    return signal.withColumn("v", F.sum("v").over(w) / F.lit(float(width)))


def faded(signal: DataFrame, n_frames: int, share: float = 0.1) -> DataFrame:
    return signal.withColumn("v", F.col("v") * edge_fade(F.col("t"), n_frames, share))


# ---- segmentation of scalar signals ------------------------------------------------------


def _kernel_costs(x: np.ndarray, gamma: float):
    """Yield, per end e, the within-segment scatter of every segment [s, e) in feature space."""
    n = x.size
    inner = np.zeros(n)  # sum of the kernel over [s, e) x [s, e)
    for e in range(1, n + 1):
        gap = np.clip(gamma * (x[:e] - x[e - 1]) ** 2, 1e-2, 1e2)
        k = np.exp(-gap)
        k[e - 1] = 1.0
        tail = np.cumsum(k[::-1])[::-1]
        inner[:e] += 2.0 * tail - 1.0
        size = e - np.arange(e)
        yield e, size - inner[:e] / size


def median_gamma(x: np.ndarray) -> float:
    r, c = np.triu_indices(x.size, 1)
    centre = float(np.median((x[r] - x[c]) ** 2)) if x.size > 1 else 0.0
    return 1.0 / centre if centre else 1.0


def kernel_boundaries(x: np.ndarray, n_bkps: int, min_size: int, gamma: float | None = None) -> list[int]:
    """Exact segmentation under the Gaussian-kernel scatter; [] when it cannot fit."""
    n, segments = x.size, n_bkps + 1
    if n < segments * max(min_size, 1):
        return []
    best = np.full((segments + 1, n + 1), np.inf)
    best[0, 0] = 0.0
    back = np.zeros((segments + 1, n + 1), dtype=int)
    for e, cost in _kernel_costs(x, median_gamma(x) if gamma is None else gamma):
        stop = e - max(min_size, 1) + 1
        if stop < 1:
            continue
        total = best[:segments, :stop] + cost[:stop]
        back[1:, e] = total.argmin(axis=1)
        best[1:, e] = total.min(axis=1)
    path, e = [], n
    for k in range(segments, 1, -1):
        e = int(back[k, e])
        path.append(e)
    return path[::-1]


def penalised_boundaries(x: np.ndarray, penalty: float, min_size: int, jump: int = 5) -> list[int]:
    """Least-squares segmentation with a cost per segment, boundaries on multiples of
    ``jump``: exact by dynamic programming over the admissible positions."""
    n = x.size
    min_size = max(min_size, 1)
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    ends = np.array([e for e in range(jump, n, jump) if e >= min_size] + [n])
    starts = np.concatenate([[0], ends[:-1]])
    total = np.full(starts.size + 1, np.inf)
    total[0] = 0.0
    back = np.zeros(starts.size + 1, dtype=int)
    for k, e in enumerate(ends, start=1):
        ok = np.flatnonzero(e - starts[:k] >= min_size)
        if not ok.size:
            continue
        b = starts[ok]
        cost = total[ok] + (q[e] - q[b]) - (s[e] - s[b]) ** 2 / (e - b) + penalty
        total[k], back[k] = cost.min(), ok[int(cost.argmin())]
    path, k = [], starts.size
    while k > 0 and back[k] > 0:
        k = back[k]
        path.append(int(starts[k]))
    return path[::-1]


def _segmented(signal: DataFrame, extra: list[str], find, schema: str) -> DataFrame:
    """Run a segmentation per condition (and setting) on its sequence, which fits one block of positions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        key = {c: pdf[c].iloc[0] for c in ["cond", *extra]}
        points = find(pdf["v"].to_numpy(dtype=float), key)
        return pd.DataFrame([{**key, "boundaries": np.asarray(points, dtype="int64")}])

    return signal.groupBy("cond", *extra).applyInPandas(run, schema)


def kernel_points(signal: DataFrame, extra: dict[str, str], n_frames: int, n_bkps: int, size: int, gamma: float | None = None, block: int = ls.BLOCK) -> DataFrame:
    """(cond, *extra, boundaries): sequences of one block are segmented by one task each, longer ones over pairs of blocks."""
    if n_frames > block:
        return ls.kernel_segmentation(signal, ["cond", *extra], n_frames, n_bkps, size, gamma, block)
    kinds = "".join(f", {k} {t}" for k, t in extra.items())
    return _segmented(signal, list(extra), lambda x, _: kernel_boundaries(x, n_bkps, size, gamma), f"cond string{kinds}, boundaries array<bigint>")


def kernel_change_points(
    signal: DataFrame, n_frames: int, n_bkps: int = 4, min_share: float = 0.12, gamma: float | None = None, block: int = ls.BLOCK,
) -> DataFrame:
    """Faded signal, Gaussian-kernel segmentation with a minimum state duration."""
    return kernel_points(faded(signal, n_frames), {}, n_frames, n_bkps, int(n_frames * min_share), gamma, block)


def penalty_sweep(
    signal: DataFrame, n_frames: int, penalties: list[float], min_share: float = 0.08, jump: int = 5, block: int = ls.BLOCK,
) -> DataFrame:
    """Boundaries per penalty: (cond, penalty, ord, boundaries); settings run in parallel, sequences beyond a block over blocks of positions."""
    size = int(n_frames * min_share)
    grid = F.posexplode(literal_array([float(p) for p in penalties])).alias("ord", "penalty")
    every = signal.select("*", grid)
    if n_frames > block:
        return ls.penalised_segmentation(every, ["cond", "ord", "penalty"], n_frames, "penalty", size, jump, block)
    return _segmented(
        every, ["ord", "penalty"],
        lambda x, key: penalised_boundaries(x, key["penalty"], size, jump),
        "cond string, ord int, penalty double, boundaries array<bigint>",
    )


def choose_penalty(sweep: DataFrame) -> DataFrame:
    """First penalty giving 3 or 4 change points, else the last one."""
    good = F.size("boundaries").isin(3, 4)
    rank = F.when(good, F.col("ord")).otherwise(F.lit(1 << 20) - F.col("ord"))
    picked = F.min_by(F.struct("penalty", "boundaries"), rank)
    return sweep.groupBy("cond").agg(picked.alias("p")).select("cond", "p.penalty", "p.boundaries")


def boundary_times(points: DataFrame, clock) -> DataFrame:
    """(cond, ord, frame, ms); the time is the clock of the last frame before the boundary."""
    keys = [c for c in points.columns if c != "boundaries"]
    return points.select(*keys, F.posexplode("boundaries").alias("ord", "frame")).withColumn("ms", clock(F.col("frame") - 1))


def spread_score(times: DataFrame, *keys: str) -> DataFrame:
    """Smallest gap between consecutive change points per key; 0 with fewer than two."""
    w = Window.partitionBy(*keys).orderBy("ms")
    gaps = times.withColumn("gap", F.col("ms") - F.lag("ms").over(w))
    return gaps.groupBy(*keys).agg(F.coalesce(F.min("gap"), F.lit(0.0)).alias("score"))


def best_setting(scored: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Setting with the largest score per condition; the first one wins ties."""
    cols = [c for c in scored.columns if c != "cond"]
    picked = F.max_by(F.struct(*cols), F.struct(F.col("score"), -F.col(ordinal)))
    return scored.groupBy("cond").agg(picked.alias("p")).select("cond", "p.*")


def sweep_signals(signals: list[DataFrame], n_frames: int, clock: Column, n_bkps: int = 4) -> DataFrame:
    """Kernel change points of several settings' signals and the setting that spreads them
    most: (cond, ord, boundaries, score)."""
    tagged = [s.withColumn("ord", F.lit(k)) for k, s in enumerate(signals)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    size = int(n_frames * 0.12)
    found = stage(kernel_points(faded(union, n_frames), {"ord": "int"}, n_frames, n_bkps, size))
    times = found.select("cond", F.col("ord").alias("setting"), "boundaries")
    times = boundary_times(times, clock)
    scores = spread_score(times, "cond", "setting").withColumnRenamed("setting", "ord")
    return best_setting(found.join(scores, ["cond", "ord"], "left").na.fill({"score": 0.0}))
