"""Exact least-squares segmentation and the intervals between change points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.shape import TensorShape
from netweave.stage import stage

INTERVAL_NAMES = ("pre", "core", "post")
# Positions per block of the segment cost computation.
BLOCK = 32
# Positions per block of the search for the best starts.
SCAN_BLOCK = 256


def prefix_sums(features: DataFrame) -> DataFrame:
    """Running sum and sum of squares per edge: row ``pos`` covers frames before ``pos``."""
    w = Window.partitionBy("cond", "i", "j").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return features.select(
        "cond", "i", "j", (F.col("t") + 1).alias("pos"),
        F.sum("z").over(w).alias("s"), F.sum(F.col("z") * F.col("z")).over(w).alias("q"),
    )


def prefix_vectors(features: DataFrame) -> DataFrame:
    """One row per position: prefix vector over the edges and total prefix square sum."""
    packed = F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "s"))), lambda x: x["s"])
    return prefix_sums(features).groupBy("cond", "pos").agg(packed.alias("s"), F.sum("q").alias("q"))


def segment_costs(vectors: DataFrame, min_size: int) -> DataFrame:
    """Squared error of every admissible segment: (cond, start, end, cost).

    Positions are grouped into blocks of BLOCK. An end block names the start blocks it needs,
    an equi-join fetches them, and each pair of blocks becomes one small array computation, so
    the work of a long recording spreads over block pairs and no vector is copied per segment.
    """
    blocks = vectors.groupBy("cond", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "s", "q"))).alias("v")
    )
    ends = blocks.select(
        "cond", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("block"), F.col("v").alias("tail")
    )

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples(index=False):
                end, es, eq = _unzip(row.tail)
                start, ss, sq = _unzip(row.v)
                if row.block == 0:
                    start, sq = np.append(0, start), np.append(0.0, sq)
                    ss = np.vstack([np.zeros(ss.shape[1]), ss])
                size = end[:, None] - start
                moved = ((es[:, None, :] - ss) ** 2).sum(axis=2)
                e, b = np.nonzero((size >= min_size) & ((start == 0) | (start >= min_size)))
                cost = eq[e] - sq[b] - moved[e, b] / size[e, b]
                yield pd.DataFrame({"cond": row.cond, "start": start[b], "end": end[e], "cost": cost}, index=range(e.size))

    return ends.join(blocks, ["cond", "block"]).mapInPandas(run, "cond string, start bigint, end bigint, cost double")


def _unzip(items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.array([x["pos"] for x in items]), np.array([x["s"] for x in items]), np.array([x["q"] for x in items]),
    )


def best_starts(vectors: DataFrame, state: DataFrame, ends: tuple[int, int], min_size: int) -> DataFrame:
    """(cond, at, total, start): for every end position the start with the least total before it plus segment cost.

    ``state`` holds the totals of the start positions. A pair of position blocks is one task's array computation that keeps
    one start for each end, so no segment's cost is ever stored.
    """

    def blocks(rows: DataFrame, *fields: str) -> DataFrame:
        return rows.groupBy("cond", F.floor(F.col("pos") / SCAN_BLOCK).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("v")
        )

    starts = blocks(vectors.join(state.select("cond", F.col("at").alias("pos"), "total"), ["cond", "pos"]), "s", "q", "total")
    tails = blocks(vectors.filter(F.col("pos").between(*ends)), "s", "q").select(
        "cond", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("block"), F.col("v").alias("tail")
    )

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            found = []
            for row in pdf.itertuples(index=False):
                (end, es, eq), (start, ss, sq) = _unzip(row.tail), _unzip(row.v)
                size = end[:, None] - start
                moved = (es**2).sum(axis=1)[:, None] + (ss**2).sum(axis=1) - 2 * es @ ss.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    total = np.array([x["total"] for x in row.v]) + eq[:, None] - sq - moved / size
                total = np.where(size >= min_size, total, np.inf)
                best = total.argmin(axis=1)
                rows = np.flatnonzero(np.isfinite(total[np.arange(len(end)), best]))
                found.append(pd.DataFrame({"cond": row.cond, "at": end[rows], "total": total[rows, best[rows]], "start": start[best[rows]]}))
            if found:
                yield pd.concat(found)

    best = tails.join(starts, ["cond", "block"]).mapInPandas(run, "cond string, at bigint, total double, start bigint")
    return best.groupBy("cond", "at").agg(F.min(F.struct("total", "start")).alias("b")).select("cond", "at", "b.total", "b.start")


def exact_segmentation(features: DataFrame, n_frames: int, n_bkps: int = 2, min_size: int = 10) -> DataFrame:
    """Boundaries minimising the total squared error: (cond, sse, boundaries).

    One round per segment; ties take the earliest start. The last round looks at the last position only.
    No row comes back when the frames cannot hold ``n_bkps + 1`` segments.
    """
    n_segments = n_bkps + 1
    min_size = max(1, min(min_size, n_frames // n_segments))
    vectors = stage(prefix_vectors(features))
    whole = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    state = vectors.filter(F.col("pos") >= min_size).select(
        "cond", F.col("pos").alias("at"), (F.col("q") - whole / F.col("pos")).alias("total"), F.array().cast("array<bigint>").alias("path")
    )
    for k in range(2, n_segments + 1):
        state = stage(state)
        ends = (n_frames, n_frames) if k == n_segments else (k * min_size, n_frames - (n_segments - k) * min_size)
        best = best_starts(vectors, state, ends, min_size)
        state = best.join(state.select("cond", F.col("at").alias("start"), "path"), ["cond", "start"]).select(
            "cond", "at", "total", F.concat("path", F.array("start")).alias("path")
        )
    return state.filter(F.col("at") == n_frames).select(
        "cond", F.col("total").alias("sse"), F.col("path").alias("boundaries")
    )


def detect_exact(edges: DataFrame, shape: TensorShape, n_bkps: int = 2, min_size: int = 10) -> DataFrame:
    from netweave.operators.tensor import subject_mean, zscore_features

    features = zscore_features(subject_mean(edges, shape), shape)
    return exact_segmentation(features, shape.n_frames, n_bkps, min_size)


def equal_thirds(n_frames: int, names=INTERVAL_NAMES) -> list[tuple[str, int, int]]:
    """Split as evenly as possible; the first pieces take the remainder."""
    base, extra = divmod(n_frames, len(names))
    out, start = [], 0
    for k, name in enumerate(names):
        end = start + base + (1 if k < extra else 0)
        out.append((name, start, end))
        start = end
    return [iv for iv in out if iv[2] > iv[1]]


def intervals_from_points(points: DataFrame, n_frames: int, names=INTERVAL_NAMES) -> DataFrame:
    """Named intervals (cond, interval, start, end) from ``points(cond, boundaries)``.

    2 usable points give three segments, 4 give the inner three, any other count falls
    back to equal thirds.
    """
    inside = F.array_sort(F.filter("boundaries", lambda b: (b > 0) & (b < n_frames)))

    def rows(items):
        return F.array(*[
            F.struct(
                F.lit(n).alias("interval"),
                (s if isinstance(s, F.Column) else F.lit(s)).cast("bigint").alias("start"),
                (e if isinstance(e, F.Column) else F.lit(e)).cast("bigint").alias("end"),
            ) for n, s, e in items
        ])

    def b(k):
        return F.get(F.col("_b"), k)

    two = rows([(names[0], 0, b(0)), (names[1], b(0), b(1)), (names[2], b(1), n_frames)])
    four = rows([(names[k], b(k), b(k + 1)) for k in range(3)])
    chosen = (
        F.when(F.size("_b") == 2, two).when(F.size("_b") == 4, four).otherwise(rows(equal_thirds(n_frames, names)))
    )
    return (
        points.select("cond", inside.alias("_b")).select("cond", F.inline(chosen)).filter("end > start")
    )


def analysis_change_points(points: DataFrame, n_frames: int, lo_ms: float, hi_ms: float, start_ms: float, rate_hz: float) -> DataFrame:
    """First and last 1-based change point strictly inside the analysis window.

    ``points(cond, point)``; conditions with fewer than two such points give no row.
    """
    frames = points.select("cond", F.rint("point").cast("bigint").alias("p")).distinct()
    first = max(math.ceil((lo_ms - start_ms) * rate_hz / 1000.0) + 1, 1)
    last = min(math.floor((hi_ms - start_ms) * rate_hz / 1000.0) + 1, n_frames)
    return (
        frames.filter((F.col("p") > first) & (F.col("p") < last))
        .groupBy("cond").agg(F.min("p").alias("first_cp"), F.max("p").alias("last_cp"))
        .filter("last_cp > first_cp")
    )


def two_point_intervals(points: DataFrame, n_frames: int, lo_ms: float, hi_ms: float, pre_ms: float, start_ms: float, rate_hz: float, names=INTERVAL_NAMES) -> DataFrame:
    """1-based inclusive intervals around ``points(cond, first_cp, last_cp)``: from ``pre_ms`` to
    the first point, up to the last point, and on to the end of the analysis window.

    Points outside the analysis window fail.
    """
    def frame_at(ms, rounding):
        return min(max(int(rounding((ms - start_ms) * rate_hz / 1000.0)) + 1, 1), n_frames)

    first, last, pre = frame_at(lo_ms, math.ceil), frame_at(hi_ms, math.floor), frame_at(pre_ms, math.ceil)
    c1, c2 = F.col("first_cp"), F.col("last_cp")
    bad = (c1 < max(first, pre)) | (c2 <= c1) | (c2 >= last)
    c1 = F.when(bad, F.raise_error(F.lit("change points must be increasing and inside the analysis window"))).otherwise(c1)
    parts = F.array(
        F.struct(F.lit(names[0]).alias("interval"), F.lit(pre).cast("bigint").alias("first_frame"), c1.cast("bigint").alias("last_frame")),
        F.struct(F.lit(names[1]).alias("interval"), (c1 + 1).cast("bigint").alias("first_frame"), c2.alias("last_frame")),
        F.struct(F.lit(names[2]).alias("interval"), (c2 + 1).alias("first_frame"), F.lit(last).cast("bigint").alias("last_frame")),
    )
    return points.select("cond", F.inline(parts))


def boundary_intervals(boundaries: DataFrame, clock, names=INTERVAL_NAMES) -> DataFrame:
    """1-based inclusive intervals between four boundaries, with their clock readings.

    ``boundaries(cond, b)`` holds an array of four frame numbers; ``clock`` maps a 0-based
    frame column to ms.
    """
    parts = F.array(*[
        F.struct(
            F.lit(names[k]).alias("interval"),
            (F.get("b", F.lit(k)) + (1 if k else 0)).alias("first_frame"),
            F.get("b", F.lit(k + 1)).alias("last_frame"),
        ) for k in range(3)
    ])
    return boundaries.select("cond", F.inline(parts)).select(
        "*", clock(F.col("first_frame") - 1).alias("start_ms"), clock(F.col("last_frame") - 1).alias("end_ms")
    )
