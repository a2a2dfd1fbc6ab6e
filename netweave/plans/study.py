"""End-to-end studies: denoise, find regime changes, cut intervals, find communities."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators import communities as cm
from netweave.operators import detectors as dt
from netweave.operators import frames as fr
from netweave.operators import lowrank as lr
from netweave.operators import quality as ql
from netweave.operators import segmentation as seg
from netweave.operators import tensor as tn
from netweave.operators import tracker as tr
from netweave.shape import TensorShape
from netweave.stage import stage

KEYS = ["cond", "interval"]


@dataclass(frozen=True)
class StudyConfig:
    """Settings of a study; the defaults suit 2049 frames at 1024 Hz."""

    ranks: tuple[int | None, int | None] = (10, 10)
    n_bkps: int = 2
    min_interval: int = 10
    k_range: tuple[int, int] = (2, 5)
    min_community: int = 2
    criterion: str = "u"
    on_disconnected: str = "components"
    tracker: tr.TrackerConfig = tr.TrackerConfig()
    windows: tuple[int, ...] = (40, 80, 160)
    subspace_rank: int = 5
    shift_window: int = 80
    alphas: tuple[int, ...] = (32, 64, 128)
    sigmas: tuple[float, ...] = (0.05, 0.11, 0.20)
    penalties: tuple[float, ...] = (5.0, 10.0, 20.0, 50.0, 100.0)


@dataclass
class Study:
    """Result tables, all lazy over staged intermediates."""

    low_rank: DataFrame
    change_points: DataFrame
    intervals: DataFrame
    labels: DataFrame
    quality: DataFrame
    agreement: DataFrame
    mean_adjacency: DataFrame


def run_study(edges: DataFrame, shape: TensorShape, denoiser: str = "hosvd", cfg: StudyConfig = StudyConfig()) -> Study:
    """Denoise with ``tracker``, ``hosvd`` or ``raw``, then segment and cluster each interval.

    The tracker brings its own change points; the others use exact segmentation.
    """
    edges = stage(edges)
    if denoiser == "raw":
        low, points = edges, None
    elif denoiser == "hosvd":
        low, points = stage(lr.hosvd_low_rank(fr.stage_frames(edges, shape), shape, cfg.ranks)), None
    elif denoiser == "tracker":
        run = tr.track(fr.stage_frames(edges, shape), shape, cfg.tracker)
        low = stage(run.separated().select("cond", "subj", "i", "j", "t", F.col("low_rank").alias("w")))
        points = run.change_points().groupBy("cond").agg(F.sort_array(F.collect_list("reported_time")).alias("boundaries"))
    else:
        raise ValueError(f"unknown denoiser: {denoiser}")
    if points is None:
        points = seg.detect_exact(low, shape, cfg.n_bkps, cfg.min_interval).select("cond", "boundaries")
    points = stage(points)
    every = edges.select("cond").distinct().join(points, "cond", "left").select(
        "cond", F.coalesce("boundaries", F.array().cast("array<bigint>")).alias("boundaries")
    )
    intervals = stage(seg.intervals_from_points(every, shape.n_frames))
    graphs = stage(tn.interval_graphs(low, intervals))
    labels, quality, agreement = cm.select_communities(
        graphs, shape, k_max=cfg.k_range[1], k_min=cfg.k_range[0], min_size=cfg.min_community,
        criterion=cfg.criterion, on_disconnected=cfg.on_disconnected,
    )
    return Study(low, points, intervals, labels, quality, agreement, tn.group_mean(graphs, shape))


def detector_table(
    edges: DataFrame, shape: TensorShape, clock: Callable[[Column], Column], cfg: StudyConfig = StudyConfig(), frames: DataFrame | None = None,
) -> DataFrame:
    """Change points of the five detectors: (cond, method, ord, frame, ms).

    With ``frames``, both they and ``edges`` are stored already. Trackers are chains of small jobs, so they run side by side.
    """
    if frames is None:
        edges = stage(edges)
        frames = fr.stage_frames(edges, shape)
    n = shape.n_frames
    energy = dt.fill_signal(tn.mean_graph_energy(edges, shape), shape)
    alpha, sigma = cfg.alphas[len(cfg.alphas) // 2], cfg.sigmas[len(cfg.sigmas) // 2]
    settings = [(a, sigma) for a in cfg.alphas] + [(alpha, s) for s in cfg.sigmas if s != sigma]
    with ThreadPoolExecutor(len(settings) + 1) as pool:
        energies = [pool.submit(inheritable_thread_target(tr.sparse_energy), frames, shape, cfg.tracker.subspace.train, a, s) for a, s in settings]
        shifts = [dt.grassmann_shift(frames, shape, w, cfg.subspace_rank) for w in cfg.windows]
        hosvd = pool.submit(inheritable_thread_target(dt.sweep_signals), shifts, n, clock)
        tracked = [energy.result()[0] for energy in energies]
    found = {
        "hosvd": hosvd.result(),
        "tracker": dt.sweep_signals(tracked, n, clock),
        "pelt": dt.choose_penalty(dt.penalty_sweep(energy, n, list(cfg.penalties))),
        "dmd": dt.kernel_change_points(dt.dmd_shift(edges, shape, cfg.shift_window, cfg.subspace_rank), n),
        "rank1": dt.kernel_change_points(dt.rank1_shift(edges, shape, cfg.shift_window), n),
    }
    out = None
    for method, points in found.items():
        rows = dt.boundary_times(points.select("cond", F.lit(method).alias("method"), "boundaries"), clock)
        out = rows if out is None else out.unionByName(rows)
    return out


def detected_intervals(points: DataFrame, shape: TensorShape) -> DataFrame:
    """(cond, interval, start, end) of every detector; the interval is named method|pre and so on."""
    sets = points.groupBy("cond", "method").agg(F.array_sort(F.collect_set("frame")).alias("boundaries"))
    keyed = sets.select(F.concat_ws("|", "method", "cond").alias("cond"), "boundaries")
    return stage(
        seg.intervals_from_points(keyed, shape.n_frames).select(
            F.split("cond", r"\|")[1].alias("cond"),
            F.concat_ws("|", F.split("cond", r"\|")[0], "interval").alias("interval"), "start", "end",
        )
    )


def communities_by_detector(low_rank: DataFrame, points: DataFrame, shape: TensorShape, cfg: StudyConfig) -> DataFrame:
    """Consensus communities of the intervals of every detector, all at once: one row per method and interval.

    ``points(cond, method, frame)``; method, interval, its frames, the chosen number of communities and its scores.
    """
    spans = detected_intervals(points, shape)
    graphs = stage(tn.interval_graphs(low_rank, spans))
    _, quality, _ = cm.select_communities(
        graphs, shape, k_max=cfg.k_range[1], k_min=cfg.k_range[0], min_size=cfg.min_community,
        criterion=cfg.criterion, on_disconnected=cfg.on_disconnected,
    )
    found = summary_table(quality, spans, lambda t: t.cast("double"))
    name = F.split("interval", r"\|")
    return found.withColumn("method", name[0]).withColumn("interval", name[1])


def _arbitrated_by_interval(stack, rows):
    return cm.arbitrated(stack, [cm.interval_profile(name.split("|")[-1]) for name in rows.interval])


def consensus_table(low_rank: DataFrame, points: DataFrame, shape: TensorShape) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Communities of every subject and frame, then per detector and interval their agreement,
    its consensus communities, and the pooled mean graph.

    ``points(cond, method, frame)``; the frame labels are computed once for all methods.
    """
    labelled = stage(cm.frame_communities(low_rank, shape))
    spans = detected_intervals(points, shape)
    agreement = stage(cm.interval_agreement(labelled, spans, shape))
    packed = cm.pack_graphs(agreement, KEYS, shape.n_nodes)
    found = cm.map_graphs(
        packed, KEYS, shape.n_nodes,
        _arbitrated_by_interval,
    )
    return agreement, found, tn.pooled_mean(low_rank, spans, shape)


def summary_table(quality: DataFrame, intervals: DataFrame, clock: Callable[[Column], Column]) -> DataFrame:
    """One row per interval: frames, clock readings and the selected partition's scores."""
    best = ql.best_partition(quality)
    return intervals.join(best, KEYS).select(
        *KEYS, F.col("start").alias("start_frame"), (F.col("end") - 1).alias("end_frame"),
        clock(F.col("start")).alias("start_ms"), clock(F.col("end") - 1).alias("end_ms"),
        F.col("k").alias("best_k"), F.col("selection_score").alias("best_selection_score"),
        F.col("u").alias("best_u"), F.col("q").alias("best_q"),
    )
