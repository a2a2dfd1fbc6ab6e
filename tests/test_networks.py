"""Communities, quality, tensors, sources and sinks."""

import threading

import numpy as np
import pytest
from conftest import dense_of, edges_of, tensor
from pyspark.sql import functions as F

import netweave.shape as shapes
from netweave.operators import communities as cm
from netweave.operators.spectral import gap_parts
from netweave.operators import frames as fr
from netweave.operators import graphs as gr
from netweave.operators import quality as ql
from netweave.operators import tensor as tn
from netweave.plans import study
from netweave.plans.network_queries import thirds
from netweave.sources import networks as nw
from netweave.sources import tables as tb
from netweave.stage import shared_dir, stage


def blocks(sizes, inside=1.0, outside=0.05, seed=0):
    rng = np.random.default_rng(seed)
    member = np.repeat(np.arange(len(sizes)), sizes)
    a = np.where(member[:, None] == member, inside, outside) * (1 + 0.05 * rng.random((member.size, member.size)))
    a = np.triu(a, 1)
    return a + a.T, member


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_gap_split_finds_two_blocks():
    a, member = blocks([5, 7])
    assert same_partition(gap_parts(a[None])[0], member)
    assert list(gap_parts(np.zeros((1, 1))[None])[0]) == [1]
    assert list(gap_parts(np.ones((2, 2))[None])[0]) == [1, 2]
    assert list(gap_parts(np.zeros((5, 5))[None])[0]) == [1, 1, 2, 2, 2]


def test_gap_split_of_disconnected_graph_by_components():
    a, member = blocks([4, 6], outside=0.0)
    assert same_partition(gap_parts(a[None])[0], member)


def test_recursive_and_greedy_communities():
    a, member = blocks([5, 5, 6])
    (labels,), (q,) = cm.recursive_parts(a[None])
    assert same_partition(labels, member)
    assert q == pytest.approx(cm.graph_modularity(a, member))
    assert same_partition(cm.greedy_moves(a), member)
    assert np.isnan(cm.arbitrated(np.zeros((1, 4, 4)), ["balanced"])[1][0])


@pytest.mark.parametrize("seed", range(5))
def test_greedy_moves_are_locally_optimal(seed):
    rng = np.random.default_rng(seed)
    a = np.triu(rng.random((9, 9)) * (rng.random((9, 9)) < 0.5), 1)
    a += a.T
    labels = cm.greedy_moves(a)
    q = cm.graph_modularity(a, labels)
    merged = [np.where(labels == x, y, labels) for x in set(labels) for y in set(labels) if x < y]
    assert all(cm.graph_modularity(a, m) <= q + 1e-9 for m in merged)


def test_planted_regions_are_found(spark, medium):
    """All five regions come out: where all subjects agree the consensus falls into components."""
    graphs = tn.interval_graphs(nw.planted_edges(spark, medium), thirds(spark, medium))
    labels, table, agreement = cm.select_communities(graphs, nw.trade_shape(spark, medium), k_max=6, min_size=3)
    rows = labels.collect()
    assert {(r.interval, r.k) for r in rows} == {("pre", 5), ("core", 5), ("post", 5)}
    for interval in ("pre", "core", "post"):
        found = {}
        for r in rows:
            if r.interval == interval:
                found.setdefault(r.community, set()).add(r.node % 5)
        assert sorted(map(len, found.values())) == [1] * 5
    assert agreement.filter("w < 0 or w > 1").count() == 0


def test_quality_against_dense_counts(spark):
    x = tensor(3, 8, 1, density=0.6)
    edges, shape = edges_of(spark, x)
    graphs = edges.select("cond", F.lit("all").alias("interval"), "subj", "i", "j", "w")
    keys = spark.createDataFrame([("c", "all")], "cond string, interval string")
    member = np.array([1, 1, 1, 2, 2, 2, 2, 3])
    labels = spark.createDataFrame([("c", "all", i, int(m)) for i, m in enumerate(member)], "cond string, interval string, node bigint, community bigint")
    got = {r.community: r for r in ql.cluster_quality(ql.rank_histograms(ql.pooled_ranks(ql.rank_bins(graphs, 8, shape.subjects, keys)), labels)).collect()}
    for c in (1, 2, 3):
        intra, inter = np.zeros(8), np.zeros(8)
        for s in range(3):
            for i in np.flatnonzero(member == c):
                others = [j for j in range(8) if j != i]
                others.sort(key=lambda j: (-x[s, i, j, 0], j))
                for rank, j in enumerate(others):
                    (intra if member[j] == c else inter)[rank] += 1
        p = intra / intra.sum() if intra.sum() else np.full(8, 1 / 8)
        q = inter / inter.sum()
        entropy = -sum(v * np.log2(v) for v in p if v > 0)
        m = (p + q) / 2
        js = sum(v * np.log2(v / w) for v, w in zip(p, m) if v > 0) / 2 + sum(v * np.log2(v / w) for v, w in zip(q, m) if v > 0) / 2
        assert got[c].h == pytest.approx((member == c).mean() * max(0, 1 - entropy / 3))
        assert got[c].c == pytest.approx(min(1, max(0, js)))


def test_frame_agreement_counts_missing_graphs(spark):
    x = tensor(2, 5, 6)
    x[1, :, :, 3] = 0
    edges, shape = edges_of(spark, x)
    labelled = cm.frame_communities(edges, shape)
    spans = spark.createDataFrame([("c", "core", 0, 6)], "cond string, interval string, start bigint, end bigint")
    got = {(r.i, r.j): r.w for r in cm.interval_agreement(labelled, spans, shape).collect()}
    want = np.zeros((5, 5))
    for s in range(2):
        for t in range(6):
            labels = cm.arbitrated(x[s, :, :, t][None], ["balanced"])[0][0]
            want += labels[:, None] == labels
    assert len(got) == 10
    assert all(w == pytest.approx(want[i, j] / 12) for (i, j), w in got.items())


def test_modularity_of_empty_graph(spark):
    none = spark.createDataFrame([("c", 0, 1, 0.0)], "cond string, i bigint, j bigint, w double")
    labels = spark.createDataFrame([(0, 1), (1, 1)], "node bigint, community bigint")
    assert gr.modularity(none, labels, ["cond"]).first().q == 0.0
    assert gr.modularity(none, labels, ["cond"], empty=float("nan")).filter("isnan(q)").count() == 1


def test_selection_criteria(spark):
    rows = [("c", "a", 2, 0.5, 0.1), ("c", "a", 3, 0.4, 0.3), ("c", "b", 2, 0.5, -0.1), ("c", "b", 3, 0.6, -0.2)]
    table = spark.createDataFrame(rows, "cond string, interval string, k int, u double, q double")
    assert {r.interval: r.k for r in ql.best_partition(ql.selection_score(table)).collect()} == {"a": 2, "b": 3}
    weighted = ql.best_partition(ql.selection_score(table, "u_times_positive_q"))
    assert {r.interval: r.k for r in weighted.collect()} == {"a": 3, "b": 3}
    with pytest.raises(ValueError):
        ql.selection_score(table, "x")


def test_studies_run_for_every_denoiser(spark):
    x = np.zeros((4, 9, 9, 45))
    for t in range(45):
        a, _ = blocks([4, 5] if t < 15 else [5, 4] if t < 30 else [3, 6], outside=0.2, seed=t)
        x[..., t] = a
    edges, shape = edges_of(spark, x)
    from netweave.operators.tracker_config import Selection, Subspace, TrackerConfig

    cfg = study.StudyConfig(
        ranks=(2, 4), k_range=(2, 3), min_interval=5, windows=(4, 6), shift_window=6, alphas=(5,), sigmas=(0.11,),
        on_disconnected="components",
        tracker=TrackerConfig(Subspace(train=10, block=5), selection=Selection(rate=None, window_ms=None)),
    )
    for denoiser in ("raw", "hosvd", "tracker"):
        done = study.run_study(edges, shape, denoiser, cfg)
        assert done.labels.groupBy("interval").count().filter("count = 9").count() == done.intervals.count() == 3
        if denoiser == "raw":
            assert done.change_points.first().boundaries == [15, 30]
            rows = study.summary_table(done.quality, done.intervals, lambda t: t.cast("double")).collect()
            assert {(r.start_frame, r.end_frame) for r in rows} == {(0, 14), (15, 29), (30, 44)}
    points = study.detector_table(edges, shape, lambda t: t.cast("double"), cfg)
    assert {r.method for r in points.select("method").distinct().collect()} >= {"hosvd", "tracker", "dmd", "rank1"}
    agreement, found, mean = study.consensus_table(edges, points, shape)
    assert agreement.count() == mean.count()
    assert found.filter("size(nodes) <> 9").count() == 0


def test_trackers_of_a_table_run_side_by_side(spark, monkeypatch):
    """No tracker waits for another one's end, and stored frames are taken as they are."""
    from netweave.operators.tracker_config import Selection, Subspace, TrackerConfig

    edges, shape = edges_of(spark, tensor(2, 6, 40, seed=5))
    cfg = study.StudyConfig(
        ranks=(2, 3), windows=(4,), shift_window=6, alphas=(5, 8), sigmas=(0.11, 0.2),
        tracker=TrackerConfig(Subspace(train=10, block=5), selection=Selection(rate=None, window_ms=None)),
    )
    clock = lambda t: t.cast("double")
    alone = sorted(map(tuple, study.detector_table(edges, shape, clock, cfg).collect()))
    meet, tracked = threading.Barrier(3), study.tr.sparse_energy

    def together(*given):
        meet.wait(60)
        return tracked(*given)

    monkeypatch.setattr(study.tr, "sparse_energy", together)
    frames = study.stage(fr.pack_frames(edges, shape))
    assert sorted(map(tuple, study.detector_table(edges, shape, clock, cfg, frames).collect())) == alone


# ---- shapes, sources, sinks ---------------------------------------------------------------


def test_shape_checks(spark):
    edges, shape = edges_of(spark, tensor(2, 4, 5))
    assert shapes.shape_of(edges) == shape
    with pytest.raises(ValueError):
        shapes.TensorShape(("c",), ("a",), 100_000, 1).require_frame_fits()
    with pytest.raises(ValueError):
        shapes.TensorShape(("c",), ("a",), 100_000, 1).require_modes_fit()


def test_packed_frames_round_trip(spark):
    x = tensor(3, 5, 7, density=0.3)
    x[..., 4] = 0
    edges, shape = edges_of(spark, x)
    rows = fr.pack_frames(edges, shape).collect()
    assert len(rows) == 7
    for r in rows:
        np.testing.assert_array_equal(fr.unpack(r.pos, r.w, shape), x[..., r.t])


def test_edges_round_trip_and_slice(spark, tmp_path):
    edges, shape = edges_of(spark, tensor(2, 4, 10))
    path = str(tmp_path / "edges")
    tb.write_edges(edges, path)
    part = tb.read_edges(spark, path, (3, 5))
    assert {r.t for r in part.select("t").distinct().collect()} == {3, 4, 5}
    assert dense_of(tb.read_edges(spark, path).collect(), shape, "w").sum() == pytest.approx(dense_of(edges.collect(), shape, "w").sum())
    assert [r.subj for r in tb.discover_subjects(edges, 1).collect()] == ["s0"]


def test_electrode_layout(spark, tmp_path):
    path = tmp_path / "electrodes.tsv"
    path.write_text("name\tx\ty\tz\nFz\t3\t4\t0\nCz\t0\t 0\t1\nA1\tn/a\t1\t1\nB\tbad\t2\t\n")
    layout = tb.read_electrodes(spark, str(path))
    assert {r.name: (r.x, r.z) for r in layout.collect()}["A1"] == (None, 1.0)
    at = {r.name: (r.x, r.y) for r in tb.electrode_positions(layout).collect()}
    assert set(at) == {"Fz", "Cz"}
    assert at["Fz"] == pytest.approx((-0.96 * 4 / 5, 0.96 * 3 / 5))


def test_change_point_checks(spark):
    def points(ms):
        rows = [("c", "m", k, k, float(v)) for k, v in enumerate(ms)]
        return spark.createDataFrame(rows, tb.CHANGE_POINT_SCHEMA)

    assert tb.check_change_points(points([1, 2, 3, 4]), 4).count() == 4
    for bad in ([1, 2, 3], [1, 3, 2, 4]):
        with pytest.raises(Exception, match="expected 4|strictly increasing"):
            tb.check_change_points(points(bad), 4).collect()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3)], "name string, v double")
    tb.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first().v == "0.3333333333"
    cells = spark.createDataFrame([(0, 2, 1.5)], "i bigint, j bigint, w double")
    wide = tb.matrix_wide(cells, 3).collect()
    assert [tuple(r)[1:] for r in wide] == [(0.0, 0.0, 1.5), (1.5, 0.0, 0.0)]


def test_stage_uses_the_named_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(10).withColumn("b", F.col("id") % 2), "b")
    assert df.filter("b = 1").count() == 5


def test_requested_community_counts(spark, medium):
    names = ("pre", "core", "post")
    assert cm.requested_levels(None, (2, 4), names) == {n: [2, 3, 4] for n in names}
    assert cm.requested_levels(3, (2, 4), names) == {n: [3] for n in names}
    levels = cm.requested_levels((2, 3, 4), (2, 6), names)
    for bad in (1, (2, 3)):
        with pytest.raises(ValueError):
            cm.requested_levels(bad, (2, 4), names)
    graphs = tn.interval_graphs(nw.planted_edges(spark, medium), thirds(spark, medium))
    labels, _, _ = cm.select_communities(graphs, nw.trade_shape(spark, medium), min_size=3, levels=levels)
    assert {(r.interval, r.k) for r in labels.collect()} == {("pre", 2), ("core", 3), ("post", 4)}


def test_integer_lists(spark):
    from netweave.functions.scalar import parse_int_list

    df = spark.createDataFrame([("10, none,3",)], "s string")
    assert df.select(parse_int_list(F.col("s")).alias("a")).first().a == [10, None, 3]
