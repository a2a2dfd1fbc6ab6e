"""Cells outside a declared shape fail; repeated cells add up; shapes come from the tables."""

import numpy as np
import pytest

from netweave.operators import frames as fr
from netweave.operators import signals as sg
from netweave.shape import TensorShape, shape_of
from netweave.sources import networks as nw

SHAPE = TensorShape(("c",), ("a", "b"), 4, 3)
SCHEMA = "cond string, subj string, i bigint, j bigint, t bigint, w double"


@pytest.mark.parametrize("row", [
    ("c", "zzz", 0, 1, 0, 1.0), ("c", "a", 0, 1, 9, 1.0), ("c", "a", 0, 4, 0, 1.0), ("c", "a", 2, 1, 0, 1.0), ("d", "a", 0, 1, 0, 1.0),
    ("c", "a", 0, 1, -1, 1.0),
])
def test_unknown_cells_fail(spark, row):
    edges = spark.createDataFrame([("c", "a", 0, 1, 0, 2.0), row], SCHEMA)
    with pytest.raises(Exception, match="outside the declared shape"):
        fr.pack_frames(edges, SHAPE).collect()


def test_derived_shape_takes_new_keys(spark):
    edges = spark.createDataFrame([("c", "a", 0, 1, 0, 2.0), ("c", "zzz", 0, 4, 9, 1.0)], SCHEMA)
    shape = shape_of(edges)
    assert (shape.subjects, shape.n_nodes, shape.n_frames) == (("a", "zzz"), 5, 10)
    assert sum(sum(r.w) for r in fr.pack_frames(edges, shape).collect()) == 3.0


def test_repeated_cells_add_up(spark):
    edges = spark.createDataFrame([("c", "b", 1, 2, 1, 2.0), ("c", "b", 1, 2, 1, 3.0)], SCHEMA)
    row = fr.pack_frames(edges, SHAPE).where("t = 1").first()
    graph = fr.unpack(row.pos, row.w, SHAPE)
    assert graph[1, 1, 2] == graph[1, 2, 1] == 5.0 and graph.sum() == 10.0


def test_trade_and_event_shapes(spark, small):
    shape, events = nw.trade_shape(spark, small), nw.event_shape(spark, small)
    assert (shape.n_subjects, shape.n_nodes, shape.n_frames) == (5, 25, 83)
    assert (events.n_nodes, events.n_frames) == (len(nw.event_types(spark, small)), 720)


def test_frame_slice_prunes_the_scan(spark, small):
    plan = nw.trade_edges(spark, small, frames=(44, 45))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan


def test_pairs_are_averaged_over_the_trials_that_hold_both(spark):
    rng = np.random.default_rng(0)
    waves = {(k, c): rng.standard_normal(8) for k in range(3) for c in range(3) if (k, c) != (2, 1)}
    rows = [(1, "x", k, c, v.tolist()) for (k, c), v in waves.items()]
    trials = spark.createDataFrame(rows, "subj int, cond string, trial bigint, ch int, v array<double>")
    found = sg.phase_locking(trials.withColumn("a", sg.analytic_signal(trials["v"])), 3)
    got = {(r.i, r.j, r.t): r.w for r in sg.locking_edges(found, 3, 8).collect()}

    def phase(v):
        spectrum = np.fft.fft(v) * np.array([1, 2, 2, 2, 1, 0, 0, 0])
        z = np.fft.ifft(spectrum)
        return z / np.abs(z)

    for (i, j, t), w in got.items():
        both = [k for k in range(3) if (k, i) in waves and (k, j) in waves]
        assert abs(w - abs(np.mean([phase(waves[k, i])[t] * np.conj(phase(waves[k, j])[t]) for k in both]))) < 1e-9


def test_staging_asks_for_a_shared_folder_on_a_cluster():
    from netweave.stage import require_shared

    for scheme, master in (("file", "local[4]"), ("file", "local"), ("hdfs", "yarn"), ("s3a", "spark://host:7077")):
        require_shared(scheme, master)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            require_shared("file", master)
