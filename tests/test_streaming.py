"""Streaming trackers: equal to the batch ones, whatever the order of frames; late, repeated and missing frames."""

import datetime as dt

import numpy as np
import pytest
from conftest import edges_of, tensor

from netweave.operators import frames as fr
from netweave.operators import tracker as tr
from netweave.operators.tracker_config import Selection, Subspace
from netweave.streaming import tracker as st

CONFIG = tr.TrackerConfig(Subspace(train=8, block=4, floor=0.25, node_cap=6, subject_cap=3), selection=Selection(rate=None))
HOUR = 3_600_000


def changing_tensor(n_frames=26):
    x = tensor(3, 6, n_frames, seed=5)
    x[..., 14:] *= np.random.default_rng(6).random(x.shape[:3])[..., None] * 4
    return (x + x.transpose(0, 2, 1, 3)) / 2


def rows_of(spark, x):
    edges, shape = edges_of(spark, x)
    base = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(r.cond, r.t, base + dt.timedelta(hours=r.t), r.pos, r.w) for r in fr.pack_frames(edges, shape).orderBy("t").collect()]
    return edges, shape, rows, int(base.timestamp() * 1000)


def streamed(spark, tmp_path, batches, run):
    """Rows of a query that gets one file a micro-batch, in the given order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, st.FRAME_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    for k in range(len(batches)):
        source = next((tmp_path / f"in{k}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        target = tmp_path / "in" / f"{k:03d}.parquet"
        target.write_bytes(source.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(st.FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def shuffled_batches(rows):
    """Out of order within a day, frames repeated, and a late one that differs."""
    a, b, c = rows[:9], rows[9:18], rows[18:]
    a = [*a[::-1], rows[11]]
    b = [*b[::2], *b[1::2], rows[2], b[3]]
    fake = (rows[4][0], rows[4][1], rows[4][2], [0, 1], [99.0, 99.0])
    return [a, b, [*c[::-1], fake]]


def test_scores_equal_batch(spark, tmp_path):
    edges, shape, rows, start = rows_of(spark, changing_tensor())
    want = tr.track(fr.stage_frames(edges, shape), shape, CONFIG).scores.orderBy("update_time").collect()
    got = sorted(streamed(spark, tmp_path, shuffled_batches(rows), lambda s: st.stream_scores(s, shape, CONFIG, start, HOUR)), key=lambda r: r.update_time)
    assert len(want) == len(got) == 4
    for a, b in zip(want, got):
        for name in a.asDict():
            assert b[name] == (pytest.approx(a[name], abs=1e-9) if isinstance(a[name], float) else a[name]), name


def test_energy_equals_batch(spark, tmp_path):
    edges, shape, rows, start = rows_of(spark, changing_tensor())
    want = {r.t: r.v for r in tr.sparse_energy(fr.stage_frames(edges, shape), shape, 8, 4, 0.11)[0].collect()}
    got = {r.t: r.v for r in streamed(spark, tmp_path, shuffled_batches(rows), lambda s: st.stream_sparse_energy(s, shape, 8, 4, 0.11, start_ms=start))}
    assert got == pytest.approx(want, abs=1e-7)


def test_missing_frames_count_as_empty_once_the_watermark_passes(spark, tmp_path):
    """Frames 10 and 11 never come: the ones behind them wait for the watermark, then go on as if those were empty."""
    x = changing_tensor()
    x[..., 10:12] = 0
    edges, shape, rows, start = rows_of(spark, x)
    want = {r.t: r.v for r in tr.sparse_energy(fr.stage_frames(edges, shape), shape, 8, 4, 0.11)[0].collect()}
    end = (rows[0][0], 500, rows[0][2] + dt.timedelta(hours=500), [], [])
    batches = [rows[:10], rows[12:20], rows[20:], [end]]
    got = {r.t: r.v for r in streamed(spark, tmp_path, batches, lambda s: st.stream_sparse_energy(s, shape, 8, 4, 0.11, start_ms=start, delay="2 hours"))}
    assert {t: got[t] for t in range(24)} == pytest.approx({t: want[t] for t in range(24)}, abs=1e-7)


def test_registered_stream_equals_the_batch_tracker(spark, small):
    from netweave.plans import catalog, regime_queries as rq
    from netweave.sources import networks as nw

    shape = nw.event_shape(spark, small)
    got = catalog.QUERIES["stream_tracker_scores"](spark, small).orderBy("update_time").collect()
    want = tr.track(fr.stage_frames(nw.event_edges(spark, small), shape), shape, rq.EVENT_TRACKER).scores.orderBy("update_time").collect()
    assert len(got) == len(want) == (shape.n_frames - 120) // 24
    for a, b in zip(want, got):
        for name in b.asDict():
            assert b[name] == (pytest.approx(a[name], abs=1e-5) if isinstance(a[name], float) else a[name]), (a.update_time, name)
