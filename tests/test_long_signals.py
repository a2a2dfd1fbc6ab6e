"""Segmentation and thinning over blocks against the plain programmes on whole sequences."""

import numpy as np
import pytest

from netweave.operators import detectors as dt
from netweave.operators import long_signals as ls


def signal_of(spark, *sequences, parts=3):
    rows = [(f"c{k}", t, float(v)) for k, x in enumerate(sequences) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "cond string, t bigint, v double").repartition(parts)


def steps(n, seed, levels=5, noise=0.3):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(0, 3, levels), -(-n // levels))[:n] + rng.normal(0, noise, n)


@pytest.mark.parametrize("size, listed", [(7, 1 << 18), (16, 3)])
def test_median_of_differences(spark, size, listed):
    """Few and many values, ties, two far middle values, constants."""
    rng = np.random.default_rng(1)
    cases = [rng.normal(size=61), rng.integers(0, 4, 50), np.zeros(20), np.array([5.0]), np.array([0.0, 1.0]), np.array([0, 0, 0, 0, 100, 100, 100.0]), np.array([0.0, 1e-9, 1e6]), np.arange(4) ** 5.0]
    found = ls.median_square_difference(signal_of(spark, *cases), ["cond"], size, listed)
    for k, x in enumerate(cases):
        r, c = np.triu_indices(len(x), 1)
        want = float(np.median((x[r] - x[c]) ** 2)) if len(x) > 1 else 0.0
        assert found[f"c{k}",] == pytest.approx(want, rel=1e-12), k


@pytest.mark.parametrize("size", [13, 100])
def test_kernel_segmentation_over_blocks(spark, size):
    xs = [steps(70, s) for s in (1, 2)]
    found = {r.cond: r.boundaries for r in ls.kernel_segmentation(signal_of(spark, *xs), ["cond"], 70, 4, 6, size=size).collect()}
    assert found == {f"c{k}": dt.kernel_boundaries(x, 4, 6) for k, x in enumerate(xs)}


def test_kernel_segmentation_that_cannot_fit(spark):
    assert ls.kernel_segmentation(signal_of(spark, np.arange(9.0)), ["cond"], 9, 4, 2, size=4).first().boundaries == []


@pytest.mark.parametrize("size, jump, min_size", [(3, 5, 6), (2, 4, 13)])
def test_penalised_segmentation_over_blocks(spark, size, jump, min_size):
    xs = [steps(83, 3), np.ones(83), steps(83, 4, levels=2)]
    found = dt.penalty_sweep(signal_of(spark, *xs), 83, [0.5, 5.0, 50.0, 1e6], (min_size + 0.5) / 83, jump, block=size).collect()
    assert len(found) == 12
    for r in found:
        assert r.boundaries == dt.penalised_boundaries(xs[int(r.cond[1])], r.penalty, min_size, jump), (r.cond, r.penalty)


def test_a_long_signal_without_one_group(spark):
    """100,000 frames: planted changes are found within a few frames, by penalties and blocks only."""
    n = 100_000
    x = np.repeat([0.0, 4.0, -3.0, 1.0], n // 4) + np.sin(np.arange(n) * 12.9898) * 0.5
    found = dt.penalty_sweep(signal_of(spark, x, parts=8), n, [2000.0], 0.01).first()
    assert found.boundaries == [n // 4, n // 2, 3 * n // 4]


def plain_thinned(rows, distance):
    kept = []
    for point, score in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(point - p) >= distance for p, _ in kept):
            kept.append((point, score))
    return sorted(kept)


@pytest.mark.parametrize("chunk", [5.0, None])
def test_thinning(spark, chunk):
    """Random points, equal scores, long chains of rising and falling scores, repeated points."""
    rng = np.random.default_rng(3)
    cases = {
        "random": [(int(p), float(rng.integers(0, 20))) for p in rng.integers(-200, 200, 150)],
        "rising": [(k, float(k)) for k in range(120)], "falling": [(k, float(-k)) for k in range(120)], "equal": [(3 * k, 1.0) for k in range(50)],
        "saw": [(k, float((k * 7) % 11)) for k in range(150)], "one": [(5, 1.0)],
    }
    rows = [(c, p, s) for c, points in cases.items() for p, s in points]
    found = ls.thinned(spark.createDataFrame(rows, "cond string, point bigint, score double").repartition(5), 6, chunk).collect()
    for c, points in cases.items():
        best = {p: max(s for q, s in points if q == p) for p, _ in points}
        assert sorted((r.point, r.score) for r in found if r.cond == c) == plain_thinned(best.items(), 6), c


def test_thinning_of_nothing(spark):
    assert ls.thinned(spark.createDataFrame([], "cond string, point bigint, score double"), 6).collect() == []


def test_spectra_of_many_trials_take_little_memory(spark):
    """Trials that Spark hands over together are transformed in slabs; the sums equal those of a direct transform."""
    import tracemalloc

    from pyspark.sql import functions as F

    from netweave.operators import signals as sg

    x = np.random.default_rng(0).random((4, 64))
    rows = spark.createDataFrame([(k, x[k].tolist()) for k in range(4)], "k bigint, v array<double>")
    wanted = sg.windowed_spectra(x, 16, (1, 2, 3))
    for r in rows.select("k", sg.short_time_spectrum(F.col("v"), 16, (1, 2, 3)).alias("a")).collect():
        assert np.allclose(r.a, wanted[r.k])
    tracemalloc.start()
    sg.windowed_spectra(np.zeros((sg.SPECTRA_ROWS, 64)), 16, (1, 2, 3))
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
