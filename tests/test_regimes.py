"""Segmentation, detectors, low rank and trackers against dense computations."""

import itertools

import numpy as np
import pandas as pd
import pytest
from conftest import dense_of, edges_of, tensor
from pyspark.sql import functions as F

from netweave.operators import detectors as dt
from netweave.operators import frames as fr
from netweave.operators import lowrank as lr
from netweave.operators import segmentation as seg
from netweave.operators import tracker as tr
from netweave.operators.tracker_config import Change, Recovery, Selection, Subspace
from netweave.sources import networks as nw


def unfold(x, mode):
    return np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)


def features_of(x):
    r, c = np.triu_indices(x.shape[1], 1)
    f = x[:, r, c, :].mean(axis=0).T
    sd = f.std(axis=0)
    return np.where(sd > 0, (f - f.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)


def sse(f):
    return float(((f - f.mean(axis=0)) ** 2).sum())


def values(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r.t] = r.v
    return out


@pytest.mark.parametrize("sf, boundaries, total", [
    ("0.001", [50, 62], 15737.099), ("0.01", [40, 51], 24185.656), ("0.1", [63, 73], 24072.647),
])
def test_trade_regimes(spark, sf, boundaries, total):
    got = seg.detect_exact(nw.trade_edges(spark, f"/root/testdata/sf{sf}"), nw.trade_shape(spark, f"/root/testdata/sf{sf}")).first()
    assert got.boundaries == boundaries
    assert round(got.sse, 3) == total


@pytest.mark.parametrize("n_bkps, min_size", [(1, 3), (2, 4), (3, 3)])
def test_exact_segmentation_is_optimal(spark, n_bkps, min_size):
    x = tensor(2, 4, 18, seed=n_bkps)
    x[..., 7:] *= 3
    edges, shape = edges_of(spark, x)
    f = features_of(x)
    best = min(
        (sum(sse(f[a:b]) for a, b in zip((0, *cut), (*cut, 18))), cut)
        for cut in itertools.combinations(range(1, 18), n_bkps)
        if min(np.diff((0, *cut, 18))) >= min_size
    )
    got = seg.detect_exact(edges, shape, n_bkps, min_size).first()
    assert tuple(got.boundaries) == best[1]
    assert got.sse == pytest.approx(best[0])


def test_too_few_frames_give_no_boundaries(spark):
    edges, shape = edges_of(spark, tensor(1, 3, 2))
    assert seg.detect_exact(edges, shape, 3, 1).count() == 0


@pytest.mark.parametrize("points, expected", [
    ([3, 6], [("pre", 0, 3), ("core", 3, 6), ("post", 6, 11)]),
    ([2, 4, 6, 9], [("pre", 2, 4), ("core", 4, 6), ("post", 6, 9)]),
    ([5], [("pre", 0, 4), ("core", 4, 8), ("post", 8, 11)]),
    ([0, 4, 7, 11], [("pre", 0, 4), ("core", 4, 7), ("post", 7, 11)]),
])
def test_intervals(spark, points, expected):
    df = spark.createDataFrame([("c", points)], "cond string, boundaries array<bigint>")
    got = seg.intervals_from_points(df, 11).collect()
    assert sorted((r.interval, r.start, r.end) for r in got) == sorted(expected)


def test_hosvd_matches_dense_projection(spark):
    x = tensor(4, 6, 15, density=0.7)
    edges, shape = edges_of(spark, x)
    got = dense_of(lr.hosvd_low_rank(fr.stage_frames(edges, shape), shape, (2, 3)).collect(), shape, "w")
    us = np.linalg.svd(unfold(x, 0), full_matrices=False)[0][:, :2]
    un = np.linalg.svd(unfold(x, 1), full_matrices=False)[0][:, :3]
    want = np.einsum("ab,cd,ef,bdft->acet", us @ us.T, un @ un.T, un @ un.T, x)
    want = (want + want.transpose(0, 2, 1, 3)) / 2
    want[:, range(6), range(6)] = 0
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_grassmann_shift_matches_window_svd(spark):
    x = tensor(2, 6, 30)
    edges, shape = edges_of(spark, x)
    got = values(dt.grassmann_shift(fr.pack_frames(edges, shape), shape, 8, 2), 30)
    want, before = np.zeros(30), None
    seq = x.transpose(1, 2, 0, 3)
    for t in range(8, 30, 4):
        u = np.linalg.svd(seq[..., t - 8:t].reshape(6, -1), full_matrices=False)[0][:, :2]
        if before is not None:
            want[t - 2] = 1 - np.linalg.norm(u.T @ before) ** 2 / 2
        before = u
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("n_frames", [30, 150])
def test_dmd_shift_matches_full_matrices(spark, n_frames):
    x = tensor(2, 5, n_frames)
    edges, shape = edges_of(spark, x)
    got = values(dt.dmd_shift(edges, shape, 6, 3), n_frames)
    flat = x.mean(axis=0).reshape(25, -1)
    want, before = np.zeros(n_frames), None
    for t in range(6, n_frames):
        a, b = flat[:, t - 6:t - 1], flat[:, t - 5:t]
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        now = np.sort(np.abs(np.linalg.eigvals(u[:, :3].T @ b @ vt[:3].T / s[:3])))
        if before is not None:
            want[t] = np.linalg.norm(now - before)
        before = now
    np.testing.assert_allclose(got, want, atol=1e-7)


def test_window_centres_split_the_frame(spark):
    x = tensor(2, 5, 80)
    edges, shape = edges_of(spark, x)
    rows = dt.window_centres(fr.pack_frames(edges, shape), shape, 6, 2).collect()
    assert {r.t for r in rows} == {t - 1 for t in range(6, 80, 3)}
    for r in rows[:200]:
        assert r.low_rank + r.residual == pytest.approx(x[shape.subjects.index(r.subj), r.i, r.j, r.t])


def test_kernel_segmentation_is_optimal():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, 6) for m in (0, 2, 1)])
    gamma = 0.7
    k = np.exp(-np.clip(gamma * (x[:, None] - x) ** 2, 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)

    def cost(a, b):
        return (b - a) - k[a:b, a:b].sum() / (b - a)

    best = min(
        (cost(0, p) + cost(p, q) + cost(q, 18), [p, q]) for p in range(3, 16) for q in range(p + 3, 16)
    )
    assert dt.kernel_boundaries(x, 2, 3, gamma) == best[1]
    assert dt.kernel_boundaries(x[:5], 2, 3, gamma) == []


def test_penalised_segmentation_is_optimal():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.2, 8) for m in (0, 3, 1)])
    grid = range(2, 24, 2)
    options = []
    for n in range(4):
        for cut in itertools.combinations(grid, n):
            ends = (0, *cut, 24)
            if min(np.diff(ends)) >= 3:
                total = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 1.5 for a, b in zip(ends, ends[1:]))
                options.append((total, list(cut)))
    assert dt.penalised_boundaries(x, 1.5, 3, 2) == min(options)[1]


def test_penalty_choice_prefers_three_or_four_points(spark):
    sweep = spark.createDataFrame(
        [("a", 0, 1.0, [1, 2]), ("a", 1, 2.0, [1, 2, 3]), ("a", 2, 3.0, [1, 2, 3, 4]), ("b", 0, 1.0, [1]), ("b", 1, 2.0, [7])],
        "cond string, ord int, penalty double, boundaries array<bigint>",
    )
    assert {r.cond: r.penalty for r in dt.choose_penalty(sweep).collect()} == {"a": 2.0, "b": 2.0}


# ---- trackers ----------------------------------------------------------------------------


def block_tensor():
    """Two blocks of nodes whose strengths change at frame 20; sparse spikes on top."""
    rng = np.random.default_rng(1)
    member = np.repeat([0, 1], 4)
    same = (member[:, None] == member) * 1.0
    x = np.zeros((3, 8, 8, 40))
    for t in range(40):
        base = same * (1.0 if t < 20 else 0.2) + (1 - same) * (0.1 if t < 20 else 0.9)
        x[..., t] = base * (1 + 0.1 * np.arange(3))[:, None, None]
        i, j = rng.choice(8, 2, replace=False)
        x[rng.integers(3), i, j, t] += 2.0
    x = (x + x.transpose(0, 2, 1, 3)) / 2
    x[:, range(8), range(8)] = 0
    return x


def test_pursuit_equals_the_explicit_dictionary():
    rng = np.random.default_rng(2)
    un, us = np.linalg.qr(rng.normal(size=(6, 2)))[0], np.linalg.qr(rng.normal(size=(4, 1)))[0]
    pn, ps = np.eye(6) - un @ un.T, np.eye(4) - us @ us.T
    y = tr.project_out(rng.normal(size=(6, 6, 4)), pn, ps)
    cfg = tr.TrackerConfig(recovery=Recovery(cells=5))
    got, left = tr.pursue(y, pn, ps, cfg)
    chosen, residual = [], y.ravel()
    for _ in range(5):
        score = np.abs(tr.project_out(residual.reshape(y.shape), pn, ps)).ravel()
        score[chosen] = 0
        chosen.append(int(score.argmax()))
        atoms = []
        for flat in chosen:
            i, j, s = np.unravel_index(flat, y.shape)
            atoms.append(np.einsum("a,b,c->abc", pn[:, i], pn[:, j], ps[:, s]).ravel())
        d = np.array(atoms).T
        coef = np.linalg.lstsq(d, y.ravel(), rcond=None)[0]
        residual = y.ravel() - d @ coef
    want = np.zeros(y.size)
    want[chosen] = coef
    np.testing.assert_allclose(got.ravel(), want, atol=1e-9)
    assert left == pytest.approx(np.linalg.norm(residual))


@pytest.mark.parametrize("solver", ["omp", "fista", "proxy"])
def test_separation_adds_up(spark, solver):
    x = block_tensor()
    edges, shape = edges_of(spark, x)
    cfg = tr.TrackerConfig(Subspace(train=8, block=4), Recovery(solver), selection=Selection(rate=None, window_ms=None))
    run = tr.track(fr.stage_frames(edges, shape), shape, cfg)
    rows = run.separated().collect()
    low, sparse = dense_of(rows, shape, "low_rank"), dense_of(rows, shape, "sparse")
    np.testing.assert_allclose(low + sparse, x, atol=1e-9)


def test_tracker_follows_a_dense_recursion(spark):
    """Ranks and scores of the block rounds equal a frame-by-frame SVD recursion."""
    x = block_tensor()
    edges, shape = edges_of(spark, x)
    cfg = tr.TrackerConfig(Subspace(train=8, block=4, floor=0.2, node_cap=6, subject_cap=3), selection=Selection(rate=None, window_ms=None))
    run = tr.track(fr.stage_frames(edges, shape), shape, cfg)
    seq = x.transpose(1, 2, 0, 3)
    bases, limits = [], []
    for mode, cap in ((0, 6), (2, 3)):
        data = unfold(seq[..., :8], mode)
        u, s, _ = np.linalg.svd(data / np.sqrt(data.shape[1]), full_matrices=False)
        bases.append(u[:, s >= 0.2 * s[0]][:, :cap])
        limits.append(0.2 * s[0])
    want = []
    for start in range(8, 40, 4):
        pn, ps = (np.eye(b.shape[0]) - b @ b.T for b in bases)
        lows, errors = [], []
        for t in range(start, start + 4):
            low, _, err = tr.separate(seq[..., t], pn, ps, cfg)
            lows.append(low)
            errors.append(err)
        changed = False
        for k, (mode, cap) in enumerate(((0, 6), (2, 3))):
            data = np.concatenate([unfold(low, mode) for low in lows], axis=1)
            power = ((bases[k].T @ data) ** 2).mean(axis=1)
            keep = power >= limits[k] ** 2
            keep[power.argmax()] |= not keep.any()
            b = bases[k][:, keep]
            u, s, _ = np.linalg.svd((data - b @ (b.T @ data)) / np.sqrt(data.shape[1]), full_matrices=False)
            new = u[:, s >= limits[k]][:, :cap - b.shape[1]]
            changed |= bool((~keep).any() or new.shape[1])
            bases[k] = np.linalg.qr(np.column_stack([b, new]))[0]
        want.append((start + 3, changed, bases[0].shape[1], bases[1].shape[1], np.mean(errors)))
    got = run.scores.orderBy("update_time").collect()
    assert [(r.update_time, r.changed, r.node_rank, r.subject_rank) for r in got] == [w[:4] for w in want]
    np.testing.assert_allclose([r.reconstruction_error for r in got], [w[4] for w in want], atol=1e-8)
    assert any(r.changed for r in got)


def energy_by_frame(x, train, alpha, sigma):
    seq = x.transpose(1, 2, 0, 3)

    def fit(block):
        out = []
        for mode in range(3):
            u, s, _ = np.linalg.svd(unfold(block, mode), full_matrices=False)
            out.append(u[:, :max(int((s > sigma * s[0]).sum()), 1)])
        return out

    p = fit(seq[..., :train])
    low, energy = seq.copy(), np.zeros(seq.shape[-1])
    for t in range(train, seq.shape[-1]):
        rest = seq[..., t]
        for mode in range(3):
            rest = np.moveaxis(np.tensordot(np.eye(p[mode].shape[0]) - p[mode] @ p[mode].T, rest, (1, mode)), 0, mode)
        rest = np.sign(rest) * np.maximum(np.abs(rest) - 0.01, 0)
        energy[t] = np.linalg.norm(rest)
        low[..., t] = seq[..., t] - rest
        if t % alpha == 0:
            p = fit(low[..., t - alpha:t])
    return energy


@pytest.mark.parametrize("train, alpha", [(8, 4), (9, 4), (8, 5)])
def test_sparse_energy_follows_the_frame_recursion(spark, train, alpha):
    x = block_tensor()
    edges, shape = edges_of(spark, x)
    signal, separated = tr.sparse_energy(fr.stage_frames(edges, shape), shape, train, alpha, 0.11)
    np.testing.assert_allclose(values(signal, 40), energy_by_frame(x, train, alpha, 0.11), atol=1e-7)
    rows = separated.collect()
    np.testing.assert_allclose(dense_of(rows, shape, "low_rank") + dense_of(rows, shape, "sparse"), x, atol=1e-9)


def test_change_point_selection(spark):
    rows = [("c", t, True, s) for t, s in ((10, 0.1), (20, 0.9), (30, 0.2), (40, 0.15), (50, 0.8), (60, 0.1))]
    scores = spark.createDataFrame(rows, "cond string, reported_time bigint, changed boolean, final_score double")

    def points(**kw):
        cfg = tr.TrackerConfig(Subspace(block=5), selection=Selection(**{"rate": None, **kw}))
        return [r.reported_time for r in tr.select_change_points(scores, cfg).collect()]

    assert points(window_ms=None, k=1.0) == [20, 50]
    assert points(window_ms=None, threshold="percentile", k=100.0) == [20]
    assert points(window_ms=(25.0, 45.0), anchor_ms=42.0) == [30, 40, 50]
    assert points(window_ms=None, threshold="percentile", k=0.0, apart_ms=0.0) == [20, 50]


@pytest.mark.parametrize("part, bad", [
    (Subspace, {"block": 0}), (Subspace, {"train": 0}), (Recovery, {"solver": "x"}), (Recovery, {"residual": -1.0}), (Recovery, {"budget": -1.0}),
    (Recovery, {"level_rule": "x"}), (Change, {"modes": (3,)}), (Change, {"rule": "x"}), (Selection, {"rate": 0.0}), (Selection, {"window_ms": (1.0, 0.0)}),
])
def test_config_is_validated(part, bad):
    with pytest.raises(ValueError):
        part(**bad)


def test_descent_of_a_stack_equals_single_frames():
    """Each frame stops by itself, as a plain loop of the same steps does."""
    rng = np.random.default_rng(5)
    un, us = np.linalg.qr(rng.normal(size=(6, 2)))[0], np.linalg.qr(rng.normal(size=(4, 1)))[0]
    pn, ps = np.eye(6) - un @ un.T, np.eye(4) - us @ us.T
    stack = tr.project_out(rng.normal(size=(5, 6, 6, 4)) * np.array([0.01, 1, 3, 10, 0])[:, None, None, None], pn, ps)
    for rec in (Recovery("fista"), Recovery("fista", penalty=0.3, budget=0.5, budget_relative=True)):
        got = tr.proximal_descent(stack, pn, ps, rec)
        for y, found in zip(stack, got):
            level = rec.penalty if rec.penalty is not None else tr.sparse_level(y, rec)
            x = z = np.zeros_like(y)
            t = 1.0
            for _ in range(rec.steps):
                step = z - np.einsum("ai,ijs,jb,sc->abc", pn, z, pn, ps) + y
                new = np.sign(step) * np.maximum(np.abs(step) - level, 0)
                size, t_next = max(np.linalg.norm(x), 1.0), (1 + np.sqrt(1 + 4 * t * t)) / 2
                z, gap, x, t = new + (t - 1) / t_next * (new - x), np.linalg.norm(new - x), new, t_next
                if gap <= rec.settled * size or (rec.budget is not None and np.linalg.norm(tr.project_out(x, pn, ps) - y) <= rec.budget * np.linalg.norm(y)):
                    break
            np.testing.assert_allclose(found, x, atol=1e-10)


def test_tracked_parts_are_not_trivial(spark):
    """The low-rank part is not the data, and every split frame has a sparse part."""
    x = block_tensor()
    edges, shape = edges_of(spark, x)
    cfg = tr.TrackerConfig(Subspace(train=8, block=4), selection=Selection(rate=None, window_ms=None))
    rows = tr.track(fr.stage_frames(edges, shape), shape, cfg).separated().where("t >= 8").collect()
    low, sparse = dense_of(rows, shape, "low_rank"), dense_of(rows, shape, "sparse")
    assert np.abs(sparse).max() > 0.5 and np.abs(low).max() > 0.5
    assert sum(np.abs(sparse[..., t]).max() > 0.1 for t in range(8, 40)) >= 12


def test_long_signal_is_segmented(spark):
    """20,000 frames: no table of segments, one start kept for each end and block pair."""
    rng = np.random.default_rng(8)
    level = np.repeat([0.0, 3.0, -1.0], [7_001, 6_999, 6_000])
    t = np.arange(20_000)
    rows = pd.concat([
        pd.DataFrame({"cond": "c", "i": 0, "j": j, "t": t, "z": level * (j + 1) + rng.normal(0, 0.1, t.size)}) for j in range(1, 3)
    ])
    found = seg.exact_segmentation(spark.createDataFrame(rows, "cond string, i bigint, j bigint, t bigint, z double"), 20_000).first()
    assert found.boundaries == [7_001, 14_000]
