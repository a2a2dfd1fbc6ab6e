"""Contractions by blocks against dense products; absent cells, unknown columns, repeated entries, large matrices."""

import numpy as np
import pytest

from netweave.operators import contraction as co


def matrix_of(spark, m, cols=None):
    rows = [(int(r), int(c if cols is None else cols[c]), float(m[r, c])) for r, c in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "row bigint, col bigint, m double")


@pytest.mark.parametrize("block, entries", [(1024, 1 << 22), (3, 1 << 22), (1024, 0)])
def test_cells_against_dense(spark, monkeypatch, block, entries):
    monkeypatch.setattr(co, "MATRIX_ENTRIES", entries)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 10, 5)) * (rng.random((4, 10, 5)) < 0.4)
    m = rng.normal(size=(6, 10)) * (rng.random((6, 10)) < 0.5)
    m[:, 9] = 0  # cells of this column meet nothing
    rows = [(f"s{a}", int(i), int(t), float(x[a, i, t])) for a, i, t in zip(*np.nonzero(x))] + [("s0", 50, 0, 9.0)]
    cells = spark.createDataFrame(rows, "subj string, i bigint, t bigint, w double")
    twice = matrix_of(spark, m / 2)
    got = {(r.subj, r.i, r.t): r.w for r in co.contract_cells(cells, twice.unionByName(twice), "i", block).collect()}
    y, met = np.einsum("ri,ait->art", m, x), np.einsum("ri,ait->art", m != 0, x != 0)
    want = {(f"s{a}", int(r), int(t)): y[a, r, t] for a, r, t in zip(*np.nonzero(met))}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-12)


def test_arrays_with_missing_channels(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(4, 4))
    v = rng.normal(size=(3, 4, 7))
    rows = [(t, c, v[t, c].tolist()) for t in range(3) for c in range(4) if (t, c) not in ((1, 2), (2, 0), (2, 1), (2, 2), (2, 3))] + [(2, 9, [1.0] * 7)]
    got = {(r.trial, r.ch): r.v for r in co.contract_arrays(spark.createDataFrame(rows, "trial int, ch int, v array<double>"), matrix_of(spark, m), ["trial"]).collect()}
    assert set(got) == {(t, c) for t in (0, 1) for c in range(4)}
    np.testing.assert_allclose(np.array([got[0, c] for c in range(4)]), m @ v[0])
    np.testing.assert_allclose(np.array([got[1, c] for c in range(4)]), m[:, [0, 1, 3]] @ v[1, [0, 1, 3]])
