"""Trial matching against the plain sequential rule."""

import random

import numpy as np
import pytest

from netweave.operators import matching as mt
from netweave.operators import signals as sg
from netweave.operators.ordered import running


def sequential(events):
    """[(event_id, match_id)] of one subject's (sample, event_id, code) rows in order."""
    events = sorted(events)
    wrong = [e for e in events if e[2] == "Incorrect"]
    free = [e for e in events if e[2] == "Correct"]
    out = []
    for sample, event_id, _ in wrong:
        if not free:
            break
        k = int(np.argmin([abs(f[0] - sample) for f in free]))
        out.append((event_id, free.pop(k)[1]))
    return sorted(out)


def simulated(seed, subjects=12):
    rng = random.Random(seed)
    rows = []
    for subj in range(subjects):
        n = rng.randint(1, 60)
        share = rng.choice([0.0, 0.05, 0.2, 0.5, 0.8, 1.0])
        span = rng.choice([20, 500, 400_000])
        for _ in range(n):
            code = "Incorrect" if rng.random() < share else "Correct"
            rows.append((subj, rng.randint(0, span), len(rows), code))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_greedy_matching_is_the_sequential_result(spark, seed):
    rows = simulated(seed)
    events = spark.createDataFrame(rows, "subj bigint, sample bigint, event_id bigint, code string")
    got = {}
    for r in mt.balance_trials(events).collect():
        got.setdefault(r.subj, []).append((r.event_id, r.match_id))
    for subj in {r[0] for r in rows}:
        assert sorted(got.get(subj, [])) == sequential([r[1:] for r in rows if r[0] == subj])


def test_stretches_are_short_when_errors_are_rare(spark):
    """Independent stretches, not whole subjects, are matched sequentially."""
    rows = [(0, 10 * k, k, "Incorrect" if k % 20 == 0 else "Correct") for k in range(4000)]
    events = spark.createDataFrame(rows, "subj bigint, sample bigint, event_id bigint, code string")
    pairs = mt.balance_trials(events).collect()
    assert len(pairs) == 200
    assert all(abs(p.sample - p.match_sample) == 10 for p in pairs)


def test_balanced_events_lists_both_sides(spark):
    rows = [(1, 0, 0, "Correct"), (1, 5, 1, "Incorrect"), (1, 6, 2, "Correct"), (2, 1, 3, "Correct")]
    events = spark.createDataFrame(rows, "subj bigint, sample bigint, event_id bigint, code string")
    both = mt.balanced_events(mt.balance_trials(events)).collect()
    assert sorted((r.event_id, r.code) for r in both) == [(1, "Incorrect"), (2, "Correct")]


def test_running_values_match_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.randint(-5, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    from pyspark.sql import functions as F

    v = F.col("v")
    out = running(df, ["k"], ["o"], F.floor(F.col("o") / 17), {
        "s": (v, "sum"), "m": (v, "min"), "b": (v, "max", "back"),
    }).toPandas().sort_values(["k", "o"])
    for _, g in out.groupby("k"):
        assert (g["s"] == g["v"].cumsum()).all()
        assert (g["m"] == g["v"].cummin()).all()
        assert (g["b"] == g["v"][::-1].cummax()[::-1]).all()


def test_epochs_of_events_that_share_positions(spark):
    """Two hundred events at three positions, one at the edge, keep their further column; a trial named by two events has no epoch."""
    signal = spark.createDataFrame([(1, ch, t, 10 * t + k) for k, ch in enumerate("ab") for t in range(8)], "subj bigint, ch string, sample bigint, v bigint")
    events = [(1, (3, 4, 7)[k % 3], k, "x" if k % 2 else "y") for k in range(200)] + [(1, 4, 5, "x")]
    cut = sg.cut_epochs(signal, spark.createDataFrame(events, "subj bigint, sample bigint, trial bigint, code string"), 2, 1)
    got = sorted((r.trial, r.ch, r.v, r.code) for r in cut.collect())
    want = [(n, ch, [10 * t + k for t in range(at - 2, at + 2)], code) for _, at, n, code in events[:200] for k, ch in enumerate("ab") if at != 7 and n != 5]
    assert got == want
