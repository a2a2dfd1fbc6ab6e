"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_zero(c: Column) -> Column:
    """NaN, infinities and NULL are data errors and count as 0."""
    inf = F.lit(float("inf"))
    bad = c.isNull() | F.isnan(c) | (c == inf) | (c == -inf)
    return F.when(bad, F.lit(0.0)).otherwise(c)


def soft_threshold(c: Column, tau: float | Column) -> Column:
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    return F.signum(c) * F.greatest(F.abs(c) - tau, F.lit(0.0))


def ms_linspace(t: Column, n_frames: int, lo: float, hi: float) -> Column:
    """Clock spreading the frames evenly over [lo, hi]."""
    return F.lit(lo) + t * F.lit((hi - lo) / (n_frames - 1))


def ms_from_start(t: Column, start_ms: float, rate_hz: float) -> Column:
    """Clock counting sample periods from the epoch start."""
    return F.lit(start_ms) + t * F.lit(1000.0) / F.lit(float(rate_hz))


def ms_centred(t: Column, n_frames: int, rate_hz: float) -> Column:
    """Clock whose zero is the middle frame."""
    return (t - F.lit((n_frames - 1) / 2.0)) * F.lit(1000.0) / F.lit(float(rate_hz))


def frame_half_even(ms: Column, start_ms: float, rate_hz: float) -> Column:
    """Frame nearest to a time by half-even rounding."""
    return F.rint((ms - F.lit(start_ms)) * F.lit(float(rate_hz)) / F.lit(1000.0)).cast("bigint")


def frame_nearest(ms: Column, n_frames: int, lo: float, hi: float) -> Column:
    """Frame of the linspace clock closest to ``ms``; a tie goes to the earlier frame."""
    step = (hi - lo) / (n_frames - 1)
    k = F.floor((ms - F.lit(lo)) / F.lit(step))
    k = F.least(F.greatest(k, F.lit(0)), F.lit(n_frames - 1))
    up = F.least(k + 1, F.lit(n_frames - 1))
    near = F.abs(ms_linspace(k, n_frames, lo, hi) - ms)
    far = F.abs(ms_linspace(up, n_frames, lo, hi) - ms)
    return F.when(far < near, up).otherwise(k).cast("bigint")


def edge_fade(t: Column, n_frames: int, share: float = 0.1) -> Column:
    """Weight ramping linearly 0..1 over the first and 1..0 over the last ``share`` of frames."""
    m = int(n_frames * share)
    if m < 1:
        return F.lit(1.0)
    span = F.lit(float(max(m - 1, 1)))
    rise = t / span
    fall = (F.lit(1.0) - (t - F.lit(n_frames - m)) / span) if m > 1 else F.lit(1.0)
    return F.when(t >= n_frames - m, fall).when(t < m, rise).otherwise(F.lit(1.0))


def parse_int_list(text: Column) -> Column:
    """'10, none,3' -> [10, NULL, 3]; 'none', 'null' and '-' mean no limit."""
    items = F.transform(F.split(text, ","), lambda s: F.lower(F.trim(s)))
    return F.transform(items, lambda s: F.when(s.isin("none", "null", "-"), None).otherwise(s.cast("int")))
