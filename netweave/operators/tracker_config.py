"""Settings of the recursive tracker, by concern; the defaults suit 2049 frames at 1024 Hz."""

from __future__ import annotations

from dataclasses import dataclass, field

INF = float("inf")


def _check(settings, ranges: dict[str, tuple[float, float]], words: dict[str, tuple[str, ...]] | None = None) -> None:
    """Fail on a number outside its closed range (None passes) or a word not among the allowed ones."""
    for name, (low, high) in ranges.items():
        value = getattr(settings, name)
        if value is not None and not low <= value <= high:
            raise ValueError(f"{type(settings).__name__}.{name} must lie in [{low}, {high}]")
    for name, allowed in (words or {}).items():
        if getattr(settings, name) not in allowed:
            raise ValueError(f"{type(settings).__name__}.{name} must be one of {allowed}")


@dataclass(frozen=True)
class Subspace:
    """Frames that start the bases, frames between updates, and which directions a basis holds."""

    train: int = 80
    block: int = 64
    floor: float = 0.11  # least singular value, relative to the first in training unless ``relative`` is off
    relative: bool = True
    node_cap: int | None = 15
    subject_cap: int | None = 10

    def __post_init__(self):
        _check(self, {"train": (1, INF), "block": (1, INF), "floor": (0, INF), "node_cap": (1, INF), "subject_cap": (1, INF)})


@dataclass(frozen=True)
class Recovery:
    """How the sparse part is found: greedy cells, proximal descent, or one shrinkage."""

    solver: str = "omp"
    cells: int = 8  # omp: most cells, and the relative residual that suffices
    residual: float = 1e-3
    level: float = 3.0  # shrinkage: a factor of a robust scale, a share of the largest entry, or a plain number
    level_rule: str = "mad"
    penalty: float | None = None  # fista: overrides the level
    budget: float | None = None  # fista: residual that suffices, relative to the data if ``budget_relative``
    budget_relative: bool = False
    steps: int = 20
    settled: float = 1e-4
    step: float = 1.0

    def __post_init__(self):
        _check(
            self,
            {"cells": (1, INF), "residual": (0, INF), "penalty": (0, INF), "budget": (0, INF), "steps": (1, INF), "settled": (0, INF), "step": (1e-300, INF)},
            {"solver": ("omp", "fista", "proxy"), "level_rule": ("mad", "relative", "absolute")},
        )


@dataclass(frozen=True)
class Change:
    """When an update counts as a change, and which frame of its block it is reported at."""

    rule: str = "directions"  # a direction came or went, or a subspace moved by ``distance``
    distance: float = 0.15
    modes: tuple[int, ...] | None = None
    position: str = "midpoint"
    weights: tuple[float, float, float] = (1.0, 1.0, 0.4)

    def __post_init__(self):
        _check(self, {"distance": (0, INF)}, {"rule": ("directions", "distance"), "position": ("start", "midpoint", "end")})
        if not set(self.modes or ()) <= {0, 1, 2}:
            raise ValueError("Change.modes holds 0, 1 and 2 only")

    def reported(self, start: int, end: int) -> int:
        return {"start": start, "midpoint": round((start + end) / 2), "end": end}[self.position]


@dataclass(frozen=True)
class Selection:
    """Which changes become change points. Without a ``rate`` (frames a second) a block is the unit of time."""

    rate: float | None = 1024.0
    apart_ms: float = 50.0
    smooth_ms: float = 25.0
    threshold: str = "mad"
    k: float = 3.0
    window_ms: tuple[float, float] | None = (-150.0, 150.0)
    anchor_ms: float = 50.0

    def __post_init__(self):
        _check(self, {"rate": (1e-300, INF), "apart_ms": (0, INF), "smooth_ms": (0, INF), "k": (0, INF)}, {"threshold": ("mad", "percentile")})
        if self.window_ms and self.window_ms[0] > self.window_ms[1]:
            raise ValueError("Selection.window_ms starts after its end")

    def frames(self, ms: float, block: int) -> float:
        """A time in frames, or a block where there is no clock."""
        return float(block) if self.rate is None else ms * self.rate / 1000.0

    def apart(self, block: int) -> int:
        return max(1, round(self.frames(self.apart_ms, block)))

    def smoothed_updates(self, block: int) -> int:
        """Updates under the smoothing window; 1 smooths nothing."""
        return 1 if self.rate is None else max(1, round(self.frames(self.smooth_ms, block) / block))


@dataclass(frozen=True)
class TrackerConfig:
    subspace: Subspace = field(default_factory=Subspace)
    recovery: Recovery = field(default_factory=Recovery)
    change: Change = field(default_factory=Change)
    selection: Selection = field(default_factory=Selection)
