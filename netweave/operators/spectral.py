"""Spectral cuts of many small graphs at once: one stacked eigendecomposition per graph size.

Arrays are stacks (graphs x nodes x nodes) of symmetric non-negative adjacency matrices. Every rule is a mask
over the stack, so a batch costs a fixed number of array operations.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-12
#: eigenvalues of a normalised Laplacian up to this count as zero (fixed value of the method)
ZERO_EIGENVALUE = 1e-10


def by_size(subsets: list[np.ndarray]):
    """Positions of the subsets of each size, so equal ones can be stacked."""
    sizes = np.array([len(s) for s in subsets])
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def reachable(stack: np.ndarray) -> np.ndarray:
    """Nodes (graphs x nodes) in the component of each graph's first node that has an edge."""
    linked = stack > 0
    seen = np.zeros(stack.shape[:2], dtype=bool)
    seen[np.arange(len(stack)), linked.any(axis=2).argmax(axis=1)] = True
    while True:
        more = seen | (linked & seen[:, :, None]).any(axis=1)
        if (more == seen).all():
            return seen
        seen = more


def widest_gap(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut each row of values at its widest gap: (True on the lower side, width of the gap)."""
    order = np.argsort(values, axis=1, kind="stable")
    gaps = np.diff(np.take_along_axis(values, order, axis=1), axis=1)
    rank = np.argsort(order, axis=1, kind="stable")
    return rank <= gaps.argmax(axis=1)[:, None], gaps.max(axis=1)


def gap_parts(stack: np.ndarray, on_disconnected: str = "components") -> np.ndarray:
    """Two parts (1, 2) of each graph by the widest gap in the first eigenvector with a non-zero eigenvalue of
    the normalised Laplacian.

    A disconnected graph has no such vector of its own: ``"components"`` takes the first component against the
    rest, ``"spectral"`` takes a vector all the same, from a degenerate space. Graphs without a usable
    gap are halved by node order; graphs of at most two nodes fall into single nodes.
    """
    count, n = stack.shape[:2]
    halves = np.where(np.arange(n) < n // 2, 1, 2)
    if n <= 2:
        return np.tile(np.arange(1, n + 1), (count, 1))
    degree = stack.sum(axis=2)
    live = degree > EPS
    scale = np.where(live, 1 / np.sqrt(np.where(live, degree, 1.0)), 0.0)
    values, vectors = np.linalg.eigh(np.eye(n) - scale[:, :, None] * stack * scale[:, None, :])
    usable = values > ZERO_EIGENVALUE
    vector = np.take_along_axis(vectors, usable.argmax(axis=1)[:, None, None], axis=2)[:, :, 0]
    lower, width = widest_gap(vector)
    labels = np.where(lower, 1, 2)
    labels[~usable.any(axis=1) | (width <= EPS)] = halves
    if on_disconnected == "components":
        first = reachable(stack)
        apart = (live & ~first).any(axis=1)
        labels[apart] = np.where(first[apart], 1, 2)
    labels[live.sum(axis=1) < 2] = halves
    return labels


def sign_parts(stack: np.ndarray) -> np.ndarray:
    """Two parts (0, 1) of each graph by the second eigenvector of the Laplacian: above zero, else above its
    median, else its upper half by rank; whichever first leaves no part empty. Graphs without edges stay whole."""
    count, n = stack.shape[:2]
    if n < 2:
        return np.zeros((count, n), dtype=int)
    laplacian = stack.sum(axis=2)[:, :, None] * np.eye(n) - stack
    vector = np.linalg.eigh(laplacian)[1][:, :, 1]
    rank = np.argsort(np.argsort(vector, axis=1), axis=1)
    cuts = np.stack([vector > 0, vector > np.median(vector, axis=1, keepdims=True), rank >= n // 2])
    proper = cuts.any(axis=2) & ~cuts.all(axis=2)
    chosen = cuts[proper.argmax(axis=0), np.arange(count)].astype(int)
    chosen[np.isclose(stack, 0).all(axis=(1, 2))] = 0
    return chosen


def cut_gain(stack: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Modularity of a two-part cut of each graph; NaN without edges."""
    member = np.stack([side == 0, side == 1], axis=2).astype(float)
    total = stack.sum(axis=(1, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.einsum("gik,gij,gjk->gk", member, stack, member, optimize=True) / total[:, None]
        share = np.einsum("gij,gik->gk", stack, member, optimize=True) / total[:, None]
        return (inside - share**2).sum(axis=1)


def split_trees(stack: np.ndarray, min_size: int = 3, min_gain: float = 1e-4) -> np.ndarray:
    """Split every graph by sign cuts as long as a part's own cut gains modularity; labels (graphs x nodes).

    A cut depends on its part alone, so all parts of all graphs that are still open are cut in one pass per
    level; a part stays whole if its cut gains at most ``min_gain`` or leaves fewer than ``min_size`` nodes.
    """
    labels = np.zeros(stack.shape[:2], dtype=int)
    open_parts = [(g, np.arange(stack.shape[1])) for g in range(len(stack))]
    fresh = 1
    while open_parts := [(g, nodes) for g, nodes in open_parts if len(nodes) >= 2 * min_size]:
        grown = []
        for _, at in by_size([nodes for _, nodes in open_parts]):
            graphs, nodes = (np.array(x) for x in zip(*[open_parts[k] for k in at]))
            parts = stack[graphs[:, None, None], nodes[:, :, None], nodes[:, None, :]]
            side = sign_parts(parts)
            smaller = np.minimum(side.sum(axis=1), (1 - side).sum(axis=1))
            good = (smaller >= max(min_size, 1)) & (np.nan_to_num(cut_gain(parts, side), nan=-np.inf) > min_gain)
            for k in np.flatnonzero(good):
                halves = nodes[k][side[k] == 0], nodes[k][side[k] == 1]
                labels[graphs[k], halves[1]] = fresh
                fresh += 1
                grown += [(graphs[k], half) for half in halves]
        open_parts = grown
    return labels
