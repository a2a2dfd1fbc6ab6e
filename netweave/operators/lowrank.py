"""Low-rank denoising by projecting every frame onto the leading mode subspaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from netweave.functions.linalg import gram_spectrum
from netweave.operators.frames import EDGE_ROWS, collect_grams, edge_rows, frame_grams, map_frames
from netweave.shape import TensorShape


def mode_bases(frames: DataFrame, shape: TensorShape, ranks: tuple[int | None, int | None]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Leading (subject, node) singular vectors per condition; ``None`` keeps all.

    Left singular vectors of an unfolding are eigenvectors of its Gram matrix, which Spark
    sums over the frames; only those small matrices are decomposed here.
    """
    grams = collect_grams(frame_grams(frames, shape), shape)
    out = {}
    for cond in shape.conds:
        pair = []
        for mode, rank in zip(("subject", "node"), ranks):
            u, _ = gram_spectrum(grams[(cond, mode)])
            pair.append(u if rank is None else u[:, :max(1, min(rank, u.shape[1]))])
        out[cond] = tuple(pair)
    return out


def hosvd_low_rank(frames: DataFrame, shape: TensorShape, ranks: tuple[int | None, int | None] = (10, 10)) -> DataFrame:
    """Project subjects and nodes (time untouched); symmetric, zero diagonal. Long edges."""
    projectors = {c: (us @ us.T, un @ un.T) for c, (us, un) in mode_bases(frames, shape, ranks).items()}

    def project(cond: str, t: int, graphs: np.ndarray):
        ps, pn = projectors[cond]
        low = np.tensordot(ps, pn @ graphs @ pn, axes=(1, 0))
        return edge_rows(cond, t, shape, w=(low + low.transpose(0, 2, 1)) / 2.0)

    return map_frames(frames, shape, project, EDGE_ROWS + ", w double")
