"""Small dense helpers used inside tasks and on Gram matrices (never on tensors)."""

from __future__ import annotations

import numpy as np


def gram_spectrum(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and singular values of X from X X', largest first."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2.0)
    return vectors[:, ::-1], np.sqrt(np.clip(values[::-1], 0.0, None))


def complement(basis: np.ndarray) -> np.ndarray:
    """Projector onto what the basis does not span."""
    return np.eye(basis.shape[0]) - basis @ basis.T


def orthonormal(columns: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(columns)
    return q[:, np.abs(np.diag(r)) > np.finfo(float).eps]


def projector_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Frobenius distance of two projectors over the root of the larger rank."""
    rank = max(a.shape[1], b.shape[1], 1)
    return float(np.linalg.norm(a @ a.T - b @ b.T) / np.sqrt(rank))


def flat_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def square(vec: np.ndarray, n: int) -> np.ndarray:
    """Packed upper triangles (..., n(n-1)/2) -> symmetric matrices (..., n, n)."""
    r, c = flat_pairs(n)
    out = np.zeros(vec.shape[:-1] + (n, n))
    out[..., r, c] = vec
    out[..., c, r] = vec
    return out
