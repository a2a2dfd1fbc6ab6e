"""Words of many texts at once: spans in a byte buffer and 64-bit hashes, as NumPy array operations."""

from __future__ import annotations

import numpy as np

#: bytes that end a word: space and \t \n \v \f \r
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def not_space() -> np.ndarray:
    """Word bytes: all but white space."""
    out = np.ones(256, dtype=bool)
    out[list(SPACE_BYTES)] = False
    return out


def letters() -> np.ndarray:
    """Word bytes: a-z, A-Z and every byte of a character beyond ASCII."""
    out = np.zeros(256, dtype=bool)
    out[65:91] = out[97:123] = out[128:] = True
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all bits (a 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed_words(texts: list[str | None], word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, where each text's words end). A-Z count as a-z; null is empty.

    Hashes depend on the word's bytes only; two different words agree with probability 2^-64.
    """
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    buffer = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    inside = word_bytes[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.searchsorted(starts, text_ends)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    sizes = ends - starts
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    powers = np.full(int(sizes.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat(_BYTE[buffer[inside]] * powers[place], firsts)), counts
