"""Sampled suffixes of byte texts: winnowed anchors and the windows that choose them.

A window is a string of ``length`` bytes. Of the grams of ``GRAM`` bytes in it, the one with
the smallest hash (the rightmost of equal ones) is its anchor, so equal windows have their
anchors at the same place. Consecutive windows with one anchor form a run; every window of a
text is in exactly one run.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POSITION_BITS = 24
_POSITIONS = np.uint64((1 << _POSITION_BITS) - 1)

# Bytes hashed together; hashes don't depend on it.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    n = CHUNK + 1
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Hashes:
    """Hashes of any slices of one byte string of at most CHUNK bytes."""

    def __init__(self, data: np.ndarray) -> None:
        up, self._down = _powers()
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        """Hashes of all slices of one size, by start."""
        n = len(self._sums) - size
        return _mixed((self._sums[size:] - self._sums[:n]) * self._down[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by start."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, gram hash, run hash) of one text.

    The run hash covers all bytes of the run's windows and where the anchor stands.
    """
    if len(data) < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    found = []
    # Windows are dealt out to chunks that overlap by all but one byte of a window.
    step = CHUNK - length + 1
    for at in range(0, len(data) - length + 1, step):
        found.append(_chunk_runs(np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at), length, gram, at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _chunk_runs(data: np.ndarray, length: int, gram: int, at: int) -> tuple[np.ndarray, ...]:
    hashes = Hashes(data)
    grams = hashes.fixed(gram)
    # Ranked by hash; of equal ones the later comes first.
    ranked = (grams & ~_POSITIONS) | (_POSITIONS - np.arange(len(grams), dtype=np.uint64))
    anchor = (_POSITIONS - (sliding_minimum(ranked, length - gram + 1) & _POSITIONS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    place = anchor[first]
    whole = hashes.of(first, last + length)
    with np.errstate(over="ignore"):
        whole += (place - first).astype(np.uint64) * BASE + (last - first).astype(np.uint64)
    return first + at, last - first + 1, grams[place], _mixed(whole)
