"""Hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of texts behind each other: hashes, byte bounds, and the first word of each text (one more at the end)."""

    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, edges: np.ndarray) -> Words:
    """``edges`` are the starts of the texts in ``data`` and its length."""
    black = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(_IS_WHITE[data], out=black[:-1])
    start = black[:-1].copy()
    start[1:] &= ~black[:-2] if len(data) else black[:0]
    inner = edges[(edges > 0) & (edges < len(data))]
    start[inner] = black[inner]
    begins = np.flatnonzero(start)
    # a word ends before white space, before the next text, or at the end
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[1:] = black[:-1] & ~black[1:]
    stop[inner] |= black[inner - 1]
    ends = np.flatnonzero(stop)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(data)), out=sums[1:])
    values = (sums[ends] - sums[begins]) * _powers(_INVERSE, len(data) + 1)[begins]
    return Words(mixed(values ^ (ends - begins).astype(np.uint64) * _STEP), begins, ends, np.searchsorted(begins, edges))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; only meaningful where so many follow in the same text."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _STEP + hashes[k:k + n]
    return mixed(out)


def whole(hashes: np.ndarray, first: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mixed(hashes + np.uint64(salt)) * _powers(_ODD, len(hashes)), out=sums[1:])
    values = (sums[first[1:]] - sums[first[:-1]]) * _powers(_INVERSE, len(hashes) + 1)[first[:-1]]
    return mixed(values ^ np.diff(first).astype(np.uint64) * _STEP)
