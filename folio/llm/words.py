"""Vectorised words, word hashes and shingle sets over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.empty(size, np.uint64)
            out[0], done, step = 1, 1, base
            while done < size:  # doubles what is there
                out[done : 2 * done] = out[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            _POWERS[k] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a maximal run without white space inside one row."""
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[data], out=inside[1:-1])
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # also a row's first byte begins a word
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, everything else as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes of `width` consecutive words, ascending, one row after the other; and where each row begins.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    starts, ends, row = bounds(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = hashes(data, starts, ends)
    words = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(words)])
    last = len(h) - width + 1
    chain = np.zeros(max(last, 0), np.uint64)
    for k in range(width):
        chain = mixed(chain * _ODD + h[k : k + max(last, 0)] + np.uint64(k + 1))
    size = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint64)
    p = np.flatnonzero(row[: max(last, 0)] == row[width - 1 :]) if last > 0 else np.zeros(0, np.int64)
    out[at[row[p]] + p - begin[row[p]]] = chain[p]
    for few_words in range(1, width):
        few = np.flatnonzero(words == few_words)
        acc = np.zeros(len(few), np.uint64)
        for k in range(few_words):
            acc = mixed(acc * _ODD + h[begin[few] + k] + np.uint64(k + 1))
        out[at[few]] = mixed(acc + np.uint64(few_words))
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        out[a:b].sort()
    h, r = out, np.repeat(np.arange(n), size)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])
