"""Words of many texts at once and hashes of runs of words, on NumPy arrays."""

from __future__ import annotations

import numpy as np

from lamina.llm.util import BLANK, mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANK)] = True
_powers: dict[int, np.ndarray] = {}
#: Bytes hashed at once, about.
STEP = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def prefix_hash(blob: np.ndarray) -> np.ndarray:
    """Sums p with p[j] - p[i] = sum of (byte + 1) * base**k over i <= k < j, modulo 2**64."""
    out = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(blob)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes begin <= k < end, the same wherever they stand."""
    return _finished((prefix[end] - prefix[begin]) * powers(_BACK, len(prefix))[begin], end - begin)


def _finished(moved: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix64(moved + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(blob: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of texts that lie end to end, and for each text the index of its first word
    (one more at the end)."""
    solid = ~_IS_BLANK[blob]
    begins, ends = solid.copy(), solid.copy()
    if len(blob):
        inner = off[(off > 0) & (off < len(blob))]
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, off)


def run_hashes(blob: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """range_hash() of the runs of bytes begin <= k < end, sorted by begin and not overlapping, in steps of about STEP bytes,
    so that memory doesn't follow the length of a text."""
    out = np.zeros(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        to = max(k + 1, int(np.searchsorted(end, begin[k] + STEP, "right")))
        a, b = int(begin[k]), int(end[to - 1])
        if b - a <= 2 * STEP:
            out[k:to] = range_hash(prefix_hash(blob[a:b]), begin[k:to] - a, end[k:to] - a)
        else:
            total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for x in range(a, b, STEP):
                part = prefix_hash(blob[x : min(x + STEP, b)])
                total += part[-1:] * scale
                scale = scale * powers(_BASE, STEP)[-1:] * _BASE
            out[k] = _finished(total, np.array([b - a]))[0]
        k = to
    return out


def word_hashes(blob: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and for each text the index of its first word (one more at the end)."""
    begin, end, first = words(blob, off)
    return run_hashes(blob, begin, end), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of size words; a text of fewer words, but one at least, has one run of them all."""
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    total = max(0, len(hashes) - size + 1)
    sums = np.zeros(total, np.uint64)
    for k in range(size):
        sums += hashes[k : k + total] * powers(_BASE, size + 1)[k + 1]
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[:total] == text[size - 1 : size - 1 + total] if total else np.zeros(0, bool)
    out = [(text[:total][whole], mix64(sums[whole]))]
    for t in short:
        own = hashes[first[t] : first[t + 1]]
        out.append((np.array([t]), mix64(np.array([np.sum(own * powers(_BASE, len(own) + 1)[1:]) + np.uint64(len(own))], np.uint64))))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
