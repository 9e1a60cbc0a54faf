"""Positions of a text chosen by content, so that equal passages are marked at equal places.

Every stretch of ``length`` bytes holds ``length - GRAM + 1`` runs of GRAM bytes; those of least hash are its anchors.
Two equal stretches have their anchors at the same places. What an anchor can say about stretches that hold it lies
within its context: the bytes from ``length - GRAM`` before it to ``length`` after its start, cut at the text's ends.
"""

from __future__ import annotations

import numpy as np

from lamina.llm.shingles import prefix_hash, range_hash
from lamina.llm.util import mix64

GRAM = 32
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of values[k : k + width] for every k that has as many, by doubling."""
    run, have = values, 1
    while have * 2 <= width:
        run = best(run[: len(run) - have], run[have:])
        have *= 2
    return best(run[: len(values) - width + 1], run[width - have : width - have + len(values) - width + 1])


def text_anchors(blob: np.ndarray, length: int, step: int):
    """What anchors() gives for one text, in parts: about step bytes at a time, with as many bytes around them as decide
    which of their runs are anchors and what stands around these, so that memory doesn't follow the text."""
    for core in range(0, len(blob), step):
        a, b = max(0, core - length), min(len(blob), core + step + length)
        text, at, gram, context, begin, end = anchors(blob[a:b], np.array([0, b - a]), length)
        own = (at + a >= core) & (at + a < core + step)
        yield text[own], at[own] + a, gram[own], context[own], begin[own] + a, end[own] + a


def anchors(blob: np.ndarray, off: np.ndarray, length: int):
    """(text, position in the text, hash of the run, hash of the context, begin and end of the context in the text) of
    every anchor of texts that lie end to end."""
    n, width = len(blob), length - GRAM + 1
    if n < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    prefix = prefix_hash(blob)
    at = np.arange(n - GRAM + 1)
    grams = range_hash(prefix, at, at + GRAM)
    sizes = np.diff(off)
    # Stretches must lie within one text: those that begin in the last length - 1 bytes of a text don't.
    inside = np.ones(n - length + 1, bool)
    for k in range(len(sizes)):
        a, b = max(off[k], off[k + 1] - length + 1), min(off[k + 1], len(inside))
        inside[a:b] = False
    least = _sliding(grams, width, np.minimum)
    least[~inside] = 0
    # A run is an anchor if it is the least of some stretch that holds it.
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((_sliding(around, width, np.maximum) == grams) & (grams > 0))
    text = np.searchsorted(off, chosen, "right") - 1
    begin, end = np.maximum(chosen - (length - GRAM), off[text]), np.minimum(chosen + length, off[text + 1])
    context = mix64(range_hash(prefix, begin, end) ^ mix64(((chosen - begin).astype(np.uint64) << np.uint64(20)) + (end - chosen).astype(np.uint64)))
    base = off[text]
    return text, chosen - base, grams[chosen], context, begin - base, end - base
