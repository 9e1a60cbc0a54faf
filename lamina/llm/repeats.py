"""Repeats from a common-prefix interval tree over a sparse suffix array.

``maximal_groups`` takes the suffixes that begin at one kind of anchor, each with the text before it. It sorts the
suffixes (the suffix array), takes the common prefix of neighbours (the LCP array) and scans them with a stack: every
interval of suffixes that share a prefix, but no longer one, is a node of the interval tree. In each node the texts
before the anchor are sorted backwards and scanned the same way: a node of that second tree is a set that shares a
left extension but differs beyond it, or meets a text's end (left diversity). A pair of nodes is a maximal repeat, with
all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(keys: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(depth, begin, end) of every set keys[begin:end] of a sorted list, two members at least, that shares a prefix of
    depth and that no neighbour extends."""
    stack: list[tuple[int, int]] = []
    for k in range(1, len(keys) + 1):
        depth = common(keys[k - 1], keys[k]) if k < len(keys) else -1
        begin = k - 1
        while stack and stack[-1][0] > depth:
            top, begin = stack.pop()
            yield top, begin, k
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def maximal_groups(right: list[bytes], left: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left extension, right extension, members) of every maximal repeat of at least length bytes around the anchor.
    right are the texts from the anchor on, left those before it; members are indexes into both."""
    order = sorted(range(len(right)), key=right.__getitem__)
    back = [text[::-1] for text in left]
    for ahead, begin, end in intervals([right[k] for k in order]):
        need = length - ahead
        members = [k for k in order[begin:end] if len(back[k]) >= need]
        if len(members) < 2:
            continue
        members.sort(key=back.__getitem__)
        for behind, first, last in intervals([back[k] for k in members]):
            if behind >= need:
                yield behind, ahead, members[first:last]
