"""Sorted runs of suffixes: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Run:
    """Suffixes in order with what belongs to each. ``left`` is the text before a suffix, backwards."""

    right: list[bytes] = field(default_factory=list)
    lcp: list[int] = field(default_factory=list)
    left: list[bytes] = field(default_factory=list)
    #: Columns doc, row, place and low; see suffix_dedup.
    about: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))
    #: Ranges that were settled while the run was made: columns row, start, end.
    settled: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of a and b, of which known bytes are equal for sure."""
    end = min(len(a), len(b))
    differ = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (differ.bit_length() + 7) // 8


def pack(run: Run) -> bytes:
    """Front-coded: of each suffix only what it doesn't share with the one before."""
    rest = [s[n:] for s, n in zip(run.right, run.lcp, strict=True)]
    sizes = [[*map(len, rest)], run.lcp, [*map(len, run.left)]]
    head = np.array([len(run.right), len(run.settled), sum(sizes[0])], np.int64)
    parts = (head, *(np.array(s, np.uint8) for s in sizes), run.about, run.settled.astype(np.int64))
    return b"".join([*(np.ascontiguousarray(p).tobytes() for p in parts), *rest, *run.left])


def unpack(data: bytes) -> Run:
    n, n_settled, n_rest = np.frombuffer(data, np.int64, 3).tolist()
    at, sizes = 24, []
    for _ in range(3):
        sizes.append(np.frombuffer(data, np.uint8, n, at).tolist())
        at += n
    about = np.frombuffer(data, np.uint8, 32 * n, at).copy().view(np.int64).reshape(n, 4)
    at += 32 * n
    settled = np.frombuffer(data, np.uint8, 24 * n_settled, at).copy().view(np.int64).reshape(n_settled, 3)
    at += 24 * n_settled
    right, left, before, other = [], [], b"", at + n_rest
    for rest, lcp, length in zip(*sizes, strict=True):
        before = before[:lcp] + data[at : at + rest]
        right.append(before)
        at += rest
        left.append(data[other : other + length])
        other += length
    return Run(right, sizes[1], left, about, settled)


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index in it, common prefix with the suffix before) of all suffixes in order.

    runs: the suffixes of each and their common prefixes with the one before. A loser keeps its
    common prefix with the winner that beat it. Whoever shares more with the last output is smaller;
    only if both share as much are bytes compared, from there on.
    """
    k = len(runs)
    at, share = [0] * k, [0] * k
    now: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
    share = [0 if s is not None else -1 for s in now]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); share[loser] becomes what it has in common with the winner."""
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        if share[a] < 0:
            return a, b
        x, y = now[a], now[b]
        n = common_prefix(x, y, share[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    best = build(1) if k > 1 else 0
    while k and share[best] >= 0:
        yield best, at[best], share[best]
        at[best] += 1
        own = runs[best]
        if at[best] < len(own[0]):
            now[best], share[best] = own[0][at[best]], own[1][at[best]]
        else:
            now[best], share[best] = None, -1
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
