"""Burrows-Wheeler transforms of sets of symbol strings, merged without sorting suffixes again.

Every string ends with its own end mark, smaller than any symbol; equal suffixes follow the
order of their strings.
"""

from __future__ import annotations

import numpy as np

# code of the end mark; symbols are 1, 2, ...
END = 0


def transform(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, before): places of the suffixes in sorted order, and the symbol before each.

    ``symbols`` holds the strings one after the other, each closed by END; ``starts`` are
    their first places. Sorted by prefix doubling.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1]
    string_end = np.append(starts[1:], n)
    left = np.repeat(string_end, string_end - starts) - np.arange(n)  # symbols from here to the end of the string
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > step)
        following[inside] = rank[inside + step] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if step >= left.max(initial=1):
            break
    before = symbols[order - 1]
    before[np.isin(order, starts)] = END
    return order, before


def merge(befores: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of all shards in one order, and the symbols each shares with the one before it.

    Suffixes are numbered shard by shard in their sorted order; ``befores`` are the shards'
    transforms. The interleave starts shard after shard. One round sends every place to the
    place of the suffix one symbol longer (a stable sort by the symbol before), so after h
    rounds the suffixes interleave as their first h symbols tell. A border between groups
    that first appears in round h lies between suffixes with h - 1 common symbols. Stops
    after ``depth`` rounds, or when a round changes neither order nor borders; suffixes
    not told apart then have ``depth`` common symbols.
    """
    before = np.concatenate(befores)
    shard = np.repeat(np.arange(len(befores)), [len(b) for b in befores])
    n = len(before)
    order = np.arange(n)
    group = np.zeros(n, np.int64)
    common = np.full(n, depth, np.int64)
    common[:1] = 0
    if n == 0:
        return order, common
    for round_ in range(1, depth + 1):
        symbol = before[order]
        moved = np.argsort(symbol, kind="stable")
        symbols, groups = symbol[moved], group[moved]
        border = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (groups[1:] != groups[:-1])])
        # a string's end marks differ from each other, so what follows them is no longer told apart
        fresh = border & (common == depth)
        fresh[0] = False
        common[fresh] = round_ - 1
        owner = shard[order][moved]
        following = np.empty(n, np.int64)
        following[np.argsort(owner, kind="stable")] = np.arange(n)
        settled = not fresh.any() and np.array_equal(following, order)
        order, group = following, np.cumsum(border)
        if settled:
            break
    return order, common
