"""Suffix sorting by a difference cover modulo 3, on arrays."""

from __future__ import annotations

MOST = 2_000_000  # symbols at once, so that three names fit 63 bits


def suffix_order(symbols):
    """Positions of ``symbols`` (1 or more each, below 2^21) in the order of their suffixes.

    The suffixes at positions 1 and 2 modulo 3 are sorted by their triples; if names repeat, the names, in text order,
    are sorted in the same way. The others follow from one symbol and the rank of the next sampled suffix, and are
    merged in by searching the two sampled classes, with which they share a sampled position one or two symbols on.
    """
    import numpy as np

    n = len(symbols)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: list(symbols[i:])), np.int64)
    t = np.concatenate((symbols, np.zeros(3, np.int64))).astype(np.int64)
    firsts = (n + 2) // 3
    sample = np.concatenate((3 * np.arange(firsts) + 1, 3 * np.arange(n // 3) + 2))
    triple = (t[sample] << 42) | (t[sample + 1] << 21) | t[sample + 2]
    by = np.argsort(triple)
    ranked = triple[by]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if not new.all():
        names = np.empty(len(sample), np.int64)
        names[by] = np.cumsum(new)
        by = suffix_order(names)
    ordered = sample[by]
    rank = np.zeros(n + 3, np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ordered = ordered[ordered < n]

    rest = 3 * np.arange(firsts)
    key = (t[rest] << 32) | rank[rest + 1]
    rest = rest[np.argsort(key)]
    one, two = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    below = np.searchsorted((t[one] << 32) | rank[one + 1], (t[rest] << 32) | rank[rest + 1])
    below += np.searchsorted((t[two] << 42) | (t[two + 1] << 21) | rank[two + 2], (t[rest] << 42) | (t[rest + 1] << 21) | rank[rest + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + below
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = ordered
    return out
