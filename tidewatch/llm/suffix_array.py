"""Suffix array of a byte string by the difference-cover algorithm (modulus 3), in numpy."""

from __future__ import annotations

import numpy as np


def _names(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order of the triples at ``at``, name of each in that order, number of names)."""
    a, b, c = s[at], s[at + 1], s[at + 2]
    bits = int(s.max()).bit_length()
    if 3 * bits < 63:  # the triple as one number
        key = a << 2 * bits | b << bits | c
    else:
        _, pair = np.unique(a << bits | b, return_inverse=True)
        key = pair << bits | c
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    names = np.cumsum(new)
    return order, names, int(names[-1])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order; symbols are integers >= 1."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    # sampled suffixes: positions 1 and 2 modulo 3 (position n as well if it ends the first group)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, names, distinct = _names(s, sample)
    if distinct == len(sample):
        ordered = sample[order]
    else:  # recurse on the names, first group then second
        reduced = np.empty(len(sample), np.int64)
        reduced[order] = names
        ordered = sample[suffix_array(reduced)]
    rank = np.zeros(n + 3, np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ordered = ordered[ordered < n]
    # the rest by (first symbol, rank of what follows), then merged with the sampled ones
    rest = np.arange(0, n, 3)
    width = len(sample) + 2
    rest = rest[np.argsort(s[rest] * width + rank[rest + 1])]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before1 = np.searchsorted(s[first] * width + rank[first + 1], s[rest] * width + rank[rest + 1])
    symbols = int(s.max()) + 1
    if symbols * symbols * width < 1 << 62:
        def key(i):
            return (s[i] * symbols + s[i + 1]) * width + rank[i + 2]
        before2 = np.searchsorted(key(second), key(rest))
    else:  # names of the pairs keep the key in 64 bits
        pair = np.concatenate([s[second], s[rest]]) * symbols + np.concatenate([s[second + 1], s[rest + 1]])
        _, dense = np.unique(pair, return_inverse=True)
        key2 = dense[:len(second)] * width + rank[second + 2]
        before2 = np.searchsorted(key2, dense[len(second):] * width + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before1 + before2
    out[at] = rest
    taken = np.zeros(n, bool)
    taken[at] = True
    out[~taken] = ordered
    return out
