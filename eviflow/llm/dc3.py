"""Suffix order by difference cover sampling, in numpy.

Suffixes at positions 1 and 2 modulo 3 are named by their first three symbols in sorted order; the names form a shorter
text whose suffix order is found the same way; the remaining suffixes are sorted by (symbol, rank of the next suffix)
and merged in by binary search. Only the first ``depth`` symbols have to be told apart, so the recursion ends when the
names cover them: suffixes that agree in ``depth`` symbols stand side by side, in any order.
"""

from __future__ import annotations

import numpy as np


def names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the rows of equally long columns of small non-negative numbers, and the number of ranks."""
    key, top = columns[0].astype(np.uint64), int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if top * width >= 1 << 63:
            distinct, key = np.unique(key, return_inverse=True)
            key, top = key.astype(np.uint64), len(distinct)
        key, top = key * np.uint64(width) + column.astype(np.uint64), top * width
    if top <= max(1 << 16, 4 * len(key)):  # few possible values: a table instead of a sort
        seen = np.zeros(top, dtype=bool)
        seen[key] = True
        table = np.cumsum(seen, dtype=np.int64)
        return table[key], int(table[-1])
    distinct, inverse = np.unique(key, return_inverse=True)
    return inverse + 1, len(distinct)


def ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank (from 1) of every suffix of a text of positive numbers; suffixes equal in ``depth`` symbols have near ranks."""
    n = len(text)
    if n < 3:
        padded = np.r_[text, np.zeros(3, dtype=np.int64)]
        return names(padded[:n], padded[1 : n + 1], padded[2 : n + 2])[0]
    s = np.zeros(n + 4, dtype=np.int64)
    s[:n] = text
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a place past the end, where the last remaining suffix needs it
    two = np.arange(2, n, 3)
    sample = np.r_[one, two]
    name, distinct = names(s[sample], s[sample + 1], s[sample + 2])
    if distinct < len(sample) and depth > 3:
        name = ranks(name, -(-depth // 3))
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample] = name
    rest = np.arange(0, n, 3)
    wide = int(name.max(initial=0)) + 1
    symbols = int(s.max()) + 1
    key = s * wide  # (symbol, rank of the next suffix)
    key[: n + 3] += rank[1 : n + 4]
    own = key[rest]
    own_sorted = np.sort(own)
    out = np.zeros(n + 4, dtype=np.int64)
    key_one, key_two = np.sort(key[one]), None
    out[one] = np.searchsorted(own_sorted, key[one], "left")
    out[rest] = np.searchsorted(own_sorted, own, "left") + np.searchsorted(key_one, own, "left")
    # Suffixes at 2 modulo 3 and the rest: both have a sampled suffix two places on.
    if symbols * symbols * wide < 1 << 62:
        key = s * (symbols * wide)
        key[: n + 3] += s[1 : n + 4] * wide
        key[: n + 2] += rank[2 : n + 4]
    else:
        pair = names(s[: n + 2], s[1 : n + 3])[0]
        key = np.zeros(n + 4, dtype=np.int64)
        key[: n + 2] = pair * wide + rank[2 : n + 4]
    key_rest, key_two = np.sort(key[rest]), np.sort(key[two])
    out[two] = np.searchsorted(key_rest, key[two], "left")
    out[rest] += np.searchsorted(key_two, key[rest], "left")
    # Sampled suffixes among themselves: by their names.
    by_name = np.sort(name)
    out[sample] += np.searchsorted(by_name, name, "left")
    return out[:n] + 1
