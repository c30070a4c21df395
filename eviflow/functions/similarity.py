"""String similarity: block-matching ratio as Arrow UDFs, everything around it native."""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eviflow.functions import text as tx


@F.pandas_udf(T.DoubleType())
def block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of characters in matching blocks."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _score(left: pd.Series, right: pd.Series, overlap: pd.Series) -> pd.Series:
    out = []
    for a, b, j in zip(left, right, overlap):
        r = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        out.append(round(max(r, 0.55 * j + 0.45 * r), 3) if a and b else 0.0)
    return pd.Series(out, dtype="float64")


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard overlap of the token sets of two normalised names; 0 when both are empty."""
    x, y = tx.words(a), tx.words(b)
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")),
        F.lit(0.0),
    )


def name_score(a: Column | str, b: Column | str) -> Column:
    """Match score of two normalised names, 0 to 1: block ratio of the token-sorted names, or that mixed with token
    overlap when higher."""
    a, b = tx._c(a), tx._c(b)
    return _score(tx.token_sort(a), tx.token_sort(b), token_jaccard(a, b))


@F.pandas_udf(T.IntegerType())
def best_match_index(candidates: pd.Series, phrase: pd.Series) -> pd.Series:
    """Position of the first candidate most similar to the phrase; null rows are passed over."""

    def best(options, wanted):
        if options is None or wanted is None:
            return None
        top, score = 0, -1.0
        for i, option in enumerate(options):
            m = SequenceMatcher(None, wanted, option)
            if m.real_quick_ratio() <= score or m.quick_ratio() <= score:
                continue
            value = m.ratio()
            if value > score:
                top, score = i, value
        return top

    return pd.Series([best(o, w) for o, w in zip(candidates, phrase)], dtype="Int32")


def _found_ends(phrase: str, text: str) -> list[int]:
    """For each end in ``phrase``, the length of the longest piece of it that ends there and is found in ``text``.

    The suffix automaton of the phrase is walked once by the text; a state's longest match holds for its shorter suffixes.
    """
    steps: list[dict[str, int]] = [{}]
    link, size, ends, last = [-1], [0], [0], 0
    for c in phrase:
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        ends.append(new)
        at, last = last, new
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = link[at]
        if at >= 0:
            to = steps[at][c]
            if size[to] != size[at] + 1:
                copy = len(steps)
                steps.append(dict(steps[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = copy
                    at = link[at]
                link[to] = copy
                to = copy
            link[new] = to
    best = [0] * len(steps)
    state = length = 0
    for c in text:
        while c not in steps[state] and state:
            state = link[state]
            length = size[state]
        if c in steps[state]:
            state = steps[state][c]
            length += 1
            if length > best[state]:
                best[state] = length
    order = sorted(range(1, len(steps)), key=size.__getitem__)
    for s in reversed(order):
        if best[s] and link[s] > 0:
            best[link[s]] = size[link[s]]
    for s in order:
        if not best[s]:
            best[s] = best[link[s]]
    return [best[s] for s in ends]


@F.pandas_udf(T.StringType())
def longest_span(words: pd.Series, text: pd.Series, least: pd.Series) -> pd.Series:
    """The longest run of ``least`` words or more, joined by blanks, that ``text`` holds; the earliest among equals."""

    def longest(parts, whole, n):
        if parts is None or whole is None or len(parts) < n:
            return None
        phrase = " ".join(parts)
        starts, at = [], 0
        for word in parts:
            starts.append(at)
            at += len(word) + 1
        found = _found_ends(phrase, whole)
        best = (n - 1, 0, None)
        for k, (start, word) in enumerate(zip(starts, parts, strict=True)):
            end = start + len(word)
            first = bisect_left(starts, end - found[end])
            if k - first + 1 > best[0]:
                best = (k - first + 1, first, phrase[starts[first] : end])
        return best[2]

    return pd.Series([longest(p, w, n) for p, w, n in zip(words, text, least)], dtype="object")
