"""Character-level similarity ratios.

Every ratio is 200 * LCS / (len(a) + len(b)), so insertions and deletions cost one and a
replacement costs two.  The LCS is computed with machine words in parallel: one bit per
character of ``a``, one addition per character of ``b``.

Defined results: two empty strings have ratio 100, an empty and a filled one 0, and a NULL
argument gives NULL in the column functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NOT_TITLE = re.compile(r"[^a-z0-9]+")


def norm_title(text: str) -> str:
    """Lower case, everything but ASCII letters and digits to single blanks."""
    return _NOT_TITLE.sub(" ", text.lower()).strip()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = (free + hit | free - hit) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 100.0
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of the shared tokens against either side, and of both sides led by them.  0 when a
    side has no token."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = sorted(left & right), sorted(left - right), sorted(right - left)
    if both and (not only_a or not only_b):
        return 100.0
    shared = " ".join(both)
    with_a, with_b = " ".join(both + only_a), " ".join(both + only_b)
    best = ratio(with_a, with_b)
    if shared:
        # the shared part is a prefix of either side, so these two need no alignment
        n = len(shared)
        best = max(best, 200.0 * n / (n + len(with_a)), 200.0 * n / (n + len(with_b)))
    return best


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter text with a window of its length in the longer one, windows cut
    by either end included.  0 where it is below ``least``.

    A window of m <= n characters with a ratio of ``least`` has 2 L >= least (n + m) / 100 and m >= L,
    which bounds the L that the whole longer text must reach; most pairs end there."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    if least and lcs(short, long) < least / (200 - least) * n:
        return 0.0
    best = 0.0
    for end in range(1, len(long) + n):
        piece = long[max(0, end - n):end]
        if 200.0 * len(piece) / (n + len(piece)) > best:
            best = max(best, ratio(short, piece))
    return best if best >= least else 0.0


def title_ratio_of(a: str, b: str, guard: float = 0.6) -> float:
    """token_set_ratio of two *normalised* titles; where one is shorter than ``guard`` of the
    other, no more than their token_sort_ratio.  Rounded to one decimal."""
    score = token_set_ratio(a, b)
    if min(len(a), len(b)) < guard * max(len(a), len(b)):
        score = min(score, token_sort_ratio(a, b))
    return round(score, 1)


def title_ratio(a: str, b: str) -> float:
    return title_ratio_of(norm_title(a), norm_title(b))


def _column(scorer):
    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in known:
                known[x, y] = scorer(x, y)
            out.append(known[x, y])
        return pd.Series(out, dtype="float64")

    return score


def fuzz_ratio(a: Column, b: Column) -> Column:
    return _column(ratio)(a, b)


def fuzz_partial_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    return _column(lambda x, y: partial_ratio(x, y, least))(a, b)


def fuzz_token_sort_ratio(a: Column, b: Column) -> Column:
    return _column(token_sort_ratio)(a, b)


def fuzz_token_set_ratio(a: Column, b: Column) -> Column:
    return _column(token_set_ratio)(a, b)


def fuzz_title_ratio(a: Column, b: Column) -> Column:
    """title_ratio of two raw titles."""
    return _column(title_ratio)(a, b)
