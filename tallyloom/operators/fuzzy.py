"""Likeness of two short texts, 0 to 100, as Arrow-batched column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


_SIGNS = re.compile(r"[^\w]")


def cleaned(text: str) -> str:
    """A text as scores take it: lower case, each character but letters, digits and the underscore a space, trimmed."""
    return _SIGNS.sub(" ", text.lower()).strip()


def codes(text: str) -> list[str]:
    """All runs of three digits or more."""
    return re.findall(r"[0-9]{3,}", text)


def _masks(a: str) -> dict[str, int]:
    """For each character the bits of its places."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _common(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number. at: the masks of a, where known."""
    at = _masks(a) if at is None else at
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & (1 << len(a)) - 1).bit_count()


def _ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of its length of the longer one; at either end the stretch may be shorter."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    at, best = _masks(short), 0.0
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        if 200.0 * len(part) / (n + len(part)) > best:  # a shorter stretch can score no more than this
            best = max(best, 200.0 * _common(short, part, at) / (n + len(part)))
    return best


def _token_parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def _token_set(a: str, b: str) -> float:
    both, left, right = _token_parts(a, b)
    if both and not (left and right):
        return 100.0
    if not (both or (left and right)):
        return 0.0
    # what both have stands first in either, so it is common whole
    ahead = len(both) + 1 if both else 0
    x, y = ahead + len(left), ahead + len(right)
    return max([200.0 * (ahead + _common(left, right)) / (x + y), *(200.0 * len(both) / (len(both) + n) for n in (x, y) if both)])


def _token_sort(a: str, b: str, score=_ratio) -> float:
    return score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _weighted(a: str, b: str) -> float:
    """The ratio, or less a discount the likeness of words, or of parts where one text is much longer."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(_ratio(a, b), 0.95 * max(_token_sort(a, b), _token_set(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    both, left, right = _token_parts(a, b)
    words = 100.0 if both else max(_token_sort(a, b, _partial), _partial(left, right))
    return max(_ratio(a, b), scale * _partial(a, b), 0.95 * scale * words)


plain, partial, weighted, token_set = _ratio, _partial, _weighted, _token_set


def _scored(score, a, b):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen = {(x, y): None if x is None or y is None else score(x, y) for x, y in set(zip(a, b))}
        return pd.Series([seen[pair] for pair in zip(a, b)], dtype="float64")

    return pandas_udf(run, "double")(a, b)


def ratio(a: Column | str, b: Column | str) -> Column:
    """Twice the longest common subsequence over both lengths."""
    return _scored(_ratio, a, b)


def partial_ratio(a: Column | str, b: Column | str) -> Column:
    return _scored(_partial, a, b)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    """Of the words, in any order and once each: 100 where those of one text are all in the other."""
    return _scored(_token_set, a, b)


def weighted_ratio(a: Column | str, b: Column | str) -> Column:
    return _scored(_weighted, a, b)
