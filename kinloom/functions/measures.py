"""String similarity measures. Every measure is a similarity in 0..1 with 1 for equal values.

``NATIVE`` measures are column expressions. The others need a program per pair: plain Python over Arrow batches,
which the operators call once for each distinct pair of values.
"""

from __future__ import annotations

import difflib
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions.text import tokens

Measure = Callable[[Column, Column], Column]


def _longest(a: Column, b: Column) -> Column:
    return F.greatest(F.char_length(a), F.char_length(b))


def _share(distance: Column, a: Column, b: Column) -> Column:
    longest = _longest(a, b)
    return F.when(longest == 0, 1.0).otherwise(1.0 - distance.cast("double") / longest.cast("double"))


def _letters(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def exact(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def has_common_token(a: Column, b: Column) -> Column:
    """1 if the values share a token or are equal, else 0."""
    return (F.arrays_overlap(tokens(a), tokens(b)) | (a == b)).cast("double")


def levenshtein(a: Column, b: Column) -> Column:
    return _share(F.levenshtein(a, b), a, b)


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; a difference in length counts as that many."""
    both = F.zip_with(_letters(a), _letters(b), lambda x, y: F.when(x == y, 0).otherwise(1))
    off = F.aggregate(both, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))
    return _share(off, a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of characters."""
    x, y = _letters(a), _letters(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def bag(a: Column, b: Column) -> Column:
    """Bag distance: the larger number of characters that one side has more than the other."""

    def more(x: Column, y: Column) -> Column:
        extra = F.transform(
            F.array_distinct(x),
            lambda c: F.greatest(F.lit(0), F.size(F.filter(x, lambda u: u == c)) - F.size(F.filter(y, lambda v: v == c))),
        )
        return F.aggregate(extra, F.lit(0), lambda s, n: s + n)

    x, y = _letters(a), _letters(b)
    return _share(F.greatest(more(x, y), more(y, x)), a, b)


def py_jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    m, moved = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def py_jaro_winkler(a: str, b: str) -> float:
    """Jaro with a tenth of the rest for each of up to four equal first characters, where Jaro is above 0.7."""
    s = py_jaro(a, b)
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return s + same * 0.1 * (1 - s) if s > 0.7 else s


def damerau_distance(a: str, b: str, insert=1.0, delete=1.0, substitute=1.0, transpose=1.0) -> float:
    """Edit distance with transpositions of neighbours, between which edits may come (Lowrance and Wagner)."""
    rows = {}
    far = len(a) * delete + len(b) * insert
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i * delete
    for j in range(len(b) + 1):
        d[1][j + 1] = j * insert
    for i, x in enumerate(a, 1):
        column = 0
        for j, y in enumerate(b, 1):
            k, m = rows.get(y, 0), column
            if x == y:
                column = j
            d[i + 1][j + 1] = min(
                d[i][j] + (0 if x == y else substitute),
                d[i + 1][j] + insert,
                d[i][j + 1] + delete,
                d[k][m] + (i - k - 1) * delete + transpose + (j - m - 1) * insert,
            )
        rows[x] = i
    return d[-1][-1]


def py_damerau(a: str, b: str) -> float:
    return 1.0 if a == b else 1.0 - damerau_distance(a, b) / max(len(a), len(b))


def py_weighted_damerau(a: str, b: str) -> float:
    """Damerau with insertions and deletions at half the cost of a substitution, transpositions at three quarters."""
    return 1.0 if a == b else max(0.0, 1.0 - damerau_distance(a, b, 0.5, 0.5, 1.0, 0.75) / max(len(a), len(b)))


def py_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp; not symmetric, so operators pass the later record's value first."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def py_compression(a: str, b: str) -> float:
    """1 - normalised compression distance (zlib), held to 0..1."""
    if a == b:
        return 1.0
    size = lambda *s: len(zlib.compress("".join(s).encode(), 9))
    x, y = size(a), size(b)
    both = min(size(a, b), size(b, a))
    return min(1.0, max(0.0, 1 - (both - min(x, y)) / max(x, y)))


def py_weighted_degree(a: str, b: str, degree: int = 3) -> float:
    """Weighted-degree kernel (equal substrings at equal places, up to ``degree`` long), as 1 - kernel distance / sqrt 2."""
    if a == b:
        return 1.0

    def kernel(x: str, y: str) -> float:
        total = 0.0
        for n in range(1, degree + 1):
            weight = 2 * (degree - n + 1) / (degree * (degree + 1))
            total += weight * sum(x[i : i + n] == y[i : i + n] for i in range(min(len(x), len(y)) - n + 1))
        return total

    x, y = kernel(a, a), kernel(b, b)
    if not x or not y:
        return 0.0
    near = kernel(a, b) / (x * y) ** 0.5
    return max(0.0, 1 - max(0.0, 2 - 2 * near) ** 0.5 / 2**0.5)


def _in_python(f: Callable[[str, str], float]) -> Measure:
    @F.pandas_udf("double")
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return lambda a, b: over(a, b)


NATIVE: dict[str, Measure] = {
    "exact": exact, "has_common_token": has_common_token, "levenshtein": levenshtein, "hamming": hamming, "jaccard": jaccard, "bag": bag,
}
PYTHON: dict[str, Callable[[str, str], float]] = {
    "jaro": py_jaro, "jaro_winkler": py_jaro_winkler, "damerau": py_damerau, "weighted_damerau": py_weighted_damerau,
    "ratio": py_ratio, "compression": py_compression, "weighted_degree": py_weighted_degree,
}
#: The order in which the learner prefers measures of equal merit.
POOL = ("bag", "compression", "hamming", "jaccard", "jaro", "jaro_winkler", "levenshtein")


def register_measure(name: str, f: Callable[[str, str], float] | Measure, native: bool = False) -> None:
    """A measure by name: a Python function of two strings, or, if ``native``, of two columns."""
    if native:
        PYTHON.pop(name, None)
        NATIVE[name] = f
    else:
        NATIVE.pop(name, None)
        PYTHON[name] = f


def measure(name: str) -> Measure:
    return NATIVE[name] if name in NATIVE else _in_python(PYTHON[name])
