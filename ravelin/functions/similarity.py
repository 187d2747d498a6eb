"""String similarity. What Spark has no function for is a vectorised UDF that computes each distinct pair of a batch once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.normalize import words


def jaro_winkler_of(a: str, b: str) -> float:
    """Boosted by up to four equal first characters where the Jaro similarity is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    taken, left = set(), []
    for i, c in enumerate(a):
        for j in places.get(c, ()):
            if j > i + reach:
                break
            if j >= i - reach and j not in taken:
                taken.add(j)
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a machine word of many bits at a time."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    rest = full
    for c in a:
        hit = rest & where.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(b) - rest.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_of(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) if a and b else 0.0


def token_set_of(a: str, b: str) -> float:
    """The best ratio among the common words, and these with either side's other words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    same = " ".join(sorted(x & y))
    if same and (x <= y or y <= x):
        return 1.0
    one, two = (" ".join(filter(None, [same, " ".join(sorted(s - (x & y)))])) for s in (x, y))
    return max(indel_ratio(p, q) for p, q in ([(same, one), (same, two)] if same else []) + [(one, two)])


def _edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
    return row[-1]


def lcs_ratio_of(a: str, b: str) -> float:
    """Contained: the shorter length by the longer; over 80 characters: 1 less the edit distance; else the common subsequence, each by the longer length."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b))
    if a in b or b in a:
        return min(len(a), len(b)) / longer
    return 1 - _edit_distance(a, b) / longer if longer > 80 else common_subsequence(a, b) / longer


def _vectorised(of: Callable[[str, str], float], x: Column | str, y: Column | str) -> Column:
    @F.pandas_udf("double")
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = of(*pair) if pair[0] and pair[1] else 0.0
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return each(x, y)


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """Like the three below, of two text columns; 0 where either is missing."""
    return _vectorised(jaro_winkler_of, a, b)


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    return _vectorised(token_sort_of, a, b)


def token_set_ratio(a: Column | str, b: Column | str) -> Column:
    return _vectorised(token_set_of, a, b)


def lcs_ratio(a: Column | str, b: Column | str) -> Column:
    return _vectorised(lcs_ratio_of, a, b)


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when((a != "") & (b != ""), value).otherwise(0.0)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return _both(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def _jaccard(x: Column, y: Column) -> Column:
    same = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), same / F.greatest(F.size(F.array_union(x, y)), F.lit(1))).otherwise(0.0)


def token_jaccard(a: Column, b: Column) -> Column:
    return _jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def token_overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / F.greatest(least, F.lit(1))).otherwise(0.0)


def char_grams(a: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters; none for a shorter text."""
    return F.when(F.length(a) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(a) - n + 1), lambda i: F.substring(a, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def gram_jaccard(a: Column, b: Column, n: int) -> Column:
    return _jaccard(char_grams(a, n), char_grams(b, n))


def common_prefix(a: Column, b: Column) -> Column:
    least = F.least(F.length(a), F.length(b))
    equal = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(least > 0, F.size(equal)).otherwise(0)
