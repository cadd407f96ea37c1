"""Similarities of string pairs as pandas UDFs, computed in Arrow batches, each distinct pair of a batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits: one machine operation a character for a whole row."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence by the summed lengths; two empty strings are equal."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common tokens, and those with either side's rest. 0 if a side has no token; 100 if one side's tokens
    are all the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    common, p, q = " ".join(both), " ".join(both + left), " ".join(both + right)
    best = ratio(p, q)
    return max(best, ratio(common, p), ratio(common, q)) if common else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string and a stretch of the longer one not longer than it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, best = len(a), 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << n) - 1
    masks = [at.get(c, 0) for c in b]
    for i in range(1 - n, len(b)):
        part = masks[max(0, i) : i + n]
        if not part or not (part[-1] or part[0]):
            continue
        if 200.0 * sum(map(bool, part)) / (n + len(part)) <= best:
            continue  # not even all its letters would do
        s = full
        for m in part:
            u = s & m
            s = ((s + u) | (s - u)) & full
        best = max(best, 200.0 * (n - s.bit_count()) / (n + len(part)))
    return best


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken) if t))) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by a tenth of the rest for each of up to four equal first letters, from 0.7 on."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    n = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        n += 1
    return j + 0.1 * n * (1 - j)


def scored_once(df: DataFrame, a: str, b: str, scorers: dict[str, Callable[[str, str], float]]) -> DataFrame:
    """df with a column for each scorer: each distinct pair of values is scored once, wherever its rows lie, and joined back. Null on
    either side gives null."""
    names = list(scorers)
    distinct = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{n: [float(scorers[n](x, y)) for x, y in zip(pdf["_a"], pdf["_b"])] for n in names})

    got = distinct.mapInPandas(score, ", ".join(["_a string", "_b string", *[f"{n} double" for n in names]]))
    return df.join(got, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").drop("_a", "_b")


def pairwise(f: Callable[[str, str], float]):
    """f as a column function of two string columns; null on either side gives null."""

    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, float | None] = {}
        out = []
        for k in zip(a, b):
            if k not in seen:
                seen[k] = None if not isinstance(k[0], str) or not isinstance(k[1], str) else f(*k)
            out.append(seen[k])
        return pd.Series(out, dtype="float64")

    scored.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(scored, T.DoubleType())


udf_ratio, udf_token_set, udf_token_sort, udf_partial, udf_jaro_winkler = map(pairwise, (ratio, token_set_ratio, token_sort_ratio, partial_ratio, jaro_winkler))


def is_abbreviation(a: str | None, b: str | None) -> bool:
    """Whether one word's letters stand in the other in order, a short one uses the same letters from the same start, or their ratio is 70."""
    if not a or not b:
        return False
    inside = lambda s, t: all(c in it for it in [iter(t)] for c in s)
    return inside(a, b) or inside(b, a) or (len(a) <= 4 and a[0] == b[0] and set(a) <= set(b)) or ratio(a, b) >= 70


@F.pandas_udf(T.BooleanType())
def udf_is_abbreviation(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([is_abbreviation(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b)], dtype=bool)
