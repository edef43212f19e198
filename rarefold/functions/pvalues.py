"""Tails of distributions, for the few rows of a table of tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_upper(x: float, df: int) -> float:
    """The chance of more than x, for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2:
        term, total = math.sqrt(h / math.pi) * math.exp(-h) * 2, 0.0
        for k in range(1, df, 2):
            total += term
            term *= x / (k + 2)
        return math.erfc(math.sqrt(h)) + total
    term, total = math.exp(-h), 0.0
    for k in range(df // 2):
        total += term
        term *= h / (k + 1)
    return total


def student_two_sided(t: float, df: float) -> float:
    """The chance of more than abs(t) on either side: the incomplete beta function of df/2 and 1/2 at df / (df + t^2), by Lentz's continued fraction."""
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    return beta_share(a, b, x)


def beta_share(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def signed_rank_two_sided(w: float, n: int) -> float:
    """The chance that a sum of ranks 1 to n, each taken or not with even chances, is w at most, twice."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(r * (r + 1) // 2, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def kendall_two_sided(s: float, n: int) -> float:
    """The chance that orders of n rows without ties agree or disagree by abs(s) pairs or more, from counts of inversions."""
    top = n * (n - 1) // 2
    ways = [1]
    for k in range(2, n + 1):
        run, more = 0, []
        for i in range(len(ways) + k - 1):
            run += (ways[i] if i < len(ways) else 0) - (ways[i - k] if i >= k else 0)
            more.append(run)
        ways = more
    few = round((top - abs(s)) / 2)
    return min(1.0, 2 * sum(ways[: few + 1]) / math.factorial(n))


def signed_rank_p(w: Column, n: Column, cubes: Column, zeros: Column) -> Column:
    """p of a signed-rank statistic. cubes: the sum of t^3 - t over groups of t equal ranks."""

    def one(w: float, n: int, cubes: float, zeros: int) -> float:
        if not cubes and not zeros and n <= 50:
            return signed_rank_two_sided(w, n)
        spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - cubes / 48)
        return normal_two_sided((w - n * (n + 1) / 4) / spread)

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, cubes: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([one(a, int(b), c, d) for a, b, c, d in zip(w, n, cubes, zeros, strict=True)], dtype=float)

    return p(w, n, cubes, zeros)


def kendall_p(*columns: Column) -> Column:
    """p of a Kendall statistic, from s, n, and of both columns the pairs that tie and the sums of t(t-1)(t-2) and t(t-1)(2t+5) over groups of t ties."""

    def one(s: float, n: float, xt: float, yt: float, x0: float, y0: float, x1: float, y1: float) -> float | None:
        if not xt and not yt and n <= 33:
            return kendall_two_sided(s, int(n))
        m = n * (n - 1)
        spread = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + (x0 * y0 / (9 * m * (n - 2)) if n > 2 else 0)
        return normal_two_sided(s / math.sqrt(spread)) if spread > 0 else None

    @F.pandas_udf("double")
    def p(s: pd.Series, n: pd.Series, xt: pd.Series, yt: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([one(*r) if all(map(pd.notna, r)) else None for r in zip(s, n, xt, yt, x0, y0, x1, y1, strict=True)], dtype=float)

    return p(*columns)


def student_p(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(a, float(b)) if pd.notna(a) else None for a, b in zip(t, df, strict=True)], dtype=float)

    return p(t, df)


def chi2_p(x: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def p(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_upper(a, int(b)) if pd.notna(a) else None for a, b in zip(x, df, strict=True)], dtype=float)

    return p(x, df)
