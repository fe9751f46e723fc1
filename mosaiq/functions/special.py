"""Special functions of the test statistics, in NumPy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1.0, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution."""
    if f != f:
        return float("nan")
    if f == float("inf"):
        return 0.0
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * max(f, 0.0)))


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    out = [float("nan") if pd.isna(a) or pd.isna(b) or pd.isna(c) else f_survival(float(a), float(b), float(c)) for a, b, c in zip(f, d1, d2, strict=True)]
    return pd.Series(out, dtype=float)


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution, by Newton steps from a rational start."""
    if p < 0.5:
        return -normal_quantile(1 - p)
    t = math.sqrt(-2 * math.log(1 - p))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    for _ in range(4):
        x += (1 - p - 0.5 * math.erfc(x / math.sqrt(2))) * -math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x


#: Ranks whose normal scores are summed at a time.
SCORE_BLOCK = 1 << 16


def normal_scores(before: int, count: int, n: int, ends: int) -> tuple[float, float]:
    """Of the ranks before + 1 .. before + count of n: the sum of their normal scores, without the
    `ends` outermost ranks on either side, and the sum of all their squares."""
    inner = square = 0.0
    for start in range(before + 1, before + count + 1, SCORE_BLOCK):
        i = np.arange(start, min(start + SCORE_BLOCK, before + count + 1))
        low = np.minimum(i, n + 1 - i)  # the scores are symmetric
        m = np.fromiter(map(_NORMAL.inv_cdf, (low - 0.375) / (n + 0.25)), float, len(i)) * np.where(2 * i > n + 1, -1.0, 1.0)
        inner += float(m[(i > ends) & (i <= n - ends)].sum())
        square += float(m @ m)
    return inner, square


def shapiro_ends(n: int) -> int:
    """Ranks at either end that have weights of their own."""
    return 1 if n <= 5 else 2


def shapiro_weights(n: int, mm: float) -> tuple[float, float, float]:
    """Weights of the outermost and of the second values, and the factor of the other scores; mm
    is the sum of the squared scores."""
    if n == 3:
        return math.sqrt(0.5), 0.0, 0.0
    u = 1 / math.sqrt(n)
    outer = -_NORMAL.inv_cdf((1 - 0.375) / (n + 0.25))
    # fixed values: Royston's polynomials for the outer weights
    last = outer / math.sqrt(mm) + u * (0.221157 + u * (-0.147981 + u * (-2.071190 + u * (4.434685 + u * -2.706056))))
    if n <= 5:
        return last, 0.0, 1 / math.sqrt((mm - 2 * outer**2) / (1 - 2 * last**2))
    next_to = -_NORMAL.inv_cdf((2 - 0.375) / (n + 0.25))
    second = next_to / math.sqrt(mm) + u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 + u * -3.582633))))
    return last, second, 1 / math.sqrt((mm - 2 * outer**2 - 2 * next_to**2) / (1 - 2 * last**2 - 2 * second**2))


def shapiro_p(w: float, n: int) -> float:
    """P of Shapiro-Wilk's W; fitted by Royston for up to 5000 values, the same formula beyond."""
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return 1e-99
        y = -math.log(g - y)
        mu = 0.5440 + n * (-0.39978 + n * (0.025054 + n * -0.0006714))
        sigma = math.exp(1.3822 + n * (-0.77857 + n * (0.062767 + n * -0.0020322)))
    else:
        mu = -1.5861 + ln * (-0.31082 + ln * (-0.083751 + ln * 0.0038915))
        sigma = math.exp(-0.4803 + ln * (-0.082676 + ln * 0.0030302))
    return 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p after Royston (1995), for 3 values at least."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    ends = shapiro_ends(n)
    scores = [normal_scores(i, 1, n, ends) for i in range(n)]
    last, second, factor = shapiro_weights(n, sum(s for _, s in scores))
    c = x - x.mean()
    b = last * (c[-1] - c[0]) + second * (c[-2] - c[1]) + factor * float(np.array([m for m, _ in scores]) @ c)
    w = min(1.0, float(b * b / (c @ c)))
    return w, shapiro_p(w, n)
