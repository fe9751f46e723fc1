"""Shapley values of predictions: exact for trees and linear models of any width, sampled for the rest.

Trees: each leaf is a product of conditions, one per feature on its path. Without a feature, a
row follows the path with the share of training rows that did (path-dependent values), or as a
background row does (interventional values). The weights of all subset sizes are the integral of
a polynomial over [0, 1], which a Gauss-Legendre rule of half its degree takes exactly; so no
subset is listed and nothing is divided by a vanishing number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of one block of rows x leaves x conditions.
BLOCK = 1 << 21


class Paths(NamedTuple):
    """Leaves of one tree: by leaf and condition the feature, its interval (low, high], whether a
    missing value fits, and the share of rows that went on; padded by conditions that always hold."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray
    share: np.ndarray
    value: np.ndarray
    weight: np.ndarray


def paths(feature, threshold, left, right, missing_left, value, cover) -> Paths:
    """Flat nodes (feature -1: a leaf; left takes values up to the threshold) as leaves."""
    leaves, todo = [], [(0, {})]
    while todo:
        node, known = todo.pop()
        f = int(feature[node])
        if f < 0:
            leaves.append((node, known))
            continue
        for child, is_left in ((int(left[node]), True), (int(right[node]), False)):
            low, high, miss, share = known.get(f, (-math.inf, math.inf, True, 1.0))
            t = float(threshold[node])
            low, high = (low, min(high, t)) if is_left else (max(low, t), high)
            part = cover[child] / cover[node] if cover[node] else 0.0
            todo.append((child, known | {f: (low, high, miss and bool(missing_left[node]) == is_left, share * part)}))
    width = max([1, *(len(k) for _, k in leaves)])
    shape = (len(leaves), width)
    out = Paths(np.zeros(shape, int), np.full(shape, -math.inf), np.full(shape, math.inf), np.ones(shape, bool), np.ones(shape), np.array([float(value[n]) for n, _ in leaves]), np.array([cover[n] / cover[0] if cover[0] else 0.0 for n, _ in leaves]))
    for i, (_, known) in enumerate(leaves):
        for j, (f, (low, high, miss, share)) in enumerate(sorted(known.items())):
            for a, v in zip(out[:5], (f, low, high, miss, share), strict=True):
                a[i, j] = v
    return out


def _fits(p: Paths, x: np.ndarray) -> np.ndarray:
    """rows x leaves x conditions: 1.0 where the row meets the condition."""
    v = x[:, p.feature]
    return np.where(np.isnan(v), p.missing, (v > p.low) & (v <= p.high)).astype(float)


def _add(out: np.ndarray, p: Paths, parts: np.ndarray) -> None:
    """Adds rows x leaves x conditions to the features they belong to."""
    at = p.feature.ravel()
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(at[order]) != 0)))
    out[:, at[order][first]] += np.add.reduceat(parts.reshape(len(out), -1)[:, order], first, axis=1)


def _by_path(p: Paths, x: np.ndarray, out: np.ndarray) -> None:
    own = _fits(p, x)
    nodes, weights = np.polynomial.legendre.leggauss((p.feature.shape[1] + 1) // 2)
    total = np.zeros_like(own)
    for u, w in zip((nodes + 1) / 2, weights / 2, strict=True):
        factor = p.share * (1 - u) + own * u
        factor = np.where(factor > 0, factor, 1e-300)  # a share of 0: a child that no row reached
        total += w * factor.prod(axis=2, keepdims=True) / factor
    _add(out, p, p.value[:, None] * (own - p.share) * total)


def _by_background(p: Paths, x: np.ndarray, back: np.ndarray, out: np.ndarray) -> None:
    own, width = _fits(p, x), p.feature.shape[1]
    size = np.array([math.factorial(i) for i in range(2 * width + 1)], float)
    for row in back:
        other = _fits(p, row[None, :])
        only, lacks = own * (1 - other), (1 - own) * other  # the row alone, the background alone
        open_ = ((own + other) > 0).all(axis=2, keepdims=True)
        a, b = only.sum(axis=2, keepdims=True).astype(int), lacks.sum(axis=2, keepdims=True).astype(int)
        gain = np.where(a > 0, size[np.maximum(a - 1, 0)] * size[b] / size[a + b], 0.0) * only
        loss = np.where(b > 0, size[a] * size[np.maximum(b - 1, 0)] / size[a + b], 0.0) * lacks
        _add(out, p, p.value[:, None] * open_ * (gain - loss) / len(back))


def tree_values(trees: list[Paths], x: np.ndarray, background: np.ndarray | None = None) -> np.ndarray:
    """Shapley values of the sum of trees, row by row; NaN in x is missing.

    Path-dependent without a background, else the mean over its rows of the interventional
    values. Either way a row's values add up to its prediction less the expected one.
    """
    out = np.zeros(x.shape)
    for p in trees:
        step = max(1, BLOCK // p.feature.size)
        for i in range(0, len(x), step):
            part = out[i : i + step]
            if background is None:
                _by_path(p, x[i : i + step], part)
            else:
                _by_background(p, x[i : i + step], background, part)
    return out


def expected(trees: list[Paths]) -> float:
    """The mean prediction of the training rows."""
    return float(sum(p.value @ p.weight for p in trees))


def linear_values(weights: np.ndarray, means: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear model's values against the features' means."""
    return (x - means) * weights


def sampled_values(predict: Callable[[np.ndarray], np.ndarray], x: np.ndarray, background: np.ndarray, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Any model: features are exchanged with background rows one by one, in random orders and their reverses.

    A row's values add up to its prediction less the background's mean, whatever the rounds.
    """
    p, out = x.shape[1], np.zeros(x.shape)
    rng = np.random.default_rng(seed)
    orders = [o for _ in range(rounds) for order in [rng.permutation(p)] for o in (order, order[::-1])]
    for row, target in zip(x, out, strict=True):
        for order in orders:
            mixed = background.copy()
            before = predict(mixed).mean()
            for f in order:
                mixed[:, f] = row[f]
                now = predict(mixed).mean()
                target[f] += (now - before) / len(orders)
                before = now
    return out


def explain(df: DataFrame, features: list[str], key: str, values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key (as text) and values (array by feature) of every row; NULL is passed on as NaN."""
    rows = df.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(values(x)), pa.list_(pa.float64()))], names=["key", "values"])

    return rows.mapInArrow(run, "key string, values array<double>")


def mean_absolute(explained: DataFrame, features: list[str], rows: Column | None = None) -> DataFrame:
    """feature, mean_abs_shap over all rows, largest first; rows: for how many each one stands."""
    weight = F.lit(1.0) if rows is None else rows
    each = explained.select(weight.alias("w"), F.posexplode("values").alias("i", "v")).groupBy("i").agg((F.sum(F.abs("v") * F.col("w")) / F.sum("w")).alias("mean_abs_shap"))
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("i") + 1)
    return each.select(name.alias("feature"), "mean_abs_shap").orderBy(F.desc("mean_abs_shap"), "feature")
