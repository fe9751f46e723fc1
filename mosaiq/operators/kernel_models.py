"""Support vector regression and Gaussian processes.

Support vectors: the primal of the epsilon-insensitive loss, by Newton steps on low-rank features
(linear kernel: the features themselves), whose sums are added up by partition; the same way
whatever the number of rows. The dual, by sequential minimal optimisation with second-order choice
of the working set and a cache of kernel rows, takes all training rows of a fold in one task; it is
the yardstick, and for callers that ask for it.

Gaussian processes: always on low-rank features of LANDMARKS rows; with at most so many training
rows that is the exact process. Likelihoods, weights and scores come from cross products.

Rows alike in all features and the target are one row that counts for as many, in all sums.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise

#: Landmark rows; bytes of cached kernel rows.
LANDMARKS = 512
CACHE_BYTES = 64 << 20
EPSILON, TOLERANCE = 0.1, 1e-3
LENGTHS = (0.5, 1.0, 2.0, 4.0, 8.0)
NOISES = (1e-2, 1e-1, 1.0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def covariance(kind: str, d: np.ndarray, length: float) -> np.ndarray:
    r = d / length
    return np.exp(-0.5 * r * r) if kind == "rbf" else (1 + math.sqrt(3) * r) * np.exp(-math.sqrt(3) * r)


def svr_kernel(kind: str, width: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of standardised features, on which gamma `scale` and `auto` are the same."""
    return (lambda a, b: np.exp(-distances(a, b) ** 2 / width)) if kind == "rbf" else (lambda a, b: a @ b.T)


# --- support vectors, exact --------------------------------------------------------------------


class _Rows:
    """Rows of a kernel matrix, the least recently used of them dropped."""

    def __init__(self, z: np.ndarray, kernel: Callable) -> None:
        self.z, self.kernel, self.kept = z, kernel, OrderedDict()
        self.most = max(2, CACHE_BYTES // (8 * max(1, len(z))))

    def __getitem__(self, i: int) -> np.ndarray:
        row = self.kept.pop(i, None)
        if row is None:
            row = self.kernel(self.z[i : i + 1], self.z)[0]
            if len(self.kept) >= self.most:
                self.kept.popitem(last=False)
        self.kept[i] = row
        return row


def svr_dual(z: np.ndarray, y: np.ndarray, kernel: Callable, c: float, epsilon: float = EPSILON, tolerance: float = TOLERANCE, rounds: int = 10_000_000) -> tuple[np.ndarray, float]:
    """Coefficients and offset: f(q) = kernel(q, z) @ coefficients + offset.

    Two multipliers a row, one for each side of the tube, each within [0, c]; a step moves the
    pair that violates optimality most (the first choice) and gains most (the second).
    """
    n, rows = len(z), _Rows(z, kernel)
    if not n:
        return np.zeros(0), 0.0
    sign = np.concatenate((np.ones(n), -np.ones(n)))
    a, g = np.zeros(2 * n), np.concatenate((epsilon - y, epsilon + y))
    diagonal = np.array([kernel(z[i : i + 1], z[i : i + 1])[0, 0] for i in range(n)])
    for _ in range(rounds):
        v = -sign * g
        can_rise, can_fall = np.where(sign > 0, a < c, a > 0), np.where(sign > 0, a > 0, a < c)
        top, low = np.where(can_rise, v, -np.inf), np.where(can_fall, v, np.inf)
        i = int(top.argmax())
        if top[i] - low.min() < tolerance:
            break
        ki = rows[i % n]
        gap = top[i] - low
        curve = np.maximum(np.tile(diagonal[i % n] + diagonal - 2 * ki, 2), 1e-12)
        j = int(np.where(gap > 0, gap * gap / curve, -1.0).argmax())
        step = min(gap[j] / curve[j], c - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else c - a[j])
        a[i] += sign[i] * step
        a[j] -= sign[j] * step
        for t in (i, j):  # rounding must not leave a multiplier a hair off its bound
            a[t] = 0.0 if a[t] < 1e-12 * c else c if a[t] > c * (1 - 1e-12) else a[t]
        g += sign * np.tile(step * (ki - rows[j % n]), 2)
    v = -sign * g
    free = (a > 0) & (a < c)
    ends = [f(w) for f, w in ((max, v[np.where(sign > 0, a < c, a > 0)]), (min, v[np.where(sign > 0, a > 0, a < c)])) if len(w)]
    offset = float(v[free].mean()) if free.any() else float(np.mean(ends)) if ends else 0.0
    return a[:n] - a[n:], offset


# --- standardised rows and low-rank features -----------------------------------------------------


class Scale(NamedTuple):
    """Means and deviations of the rows outside a fold; gaps are filled by the means."""

    mean: np.ndarray
    spread: np.ndarray
    centre: float
    width: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.mean, x) - self.mean) / self.spread


def scales(data: DataFrame, features: list[str], target: str, folds: list[int]) -> dict[int, Scale]:
    """For each fold the scale of the rows outside it (-1: of all); one row per fold reaches the driver."""
    sums = [f(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate([*features, target]) for n, f in (("n", F.count), ("s", F.sum), ("q", lambda v: F.sum(v * v)))]
    known = {r["fold"]: r for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *sums).collect()}
    out = {}
    for f in folds:
        use = [r for g, r in known.items() if g != f]
        rows = max(1, sum(r["rows"] for r in use))
        n, s, q = (np.array([sum(r[f"{k}_{i}"] or 0.0 for r in use) for i in range(len(features) + 1)], float) for k in "nsq")
        mean = s / np.maximum(n, 1)
        spread = np.sqrt(np.maximum(q - n * mean * mean, 0) / rows)  # filled gaps sit at the mean
        still = spread < 1e-12 * np.maximum(1.0, np.abs(mean))
        out[f] = Scale(mean[:-1], np.where(still, np.inf, spread)[:-1], float(mean[-1]), float(spread[-1]) if not still[-1] else 1.0)
    return out


class Map(NamedTuple):
    """Low-rank features: kernel(z, landmarks) @ into."""

    landmarks: np.ndarray
    into: np.ndarray


def low_rank(kernel: Callable, landmarks: np.ndarray) -> Map:
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = value > 1e-10 * max(value.max(initial=0.0), 1e-300)
    return Map(landmarks, vector[:, keep] / np.sqrt(value[keep]))


#: Rows of a task, least while cores are left and most; each task sends its sums, so few do.
LEAST_SHARE, MOST_SHARE = 2048, 200_000


def alike(data: DataFrame, features: list[str], target: str, folds: list[int]) -> DataFrame:
    """The different rows of features and target; weights: of those outside each of the folds (-1: of all), how many they are."""
    counts = data.groupBy(*features, target).agg(*[F.count_if(F.col("fold") != f).cast("double").alias(f"weight__{i}") for i, f in enumerate(folds)])
    rows = materialise(counts.select(*features, target, F.array(*[f"weight__{i}" for i in range(len(folds))]).alias("weights__")), "alike")
    n = rows.count()
    return rows.repartition(max(1, min(data.sparkSession.sparkContext.defaultParallelism, n // LEAST_SHARE), n // MOST_SHARE), *features, target)


def landmarks(rows: DataFrame, features: list[str], target: str, folds: list[int], scale: dict[int, Scale], most: int) -> dict[int, np.ndarray]:
    """For each fold at most `most` standardised rows (of alike) outside it, those of least hash."""
    first = rows.orderBy(F.xxhash64(*features, target, F.lit(7)), *features, target).limit(2 * most).toPandas()
    x, weights = first[features].to_numpy(float), np.array(first["weights__"].tolist()).reshape(len(first), -1)
    return {f: scale[f].rows(x[weights[:, i] > 0][:most]) for i, f in enumerate(folds)}


def _columns(batch: pa.RecordBatch, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])
    return x, batch.column(target).to_numpy(zero_copy_only=False).astype(float), batch.column("weights__").flatten().to_numpy().reshape(batch.num_rows, -1)


def _added(data: DataFrame, columns: list[str], each: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Arrays by number, added up over all rows (of alike): first by partition, then by number in as many tasks."""
    features, target = columns[:-1], columns[-1]

    def add(sums: dict, number: int, v: np.ndarray) -> None:
        sums[number] = sums[number] + v if number in sums else v

    def batch_of(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(float).tobytes() for v in sums.values()], pa.binary())], names=["number", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for number, v in each(*_columns(batch, features, target)):
                    add(sums, number, v)
        yield batch_of(sums)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, v in zip(batch.column("number").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                add(sums, number, np.frombuffer(v, float))
        yield batch_of(sums)

    shape = "number int, sums binary"
    met = data.mapInArrow(partial, shape).repartition(data.sparkSession.sparkContext.defaultParallelism, "number").mapInArrow(final, shape)
    return {r.number: np.frombuffer(r.sums, float) for r in met.collect()}


# --- Gaussian processes --------------------------------------------------------------------------


def _pack(phi: np.ndarray, t: np.ndarray, weight: np.ndarray) -> np.ndarray:
    z = np.column_stack((phi, t))
    return np.append((z.T @ (weight[:, None] * z)).ravel(), weight.sum())


def likelihood(products: np.ndarray, noise: float) -> tuple[float, np.ndarray]:
    """Log marginal likelihood (but for a constant) and weights, from the cross products of (features, target)."""
    p = int(math.isqrt(len(products) - 1))
    z, n = products[:-1].reshape(p, p), products[-1]
    a, b, tt = z[:-1, :-1], z[:-1, -1], z[-1, -1]
    c = np.linalg.cholesky(a + noise * np.eye(p - 1))
    w = np.linalg.solve(c.T, np.linalg.solve(c, b))
    return float(-0.5 * (tt - b @ w) / noise - 0.5 * (n - (p - 1)) * math.log(noise) - np.log(np.diag(c)).sum()), w


def fit_processes(data: DataFrame, features: list[str], target: str, kinds: list[str], folds: list[int], most: int = LANDMARKS) -> dict[tuple[str, int], Callable[[np.ndarray], np.ndarray]]:
    """A predictor for each kernel and each fold left out (-1: none).

    Length scale and noise are those of the greatest marginal likelihood among LENGTHS x NOISES.
    """
    spark = data.sparkSession
    scale = scales(data, features, target, folds)
    rows, place = alike(data, features, target, folds), {f: i for i, f in enumerate(folds)}
    marks = landmarks(rows, features, target, folds, scale, most)
    out = {}
    for kind in kinds:  # a kernel at a time bounds what is broadcast: lengths x folds maps
        numbered = [(length, f) for length in LENGTHS for f in folds]
        maps = [low_rank(lambda a, b, k=kind, s=length: covariance(k, distances(a, b), s), marks[f]) for length, f in numbered]
        shared = spark.sparkContext.broadcast([tuple(m) for m in maps])

        def each(x, y, weights, kind=kind, numbered=numbered, shared=shared):
            for i, (length, f) in enumerate(numbered):
                weight = weights[:, place[f]]
                own = weight > 0
                if own.any():
                    known, into = shared.value[i]
                    yield i, _pack(covariance(kind, distances(scale[f].rows(x[own]), known), length) @ into, (y[own] - scale[f].centre) / scale[f].width, weight[own])

        products = _added(rows, [*features, target], each)
        for f in folds:
            best = None
            for i, (length, g) in enumerate(numbered):
                for noise in NOISES if g == f and i in products else ():
                    score, w = likelihood(products[i], noise)
                    if best is None or score > best[0]:
                        best = (score, length, maps[i].landmarks, maps[i].into @ w)
            if best is not None:
                out[kind, f] = _process(kind, scale[f], *best[1:])
        shared.unpersist()
    return out


def _process(kind: str, s: Scale, length: float, known: np.ndarray, weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: covariance(kind, distances(s.rows(x), known), length) @ weights * s.width + s.centre


# --- support vectors, by partition ------------------------------------------------------------


def _tube(r: np.ndarray, soft: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed loss of residuals, its slope, and whether it is curved there."""
    u = np.abs(r) - EPSILON
    curved = (u > 0) & (u <= soft)
    loss = np.where(u <= 0, 0.0, np.where(curved, u * u / (2 * soft), u - soft / 2))
    return loss, np.sign(r) * np.clip(u / soft, 0, 1), curved


def svr_primal(data: DataFrame, features: list[str], target: str, kinds: list[str], costs: list[float], folds: list[int], scale: dict[int, Scale], most: int = LANDMARKS, steps: int = 100) -> dict[tuple[str, float, int], Callable[[np.ndarray], np.ndarray]]:
    """Predictors by kernel, cost and fold left out: Newton on the loss with rounded corners, made sharper by halves.

    All models share their passes: one for gradients and curvatures, one for the loss at a few step lengths.
    """
    spark, p = data.sparkSession, len(features)
    rows, place = alike(data, features, target, folds), {f: i for i, f in enumerate(folds)}
    marks = landmarks(rows, features, target, folds, scale, most)
    maps = {(k, f): low_rank(svr_kernel(k, p), marks[f]) if k == "rbf" else Map(np.eye(p), np.eye(p)) for k in kinds for f in folds}
    shared = spark.sparkContext.broadcast({key: tuple(m) for key, m in maps.items()})
    models = [(k, c, f) for k in kinds for c in costs for f in folds]
    state = {m: np.zeros(maps[m[0], m[2]].into.shape[1] + 1) for m in models}  # the offset is last
    for m in models:
        state[m][-1] = scale[m[2]].centre
    lengths = (1.0, 0.5, 0.2, 0.05, 0.01, 0.001)
    soft = max(s.width for s in scale.values())

    def features_of(x, weights):
        """For each kernel and fold: its models by number, which rows take part, their weights and features."""
        for k, f in dict.fromkeys((k, f) for k, _, f in models):
            weight = weights[:, place[f]]
            own = weight > 0
            if own.any():
                known, into = shared.value[k, f]
                z = scale[f].rows(x[own])
                yield [(i, m) for i, m in enumerate(models) if (m[0], m[2]) == (k, f)], own, weight[own], np.column_stack(((svr_kernel(k, p)(z, known) if k == "rbf" else z) @ into, np.ones(own.sum())))

    for _ in range(steps):
        now = {m: w.copy() for m, w in state.items()}

        def slopes(x, y, weights, now=now, soft=soft):
            for own_models, own, weight, phi in features_of(x, weights):
                for i, m in own_models:
                    loss, slope, curved = _tube(y[own] - phi @ now[m], soft)
                    bent = phi[curved]
                    yield i, np.concatenate(([weight @ loss], phi.T @ (weight * slope), (bent.T @ (weight[curved, None] * bent))[np.triu_indices(phi.shape[1])]))

        sums = _added(rows, [*features, target], slopes)
        move, value = {}, {}
        for i, m in enumerate(models):
            w, size = now[m], len(now[m])
            got, bent = sums.get(i, np.zeros(1 + size + size * (size + 1) // 2)), np.zeros((size, size))
            bent[np.triu_indices(size)] = got[1 + size :]
            keep = np.append(np.ones(size - 1), 0.0)  # the offset is not penalised
            value[m] = 0.5 * (w[:-1] @ w[:-1]) + m[1] * got[0]
            slope = keep * w - m[1] * got[1 : 1 + size]
            bend = np.diag(keep + 1e-8) + m[1] / soft * (np.triu(bent, 1).T + bent)
            move[m] = -np.linalg.solve(bend, slope)

        def trials(x, y, weights, now=now, move=move, soft=soft):
            for own_models, own, weight, phi in features_of(x, weights):
                for i, m in own_models:
                    r, d = y[own] - phi @ now[m], phi @ move[m]
                    yield i, np.array([weight @ _tube(r - t * d, soft)[0] for t in lengths])

        found = _added(rows, [*features, target], trials)
        gained = 0.0
        for i, m in enumerate(models):
            tried = [0.5 * ((now[m] + t * move[m])[:-1] ** 2).sum() + m[1] * v for t, v in zip(lengths, found.get(i, np.zeros(len(lengths))), strict=True)]
            best = int(np.argmin(tried))
            if tried[best] < value[m]:
                state[m] = now[m] + lengths[best] * move[m]
                gained = max(gained, (value[m] - tried[best]) / max(abs(value[m]), 1e-12))
        if gained < 1e-6:
            if soft <= 0.02 * EPSILON:
                break
            soft = max(soft / 4, 0.02 * EPSILON)
    out = {}
    for m in models:
        out[m] = _supported(m[0], p, scale[m[2]], maps[m[0], m[2]], state[m])
    shared.unpersist()
    return out


def _supported(kind: str, p: int, s: Scale, m: Map, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    weights = m.into @ w[:-1]
    if kind != "rbf":
        return lambda x: s.rows(x) @ weights + w[-1]
    return lambda x: svr_kernel(kind, p)(s.rows(x), m.landmarks) @ weights + w[-1]


def fit_svr(data: DataFrame, features: list[str], target: str, choices: list[dict], folds: list[int], exact_rows: int = 0) -> dict[tuple[str, float, int], Callable[[np.ndarray], np.ndarray]]:
    """Predictors by kernel, cost and fold left out (-1: none); choices have `kernel` and `C`.

    By the primal, whatever the number of rows; only with exact_rows, up to that many rows are solved by the dual in one task a model.
    """
    spark, p = data.sparkSession, len(features)
    scale = scales(data, features, target, folds)
    wanted = list(dict.fromkeys((c["kernel"], float(c["C"])) for c in choices))
    if not exact_rows or data.count() > exact_rows:
        return svr_primal(data, features, target, list(dict.fromkeys(k for k, _ in wanted)), list(dict.fromkeys(c for _, c in wanted)), folds, scale)
    rows = data.toPandas()  # at most exact_rows
    shared = spark.sparkContext.broadcast((rows[features].to_numpy(float), rows[target].to_numpy(float), rows["fold"].to_numpy(int)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, fold = shared.value
        for batch in batches:
            for kind, cost, f in zip(*[batch.column(c).to_pylist() for c in ("kernel", "cost", "fold")], strict=True):
                own = fold != f
                coef, offset = svr_dual(scale[f].rows(x[own]), y[own], svr_kernel(kind, p), cost)
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([cost]), pa.array([f], pa.int32()), pa.array([coef.tobytes()], pa.binary()), pa.array([offset])], names=["kernel", "cost", "fold", "coef", "offset"])

    tasks = spark.createDataFrame([(k, c, f) for k, c in wanted for f in folds], "kernel string, cost double, fold int").repartition(len(wanted) * len(folds))
    out = {}
    x, fold = rows[features].to_numpy(float), rows["fold"].to_numpy(int)
    for r in tasks.mapInArrow(run, "kernel string, cost double, fold int, coef binary, offset double").collect():
        coef = np.frombuffer(r.coef, float)
        known, s = scale[r.fold].rows(x[fold != r.fold])[coef != 0], scale[r.fold]
        out[r.kernel, r.cost, r.fold] = _vectors(r.kernel, p, s, known, coef[coef != 0], r.offset)
    shared.unpersist()
    return out


def _vectors(kind: str, p: int, s: Scale, known: np.ndarray, coef: np.ndarray, offset: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: svr_kernel(kind, p)(s.rows(x), known) @ coef + offset
