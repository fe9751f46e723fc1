"""Second-order histogram boosting, many models in the same passes.

Features are cut at quantiles into at most BINS bins; a row is one byte a feature, and one byte
value is kept for missing. Each level of the trees is one pass: a partition adds gradients,
hessians up by node, feature and bin (map-side partial sums), the sums of a node meet
in one task, which searches its best split and learns the side that missing values take. Only
splits reach the driver. Every setting and fold of a grid search is a model of the same passes,
so their number is that of the largest model, not of the grid. Margins are written with the rows
every few trees, so a pass applies only the trees since. The objective is the squared error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise

BINS = 255
MISSING = 255
#: Features whose sums travel together, and trees between two writings of the margins.
CHUNK = 64
TREES_A_CUT = 10
#: Rows of a partition below which fewer of them are made.
LEAST_ROWS = 512


class Setting(NamedTuple):
    """What a model is made with; reg, gain and child weight as in the second-order objective."""

    trees: int
    rate: float
    depth: int
    subsample: float = 1.0
    reg: float = 1.0
    least_gain: float = 0.0
    child_weight: float = 1.0


class Tree(NamedTuple):
    """Flat nodes; feature -1 marks a leaf. Left takes values up to the threshold (cut: its bin)."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray


class Model(NamedTuple):
    base: float
    trees: list[Tree]


def leaves_of(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """The node each row of bins ends in; tree: (feature, cut, left, right, missing_left, ...)."""
    feature, cut, left, right, missing_left = tree[:5]
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        b = bins[rows, np.maximum(f, 0)]
        low = np.where(b == MISSING, missing_left[at], b <= cut[at])
        at = np.where(inner, np.where(low, left[at], right[at]), at)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """Predictions from raw values; NaN is missing."""
    out = np.full(len(x), model.base)
    rows = np.arange(len(x))
    for t in model.trees:
        at = np.zeros(len(x), np.int64)
        while (t.feature[at] >= 0).any():
            v = x[rows, np.maximum(t.feature[at], 0)]
            low = np.where(np.isnan(v), t.missing_left[at], v <= t.threshold[at])
            at = np.where(t.feature[at] >= 0, np.where(low, t.left[at], t.right[at]), at)
        out += t.value[at]
    return out


def best_split(sums: np.ndarray, reg: float, child_weight: float) -> tuple[float, int, int, bool]:
    """Gain, feature, bin and side of missing values of the best split of one node.

    sums: 2 (gradient, hessian) x features x BINS + 1, missing values last. The first feature and
    bin of the greatest gain are taken, and for equal gains missing values go right. No split:
    feature -1. The hessian of a squared error is 1, so it is the count of rows as well.
    """
    g, h = sums
    total_g, total_h = g[0].sum(), h[0].sum()
    score = lambda a, b: np.divide(a * a, b + reg, out=np.zeros_like(a), where=b + reg > 0)
    best = (0.0, -1, -1, False)
    gl, hl = np.cumsum(g[:, :BINS], axis=1), np.cumsum(h[:, :BINS], axis=1)
    for to_left in (False, True):
        a, b = (gl + g[:, BINS:], hl + h[:, BINS:]) if to_left else (gl, hl)
        c, d = total_g - a, total_h - b
        gain = 0.5 * (score(a, b) + score(c, d) - score(np.array([total_g]), np.array([total_h])))
        gain = np.where((b >= child_weight) & (d >= child_weight), gain, -np.inf)
        at = int(gain.argmax())
        if gain.flat[at] > best[0] + 1e-12:
            best = (float(gain.flat[at]), at // BINS, at % BINS, to_left)
    return best


def cuts_of(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Upper ends of each feature's bins: its quantiles, or all its values if they are few."""
    share = [i / BINS for i in range(1, BINS)] + [1.0]
    found = df.approxQuantile(features, share, 1 / (8 * BINS))
    return [np.unique(np.array(q, float)) for q in found]


def _binned(features: list[str], cuts: list[np.ndarray], n_models: int, bases: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = np.full((n, len(features)), MISSING, np.uint8)
            for j, c in enumerate(features):
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(v)
                # a value beyond the greatest quantile falls in the last bin
                out[known, j] = np.minimum(np.searchsorted(cuts[j], v[known]), max(len(cuts[j]) - 1, 0))
            margin = np.tile(bases, (n, 1)).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("fold"), batch.column("label"), pa.array([r.tobytes() for r in out], pa.binary()), pa.array([r.tobytes() for r in margin], pa.binary())],
                names=["row", "fold", "label", "bins", "margins"],
            )

    return run


BINNED = "row long, fold int, label double, bins binary, margins binary"


def _read(batch: pa.RecordBatch, p: int, m: int) -> tuple[np.ndarray, ...]:
    raw = lambda c: b"".join(batch.column(c).to_pylist())
    bins = np.frombuffer(raw("bins"), np.uint8).reshape(-1, p)
    margins = np.frombuffer(raw("margins"), float).reshape(-1, m).copy()
    row, fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "fold", "label"))
    return row.astype(np.int64).view(np.uint64), fold, y, bins, margins


def drawn(row: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether each row takes part in a tree: by a hash of both."""
    if share >= 1:
        return np.ones(len(row), bool)
    with np.errstate(over="ignore"):
        v = (row + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (v >> np.uint64(11)).astype(float) / float(1 << 53) < share


def _advance(bins: np.ndarray, margins: np.ndarray, recent: list[list[tuple]]) -> None:
    for m, trees in enumerate(recent):
        for t in trees:
            margins[:, m] += t[5][leaves_of(t, bins)]


def _offsets(cuts: list[np.ndarray]) -> np.ndarray:
    """Where each feature's bins begin among all bins of all features, and their number; one more for missing."""
    return np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts])))


def _level(offsets: np.ndarray, models: list[tuple[Setting, int]], number: int, recent: list[list[tuple]], growing: list[tuple | None], open_nodes: list[dict[int, int]]):
    """Sums of a partition by model, open node and chunk of features."""
    p, width = len(offsets) - 1, int(offsets[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, len(o), width)) if o else None for o in open_nodes]
        for batch in batches:
            if not batch.num_rows:
                continue
            row, fold, y, bins, margins = _read(batch, p, len(models))
            _advance(bins, margins, recent)
            place_of = np.where(bins == MISSING, np.diff(offsets) - 1, bins) + offsets[:-1]
            for m, (setting, held) in enumerate(models):
                if sums[m] is None:
                    continue
                place = np.full(len(growing[m][0]), -1)
                for node, i in open_nodes[m].items():
                    place[node] = i
                spot = place[leaves_of(growing[m], bins)]
                use = (fold != held) & (spot >= 0) & drawn(row, number, setting.subsample)
                g = (margins[:, m] - y)[use]
                at = (spot[use][:, None] * width + place_of[use]).ravel()
                size = len(open_nodes[m]) * width
                sums[m][0] += np.bincount(at, np.repeat(g, p), size).reshape(-1, width)
                sums[m][1] += np.bincount(at, minlength=size).reshape(-1, width)
        rows = [(m, node, c, sums[m][:, i, offsets[c] : offsets[min(c + CHUNK, p)]].tobytes()) for m, o in enumerate(open_nodes) if o for node, i in o.items() for c in range(0, p, CHUNK)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.binary())], names=["model", "node", "chunk", "sums"])

    return run


def _splits(settings: list[Setting], offsets: np.ndarray):
    """Adds the partitions' sums of a node up and searches its best split; input sorted by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, out = None, None, []

        def done() -> None:
            own = offsets[key[2] : key[2] + CHUNK + 1] - offsets[key[2]]
            wide = np.zeros((2, len(own) - 1, BINS + 1))
            for j, (a, b) in enumerate(zip(own[:-1], own[1:], strict=True)):
                wide[:, j, : b - a - 1], wide[:, j, BINS] = total[:, a : b - 1], total[:, b - 1]
            gain, feature, cut, to_left = best_split(wide, settings[key[0]].reg, settings[key[0]].child_weight)
            low = wide[:, feature, : cut + 1].sum(axis=1) + (wide[:, feature, BINS] if to_left else 0) if feature >= 0 else np.zeros(2)
            out.append((*key, gain, feature + key[2] if feature >= 0 else -1, cut, to_left, *low.tolist(), *wide[:, 0].sum(axis=1).tolist()))

        for batch in batches:
            for m, node, chunk, blob in zip(*[batch.column(c).to_pylist() for c in ("model", "node", "chunk", "sums")], strict=True):
                part = np.frombuffer(blob, float).reshape(2, -1)
                if (m, node, chunk) != key:
                    if key is not None:
                        done()
                    key, total = (m, node, chunk), part.copy()
                else:
                    total += part
        if key is not None:
            done()
        names = [c.split()[0] for c in SPLITS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_SPLIT_TYPES)], names=names)

    return run


SPLITS = "model int, node int, chunk int, gain double, feature int, cut int, to_left boolean, gl double, hl double, g double, h double"
_SPLIT_TYPES = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.int32(), pa.bool_()] + [pa.float64()] * 4


class _Grower:
    """The tree a model is growing, node by node."""

    def __init__(self, setting: Setting):
        self.setting, self.rows, self.open = setting, [[-1, -1, -1, -1, False, 0.0, 0.0]], [0]

    def arrays(self) -> tuple:
        f, c, left, right, miss, value, cover = (np.array(v) for v in zip(*self.rows, strict=True))
        return f.astype(int), c.astype(int), left.astype(int), right.astype(int), miss.astype(bool), value.astype(float), cover.astype(float)

    def take(self, found: dict[int, tuple], last: bool) -> None:
        """Best splits of the open nodes; on the last level their children stay leaves."""
        now, self.open = self.open, []
        s = self.setting
        weight = lambda g, h: -s.rate * g / (h + s.reg) if h + s.reg > 0 else 0.0
        for node in now:
            if node not in found:  # no row of this model: an empty table
                continue
            gain, feature, cut, to_left, gl, hl, g, h = found[node]
            self.rows[node][5:7] = [weight(g, h), h]
            if feature < 0 or gain <= s.least_gain:
                continue
            left = len(self.rows)
            self.rows[node][:5] = [feature, cut, left, left + 1, to_left]
            for cg, ch in ((gl, hl), (g - gl, h - hl)):
                self.rows.append([-1, -1, -1, -1, False, weight(cg, ch), ch])
            if not last:
                self.open += [left, left + 1]


def finished(rows: tuple, cuts: list[np.ndarray]) -> Tree:
    f, c, left, right, miss, value, cover = rows
    threshold = np.array([cuts[a][b] if a >= 0 else 0.0 for a, b in zip(f, c, strict=True)])
    return Tree(f, c, threshold, left, right, miss, value, cover)


def fit(df: DataFrame, features: list[str], target: str, key: str, settings: list[Setting], folds: list[int], marks: tuple[int, ...] = ()) -> tuple[list[Model], dict[int, DataFrame]]:
    """A model for every setting and every fold that it leaves out (-1: none), in that order.

    df has the features (NULL or NaN is missing), the target (rows without one are left out), the
    key that names a row, and `fold`. The second result has the rows with all models' margins
    after so many trees as `marks` says: fold, label, margins (one double per model).
    """
    models = [(s, f) for s in settings for f in folds]
    double = [F.col(c).cast("double").alias(c) for c in [*features, target]]
    data = df.select(F.xxhash64(F.col(key), F.lit(42)).alias("row"), F.col("fold").cast("int").alias("fold"), *double).withColumnRenamed(target, "label").where(F.col("label").isNotNull() & ~F.isnan("label"))
    data = data.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in features})
    cuts = cuts_of(data, features)
    sums = {r.fold: (r.n, r.s) for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")).collect()}  # a row per fold
    mean = lambda out: sum(s for f, (_, s) in sums.items() if f != out) / max(1, sum(n for f, (n, _) in sums.items() if f != out))
    bases = np.array([mean(f) for _, f in models])
    few = max(1, min(data.rdd.getNumPartitions(), sum(n for n, _ in sums.values()) // LEAST_ROWS))
    rows = materialise(data.coalesce(few).mapInArrow(_binned(features, cuts, len(models), bases), BINNED), "binned")
    offsets = _offsets(cuts)
    p, recent = len(features), [[] for _ in models]
    grown: list[list[tuple]] = [[] for _ in models]
    seen: dict[int, DataFrame] = {}
    total = max(s.trees for s in settings)
    for number in range(total):
        growers = [_Grower(s) if number < s.trees else None for s, _ in models]
        for level in range(max(s.depth for s in settings)):
            open_nodes = [{n: i for i, n in enumerate(g.open)} if g is not None and level < g.setting.depth else {} for g in growers]
            if not any(open_nodes):
                break
            growing = [g.arrays() if g is not None else None for g in growers]
            parts = rows.mapInArrow(_level(offsets, models, number, recent, growing, open_nodes), "model int, node int, chunk int, sums binary")
            spread = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, sum(map(len, open_nodes))))
            met = parts.repartition(spread, "model", "node", "chunk").sortWithinPartitions("model", "node", "chunk")
            found: list[dict[int, tuple]] = [{} for _ in models]
            for r in sorted(met.mapInArrow(_splits([s for s, _ in models], offsets), SPLITS).collect(), key=lambda r: r.chunk):
                best = found[r.model].get(r.node)
                if best is None or r.gain > best[0] + 1e-12:
                    found[r.model][r.node] = tuple(r[3:])
            for g, f in zip(growers, found, strict=True):
                if g is not None and level < g.setting.depth:
                    g.take(f, level + 1 == g.setting.depth)
        for m, g in enumerate(growers):
            if g is not None:
                grown[m].append(g.arrays())
                recent[m].append(grown[m][-1])
        if (number + 1) % TREES_A_CUT == 0 or number + 1 in marks or number + 1 == total:
            rows = materialise(rows.mapInArrow(_moved(p, len(models), recent), BINNED), "margins")
            recent = [[] for _ in models]
            if number + 1 in marks:
                seen[number + 1] = rows.select("fold", "label", "margins")
    return [Model(float(b), [finished(t, cuts) for t in trees]) for b, trees in zip(bases, grown, strict=True)], seen


def _moved(p: int, m: int, recent: list[list[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, _, bins, margins = _read(batch, p, m)
                _advance(bins, margins, recent)
                yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array([r.tobytes() for r in margins], pa.binary()))

    return run


# --- models as tables ---------------------------------------------------------------------------

NODES = "tree int, node int, feature int, cut int, threshold double, left int, right int, missing_left boolean, value double, cover double"


def write(spark, model: Model, path: str) -> None:
    """A model as one parquet table of nodes; the base is node -1 of tree -1."""
    rows = [(-1, -1, -1, -1, 0.0, -1, -1, False, model.base, 0.0)]
    for i, t in enumerate(model.trees):
        rows += [(i, n, int(f), int(c), float(h), int(a), int(b), bool(m), float(v), float(w)) for n, (f, c, h, a, b, m, v, w) in enumerate(zip(t.feature, t.cut, t.threshold, t.left, t.right, t.missing_left, t.value, t.cover, strict=True))]
    spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(path)


def read(spark, path: str) -> Model:
    rows = spark.read.schema(NODES).parquet(path).orderBy("tree", "node").toPandas()
    trees = [Tree(*[t[c].to_numpy() for c in ("feature", "cut", "threshold", "left", "right", "missing_left", "value", "cover")]) for i, t in rows.groupby("tree") if i >= 0]
    return Model(float(rows.loc[rows["tree"] == -1, "value"].iloc[0]), trees)
