"""Feature filters and correlations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import coerce_numeric, impute_mean, present_columns


def prepared(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Coerced to numbers, all-missing columns dropped, the rest mean-imputed."""
    coerced = coerce_numeric(df, features)
    kept = present_columns(coerced, features)
    return impute_mean(coerced, kept), kept


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, variance (population), spread (greatest less least)."""
    row = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v_{c}").alias("variance"), F.col(f"r_{c}").alias("spread")) for c in features]))
    stats = df.agg(*[F.var_pop(c).alias(f"v_{c}") for c in features], *[(F.max(c) - F.min(c)).alias(f"r_{c}") for c in features])
    return stats.select(row.alias("s")).select("s.*")


def variance_filter(df: DataFrame, features: list[str], threshold: float = 0.0) -> list[str]:
    """Features whose variance exceeds the threshold; all of them if none does.

    At threshold 0 a feature must also have a spread, so rounding noise does not count.
    """
    data, kept = prepared(df, features)
    if not kept:
        return []
    rows = {r.feature: (r.variance if threshold else min(r.variance, r.spread)) for r in variances(data, kept).collect()}  # one row per feature
    chosen = [c for c in kept if rows[c] is not None and rows[c] > threshold]
    return chosen or kept


def _gram(columns: list[str], centre: np.ndarray):
    def run(batches):
        p = len(columns)
        n, s, q, g = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) - centre if batch.num_rows else np.zeros((0, p))
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            mf = m.astype(float)
            n += mf.T @ mf
            s += x.T @ mf
            q += (x * x).T @ mf
            g += x.T @ x
        i, j = np.triu_indices(p, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(v) for v in (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], g[i, j]))],
            names=["i", "j", "n", "sa", "sb", "qa", "qb", "g"],
        )

    return run


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """feature_a, feature_b (a before b in the list), corr over complete pairs, NULL if constant.

    Each partition sums its cross products around the column means with one matrix product; only
    one row per pair and partition is shuffled, however many rows the table has.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    means = values.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in features]).first()
    centre = np.array([means[c] or 0.0 for c in features])
    sums = values.mapInArrow(_gram(features, centre), "i int, j int, n double, sa double, sb double, qa double, qb double, g double")
    t = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "g")])
    n = F.col("n")
    va, vb = F.col("qa") - F.col("sa") * F.col("sa") / n, F.col("qb") - F.col("sb") * F.col("sb") / n
    r = (F.col("g") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb)
    name = F.array(*[F.lit(c) for c in features])
    usable = (n > 0) & (va > 1e-12 * F.col("qa")) & (vb > 1e-12 * F.col("qb"))
    return t.where("n > 0").select(F.element_at(name, F.col("i") + 1).alias("feature_a"), F.element_at(name, F.col("j") + 1).alias("feature_b"), F.when(usable, r).alias("corr"))


def greedy_drop(features: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """What stays after repeatedly dropping the feature with most partners among pairs.

    Among equals the first whose name ends in _std goes, else the first, in column order.
    """
    partners: dict[str, set[str]] = {f: set() for f in features}
    for a, b in pairs:
        partners[a].add(b)
        partners[b].add(a)
    kept = list(features)
    while True:
        most = max((len(partners[f]) for f in kept), default=0)
        if not most:
            return kept
        worst = [f for f in kept if len(partners[f]) == most]
        drop = next((f for f in worst if f.endswith("_std")), worst[0])
        kept.remove(drop)
        for other in partners.pop(drop):
            partners[other].discard(drop)


def correlation_filter(df: DataFrame, features: list[str], threshold: float = 0.95) -> list[str]:
    """Features left when none correlates above the threshold with another.

    The matrix is computed once (removals do not change it); the greedy choice runs over the
    pairs above the threshold, at most as many as features squared.
    """
    data, kept = prepared(df, features)
    if len(kept) < 2:
        return kept
    strong = correlation_matrix(data, kept).where(F.abs("corr") > threshold).select("feature_a", "feature_b").collect()
    return greedy_drop(kept, [(r.feature_a, r.feature_b) for r in strong])


def _masked(left: list[str], right: list[str], centre: np.ndarray):
    """A partition's counts, sums, squares and products of each pair over the rows that have both."""

    def run(batches):
        p = len(left)
        sums = np.zeros((6, p, len(right)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in [*left, *right]]) - centre
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            (a, b), (ma, mb) = (x[:, :p], x[:, p:]), (m[:, :p], m[:, p:])
            sums += np.array([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])
        i, j = (v.ravel() for v in np.indices(sums.shape[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(v.ravel()) for v in sums)], names=["i", "j", "n", "sa", "sb", "qa", "qb", "g"])

    return run


def feature_target_correlation(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """feature, target, corr of each pair over the rows that have both; NULL where a side is constant.

    Names that the table lacks are left out. One pass: a partition gives a row per pair, from six
    matrix products of values and masks around the column means, however many rows it has.
    """
    fs, ts = [c for c in features if c in df.columns], [c for c in targets if c in df.columns]
    if not fs or not ts:
        return df.sparkSession.createDataFrame([], "feature string, target string, corr double")
    clean = coerce_numeric(df, sorted({*fs, *ts}))
    # a name can be feature and target at once
    values = clean.select(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fs)], *[F.col(c).alias(f"t{i}") for i, c in enumerate(ts)])
    means = values.agg(*[F.avg(c) for c in values.columns]).first()
    run = _masked(values.columns[: len(fs)], values.columns[len(fs) :], np.array([v or 0.0 for v in means]))
    sums = values.mapInArrow(run, "i int, j int, n double, sa double, sb double, qa double, qb double, g double")
    t = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "g")])
    n = F.col("n")
    n = F.nullif(n, F.lit(0.0))
    va, vb = F.col("qa") - F.col("sa") * F.col("sa") / n, F.col("qb") - F.col("sb") * F.col("sb") / n
    usable = (va > 1e-12 * F.col("qa")) & (vb > 1e-12 * F.col("qb"))
    corr = F.when(usable, F.try_divide(F.col("g") - F.col("sa") * F.col("sb") / n, F.sqrt(va * vb)))
    name = lambda names, at: F.element_at(F.array(*[F.lit(c) for c in names]), F.col(at) + 1)
    return t.select(name(fs, "i").alias("feature"), name(ts, "j").alias("target"), corr.alias("corr"))


#: Target groups of the external measurements.
TARGET_GROUPS = {"props": ["Br20", "Hc20", "Hc147", "Hr20", "Hr147"], "pps": ["C", "F", "J", "L"], "effs": ["Neff", "alpha"], "pcs": ["PC5-X10000A"]}


def merge_external(features: DataFrame, external: DataFrame, key: str = "sample_id") -> DataFrame:
    """Inner join on the key; columns that both sides have get the suffixes _x and _y."""
    shared = (set(features.columns) & set(external.columns)) - {key}
    left = features.select(*[F.col(c).alias(f"{c}_x" if c in shared else c) for c in features.columns])
    right = external.select(*[F.col(c).alias(f"{c}_y" if c in shared else c) for c in external.columns])
    return left.join(right, key, "inner")
