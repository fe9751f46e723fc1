"""The study after feature extraction: reliable features, filters, correlations, models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import models, select, stats

META = ("Sample", "Rater", "sample_id", "seq")


def prepare(features: DataFrame, sample: str = "sample_id", order: str | list[str] = "seq") -> tuple[DataFrame, list[str]]:
    """Sample, Rater (1.. by order within the sample) and the numeric features that hold values."""
    by = [order] if isinstance(order, str) else order
    names = [c for c in features.columns if c not in (sample, *by, *META)]
    numbered = columns.number_within(features, [sample], by, "Rater").withColumnRenamed(sample, "Sample")
    coerced = columns.coerce_numeric(numbered, names)
    kept = columns.present_columns(coerced, names)
    return coerced.select("Sample", "Rater", *kept), kept


def select_features(features: DataFrame, icc_threshold: float = 0.75, corr_threshold: float = 0.95, max_raters: int = 8, alpha: float = 0.05, sample: str = "sample_id", order: str | list[str] = "seq") -> tuple[DataFrame, DataFrame]:
    """(results, selected): ICC and ANOVA by feature, and sample means of the features kept.

    If no feature could be scored at all, all go on; if some could and none is good, none does.
    """
    data, names = prepare(features, sample, order)
    long = stats.unpivot(data.withColumnRenamed("Sample", "sample").withColumnRenamed("Rater", "rater"), ["sample", "rater"], names)
    results = stats.good_features(stats.icc3k(long, max_raters), stats.anova(long, alpha, len(names)))
    rows = {r.feature: r for r in results.collect()}  # one row per feature
    scored = [n for n in names if n in rows and rows[n].icc is not None]
    good = [n for n in names if n in rows and rows[n].good_feature] if scored else names
    means = data.groupBy("Sample").agg(*[F.avg(c).alias(c) for c in good]) if good else data.select("Sample").distinct()
    if good:
        kept = select.correlation_filter(means, select.variance_filter(means, good), corr_threshold)
        means = means.select("Sample", *kept)
    return results, means


def correlate(features: DataFrame, external: DataFrame, key: str = "sample_id") -> DataFrame:
    """target_group, feature, target, corr for the groups whose targets the external table has."""
    merged = select.merge_external(features, external, key)
    names = [c for c in features.columns if c != key and c in merged.columns]
    out = None
    for group, targets in select.TARGET_GROUPS.items():
        part = select.feature_target_correlation(merged, names, [t for t in targets if t in merged.columns]).withColumn("target_group", F.lit(group))
        out = part if out is None else out.unionByName(part)
    return out.select("target_group", "feature", "target", "corr")


def report(correlations: DataFrame) -> DataFrame:
    """The correlations with each group's features ordered by its first target, missing ones last."""
    first = correlations.groupBy("target_group").agg(F.min("target").alias("first"))
    lead = correlations.join(first, "target_group").where(F.col("target") == F.col("first")).select("target_group", "feature", F.col("corr").alias("lead"))
    return correlations.join(lead, ["target_group", "feature"]).orderBy("target_group", F.col("lead").desc_nulls_last(), "feature", "target").drop("lead")


def model(features: DataFrame, external: DataFrame, target: str, key: str = "sample_id", grids: dict | None = None, k: int = 5, trees: int = 100) -> dict[str, DataFrame]:
    """Selected features, compared models, importances and attributions for one target.

    Cross-validated fits fill gaps by the means outside the held-out fold, the final ones by those
    of all rows. Features without any value are left out. The attribution is that of the best model.
    """
    merged = select.merge_external(features, external, key)
    names = [c for c in features.columns if c != key and c in merged.columns]
    data = columns.coerce_numeric(merged, [*names, target]).where(F.col(target).isNotNull())
    names = columns.present_columns(data, names)
    kept, trail = models.recursive_elimination(data, names, target, key, trees=trees, k=k)
    spark = features.sparkSession
    compared = models.compare_models(data, kept, target, key, grids, k)
    best = compared.first()
    return {
        "selected": spark.createDataFrame([(c,) for c in kept], "feature string"),
        "elimination": spark.createDataFrame(trail, "n_features int, cv_r2 double"),
        "models": compared,
        "importance": models.feature_importance(data, kept, target, trees),
        "attribution": models.mean_attribution(data, kept, target, key, best.model, json.loads(best.best_params)),
    }
