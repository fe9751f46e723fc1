"""Feature reliability and group differences on long tables (feature, sample, rater, value)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.special import f_sf, normal_scores, shapiro_ends, shapiro_p, shapiro_weights
from ..plans.scratch import materialise

#: Variances up to this count as zero, whatever the feature's scale.
ZERO_VARIANCE = 1e-8


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys, feature, value: NaN becomes NULL."""
    wide = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    long = wide.unpivot(keys, features, "feature", "value")
    return long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def icc3k(long: DataFrame, max_raters: int = 8) -> DataFrame:
    """feature, icc: (MSB - MSE) / MSB over the samples that every rater rated.

    NULL with fewer than two samples or two raters, fewer than five values, or MSB = 0. Sums of
    squares come from partial aggregates; no window holds a whole feature.
    """
    rated = long.where(F.col("value").isNotNull() & (F.col("rater") <= max_raters))
    raters = rated.groupBy("feature", "rater").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
    per_sample = rated.groupBy("feature", "sample").agg(F.count(F.lit(1)).alias("n")).join(raters, "feature")
    complete = rated.join(per_sample.where("n = k").select("feature", "sample"), ["feature", "sample"], "left_semi")
    total = complete.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.var_pop("value").alias("vt"))
    samples = complete.groupBy("feature", "sample").agg(F.avg("value").alias("m")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.var_pop("m").alias("vs"))
    columns = complete.groupBy("feature", "rater").agg(F.avg("value").alias("m")).groupBy("feature").agg(F.var_pop("m").alias("vr"))
    j = total.join(samples, "feature").join(columns, "feature").join(raters, "feature")
    n, k = F.col("n"), F.col("k")
    msb = n * k * F.col("vs") / (n - 1)
    mse = n * k * F.greatest(F.col("vt") - F.col("vs") - F.col("vr"), F.lit(0.0)) / ((n - 1) * (k - 1))
    usable = (n >= 2) & (k >= 2) & (F.col("values") >= 5)
    scored = j.select("feature", F.when(usable & (F.col("vs") > 0), F.try_divide(msb - mse, msb)).alias("icc"))
    return long.select("feature").distinct().join(scored, "feature", "left")


def anova(long: DataFrame, alpha: float = 0.05, n_features: int | None = None) -> DataFrame:
    """One-way ANOVA of each feature over samples: f, df1, df2, p_value, reject_h0.

    Samples with fewer than two values are left out; fewer than two samples give NULLs. If no
    sample varies, p is 1. The level is divided by the number of features, those skipped included.
    """
    features = long.select("feature").distinct()
    count = n_features or features.count()
    groups = long.where(F.col("value").isNotNull()).groupBy("feature", "sample").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).where("n >= 2")
    s = groups.groupBy("feature").agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.max(F.abs("v")).alias("widest"),
    )
    grand = s.select("feature", (F.col("s1") / F.col("total")).alias("grand"))
    ssb = groups.join(grand, "feature").groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("ssb"))
    j = s.join(ssb, "feature").where("g >= 2")
    d1, d2 = (F.col("g") - 1).cast("double"), (F.col("total") - F.col("g")).cast("double")
    flat = F.col("widest") <= ZERO_VARIANCE
    j = j.select("feature", flat.alias("flat"), F.when(~flat, F.try_divide(F.col("ssb") / d1, F.col("ssw") / d2)).alias("f"), d1.alias("df1"), d2.alias("df2"))
    j = j.withColumn("p_value", F.when(F.col("flat"), 1.0).otherwise(f_sf("f", "df1", "df2")))
    tested = j.select("feature", "f", "df1", "df2", "p_value", (F.col("p_value") < alpha / count).alias("reject_h0"))
    return features.join(tested, "feature", "left").withColumn("reject_h0", F.coalesce("reject_h0", F.lit(False)))


#: Ranks by which an approximate median may be off, as a share of the rows: one in so many.
MEDIAN_ACCURACY = 10_000


def medians(known: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: the exact median of value, whatever the number of distinct values.

    Approximate quantiles of bounded memory bracket the middle; the rows below the bracket are
    counted, and only the distinct values inside it are put in order. A group whose bracket
    misses the middle takes the exact percentile.
    """
    off = 2.0 / MEDIAN_ACCURACY
    ends = known.groupBy(*keys).agg(F.percentile_approx("value", F.array(F.lit(0.5 - off), F.lit(0.5 + off)), F.lit(MEDIAN_ACCURACY)).alias("e"), F.count(F.lit(1)).alias("n"))
    ends = materialise(ends.select(*keys, F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "n"), "brackets")
    placed = known.join(F.broadcast(ends), keys).where("value <= high")  # a row per group is broadcast
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    counted = placed.groupBy(*keys, "n", inside.alias("value")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy("value")  # NULL, the rows below the bracket, first
    ranked = materialise(counted.withColumn("upto", F.sum("c").over(upto)), "ranked")
    at = lambda rank: F.min(F.when(F.col("value").isNotNull() & (F.col("upto") > rank), F.col("value")))
    below = F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0))
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    found = ranked.groupBy(*keys, "n").agg(at(lower).alias("a"), at(upper).alias("b"), below.alias("below"))
    found = found.select(*keys, F.when((F.col("below") <= lower) & F.col("a").isNotNull() & F.col("b").isNotNull(), 0.5 * F.col("a") + 0.5 * F.col("b")).alias("median"))
    found = materialise(found, "medians")
    rest = known.join(F.broadcast(found.where("median is null").select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.percentile("value", 0.5).alias("median"))
    return found.where("median is not null").unionByName(rest)


def deviations(long: DataFrame) -> DataFrame:
    """The long table of distances from each sample's median."""
    known = long.where(F.col("value").isNotNull())
    middle = F.broadcast(medians(known, ["feature", "sample"]))
    return known.join(middle, ["feature", "sample"]).withColumn("value", F.abs(F.col("value") - F.col("median"))).drop("median")


def levene(long: DataFrame) -> DataFrame:
    """feature, f, p_value: Levene's test around medians."""
    return anova(deviations(long)).select("feature", "f", "p_value")


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


@F.pandas_udf(_doubles("inner", "square"))
def _scores(before: pd.Series, count: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normal_scores(b, c, k, shapiro_ends(k)) for b, c, k in zip(before.tolist(), count.tolist(), n.tolist(), strict=True)], columns=["inner", "square"])


@F.pandas_udf(_doubles("w", "p_value"))
def _shapiro(n: pd.Series, outer: pd.Series, second: pd.Series, inner: pd.Series, square: pd.Series, ss: pd.Series) -> pd.DataFrame:
    out = []
    for k, x, y, z, mm, s in zip(n.tolist(), outer, second, inner, square, ss, strict=True):
        if not x or not s > 0:
            out.append((float("nan"), float("nan")))
            continue
        last, next_to, factor = shapiro_weights(k, mm)
        w = min(1.0, (last * x + next_to * y + factor * z) ** 2 / s)
        out.append((w, shapiro_p(w, k)))
    return pd.DataFrame(out, columns=["w", "p_value"])


def normality(long: DataFrame, chunks: int = 32) -> DataFrame:
    """Shapiro-Wilk by feature and sample, on all values of every sample of at least three.

    Equal values collapse first; the ranks of the others come from chunks of each sample (cut at
    its quantiles) and the sizes of the chunks before, so no task holds a whole sample. Samples
    without spread have NULLs. W is exact for any size; p above 5000 values is the same formula
    beyond the range it was fitted on.
    """
    key = ["feature", "sample"]
    known = long.where(F.col("value").isNotNull()).select(*key, "value")
    sizes = known.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.count(F.lit(1)) * F.var_pop("value")).alias("ss"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.percentile_approx("value", [i / chunks for i in range(1, chunks)], 1000).alias("cuts"),
    ).where("n >= 3")
    values = known.groupBy(*key, "value").agg(F.count(F.lit(1)).alias("count"))
    # written once: another run could cut at other approximate quantiles
    sizes = materialise(sizes, "samples")
    parts = values.join(sizes.select(*key, "n", "mean", "cuts"), key).withColumn("chunk", F.size(F.filter(F.array_distinct("cuts"), lambda q: F.col("value") > q))).drop("cuts")
    inside = F.sum("count").over(Window.partitionBy(*key, "chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    filled = parts.groupBy(*key, "chunk").agg(F.sum("count").alias("filled"))
    earlier = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select(*key, "chunk", F.coalesce(F.sum("filled").over(earlier), F.lit(0)).alias("offset"))
    ranked = parts.withColumn("inside", inside).join(offsets, [*key, "chunk"]).withColumn("before", F.col("inside") + F.col("offset"))
    at = lambda rank: F.max(F.when((F.col("before") < rank) & (F.col("before") + F.col("count") >= rank), F.col("value")))
    scored = ranked.withColumn("s", _scores("before", "count", "n"))
    sums = scored.groupBy(*key).agg(
        F.sum(F.col("s.inner") * (F.col("value") - F.col("mean"))).alias("inner"), F.sum("s.square").alias("square"), at(F.lit(2)).alias("second"), at(F.col("n") - 1).alias("next_to_last")
    )
    tested = sizes.join(sums, key).withColumn("t", _shapiro("n", F.col("most") - F.col("least"), F.col("next_to_last") - F.col("second"), "inner", "square", "ss"))
    return tested.select(*key, "t.w", "t.p_value")


def good_features(icc: DataFrame, tested: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Both results by feature, and whether the feature is reliable and tells samples apart."""
    good = F.coalesce((F.col("icc") >= threshold) & ~F.isnan("icc") & F.col("reject_h0"), F.lit(False))
    return icc.join(tested, "feature").withColumn("good_feature", good)
