"""Scalar column functions and whole-table cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise


def number(c: str) -> Column:
    """A column coerced to double: NULL where it is not a number, and for NaN."""
    value = F.col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def finite_or_zero(c: Column) -> Column:
    """NaN and infinities become 0; NULL stays NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def sample_of_file(name: Column) -> Column:
    """The part of a file name before its first underscore."""
    return F.regexp_extract(name, r"^([^_]+)", 1)


def sample_of_path(path: Column) -> Column:
    """The first directory of a relative path; without one, the base name less extension and trailing number."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.when(F.contains(path, F.lit("/")), F.element_at(F.split(path, "/"), 1)).otherwise(F.regexp_replace(base, r"_\d+$", ""))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: number(c) for c in columns})


def present_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that hold at least one value (one aggregate row reaches the driver)."""
    if not columns:
        return []
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c]]


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs become the column's mean; a column without values becomes 0."""
    if not columns:
        return df
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(means[c] or 0.0))) for c in columns})


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean imputed, then mean 0 and population deviation 1; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns], *[(F.count(F.lit(1)) / F.greatest(F.count(c), F.lit(1))).alias(f"{c}_r") for c in columns]).first()
    out = {}
    for c in columns:
        mean = float(stats[f"{c}_m"] or 0.0)
        # imputed rows sit at the mean and only widen the count
        spread = float(stats[f"{c}_s"] or 0.0) / float(stats[f"{c}_r"] or 1.0) ** 0.5
        value = (F.coalesce(F.col(c), F.lit(mean)) - mean) / spread if spread else F.lit(0.0)
        out[c] = value
    return df.withColumns(out)


def outlier(value: Column, low: float, high: float) -> Column:
    """True outside [low, high]; a missing value is no outlier."""
    return F.coalesce((value < low) | (value > high), F.lit(False))


def scaled(value: Column, least: Column, greatest: Column, low: float, high: float) -> Column:
    """Min-max scaling to [low, high]; the middle where all values are equal."""
    span = greatest - least
    return F.when(span > 0, low + (value - least) / span * (high - low)).otherwise(F.lit((low + high) / 2))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of df (a top-n, so no row is shuffled that cannot be among them), by a hash of a whole-number key.

    The hash is Knuth's multiplicative one modulo a prime: plain arithmetic, equal in every engine.
    """
    at = F.pmod(F.pmod(F.col(key) + seed, F.lit(2_147_483_647)) * F.lit(2_654_435_761 % 2_147_483_647), F.lit(2_147_483_647))
    return df.orderBy(at, key).limit(n)


def number_within(df: DataFrame, keys: list[str], order: list[str], to: str) -> DataFrame:
    """1-based number of each row within its keys, by order (NULL first), without a task per key.

    The whole table is sorted by range of keys and order together, so a hot key spreads over as
    many partitions as it needs, whichever of its order columns varies. A row's number is its
    place in its partition, counted on from where the partition's share of the key begins.
    """
    # equal rows are told apart by a number of their own, so they can be parted too
    ranked = df.withColumn("__salt", F.monotonically_increasing_id()).orderBy(*keys, *order, "__salt").drop("__salt")
    ranked = materialise(ranked.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranked")
    runs = ranked.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = runs.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), (F.col("__first") - F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__zero"))
    same = ranked["__part"] == starts["__p"]
    for i, k in enumerate(keys):
        same = same & ranked[k].eqNullSafe(starts[f"__{i}"])
    numbered = ranked.join(starts, same).withColumn(to, (F.col("__at") - F.col("__zero") + 1).cast("long"))
    return numbered.select(*df.columns, to)
