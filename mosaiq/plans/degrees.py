"""All plot tables of a study's degrees in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, plots

#: The defaults of the plot scripts' options.
CONFIG = {"degree": "delaunay_degree_fixed_50", "property": "area", "low": 3, "high": 7, "distance": 50.0, "bin_width": 1.0, "order": "Hc20"}


def image_tables(details: DataFrame, pixels: DataFrame, config: dict | None = None) -> dict[str, DataFrame]:
    """Histogram, value counts, degree against property, outliers, colours and the network of each image."""
    c = {**CONFIG, **(config or {})}
    degree, prop = c["degree"], c["property"]
    points = details.select("image_id", "label", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"))
    return {
        "histogram": plots.histogram(details, degree, c["bin_width"], ("image_id",)),
        "counts": plots.value_counts(details, degree),
        "scatter": details.select("image_id", "label", degree, prop),
        "hexbin": plots.hexbin(details, degree, prop),
        "density": plots.density_2d(details, degree, prop),
        "outliers": plots.degree_outliers(details.select("image_id", "label", degree), degree, c["low"], c["high"]),
        "outlier_pixels": plots.coloured_pixels(pixels, plots.degree_outliers(details, degree, c["low"], c["high"]).withColumn("flag", F.col("is_outlier").cast("double")), "flag"),
        "colouring": plots.coloured_pixels(pixels, details, degree),
        "scheme": plots.colour_scheme(details, degree),
        "nodes": plots.network_nodes(points, details, prop, degree),
        "edges": graph.delaunay(points, 0).where(F.col("weight") <= c["distance"]),
    }


def comparison_tables(details: DataFrame, external: DataFrame, columns: list[str], order: str = CONFIG["order"]) -> dict[str, DataFrame]:
    """Ordered values, box summaries, densities and histograms of several columns over samples.

    details has a column sample; columns that it lacks give no rows.
    """
    present = [c for c in columns if c in details.columns]
    if not present:
        empty = details.sparkSession.createDataFrame([], "feature string, sample string, position int, value double")
        return {"values": empty}
    long = details.select(F.col("sample").cast("string").alias("sample"), *[F.col(c).cast("double").alias(c) for c in present]).unpivot(["sample"], present, "feature", "value")
    known = external.where(F.col(order).isNotNull()).select(F.col("sample_id").cast("string").alias("sample"), F.col(order).alias("by"))
    values = plots.ordered_samples(long.withColumn("pair", F.struct("feature", "value")), known.withColumnRenamed("sample", "sample_id").withColumnRenamed("by", order), "pair", order)
    values = values.select("value.feature", "sample", "position", F.col("value.value").alias("value"))
    group = values.withColumn("group", F.concat_ws("|", "feature", "sample"))
    return {
        "values": values,
        "box": plots.box_summary(group, "value", "group"),
        "density": plots.density(group, "value", "group"),
        "histogram": plots.histogram(group, "value", 1.0, ("feature", "sample")),
    }
