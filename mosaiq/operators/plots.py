"""The tables behind the plots: counts, histograms, box summaries, densities, colours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import outlier, scaled
from .neighbours import thick_boundary, with_neighbours


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value (whole number), n: how often each occurs; missing values are left out."""
    whole = F.col(column).cast("long").alias("value")
    return df.where(F.col(column).isNotNull()).select(whole).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bin, low, n over bins of `width` from floor(min) to ceil(max); the last is closed.

    The range is that of all rows; empty bins are not listed.
    """
    known = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    ends = known.agg(F.floor(F.min(column)).alias("lo"), F.ceil(F.max(column)).alias("hi")).first()
    if ends.lo is None:
        return known.select(*by, F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("low"), F.lit(0).cast("long").alias("n"))
    lo, bins = int(ends.lo), max(1, math.ceil((int(ends.hi) + width - int(ends.lo)) / width) - 1)
    at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("long")
    return known.select(*by, at.alias("bin")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")).select(*by, "bin", (F.lit(float(lo)) + F.col("bin") * width).alias("low"), "n")


def box_summary(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 interquartile ranges, and how many values lie outside."""
    known = df.where(F.col(column).isNotNull()).select(F.col(by), F.col(column).cast("double").alias("v"))
    q = known.groupBy(by).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    q = q.select(by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    limits = known.join(q.select(by, "q1", "q3"), by).groupBy(by).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("n_outside")
    )
    return q.join(limits, by)


def density(df: DataFrame, column: str, by: str, grid: int = 32) -> DataFrame:
    """Gaussian kernel density on `grid` points from three bandwidths below to three above.

    Scott's bandwidth: sample deviation times n^(-1/5). Groups of fewer than two values or
    without spread have none. Equal values are counted once before the grid is laid over them.
    """
    known = df.where(F.col(column).isNotNull()).select(F.col(by), F.col(column).cast("double").alias("v")).groupBy(by, "v").agg(F.count(F.lit(1)).alias("w"))
    s1, n = F.sum(F.col("v") * F.col("w")), F.sum("w")
    mean = known.groupBy(by).agg((s1 / n).alias("m"), n.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    dev = known.join(mean, by).groupBy(by).agg(F.sum(F.col("w") * (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).alias("ss"))
    spec = mean.join(dev, by).where((F.col("n") >= 2) & (F.col("ss") > 0)).withColumn("h", F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    spec = spec.select(by, "n", "h", (F.col("lo") - 3 * F.col("h")).alias("from"), ((F.col("hi") - F.col("lo") + 6 * F.col("h")) / (grid - 1)).alias("step"))
    laid = known.join(spec, by).select(by, "v", "w", "n", "h", "from", "step", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    at = F.col("from") + F.col("point") * F.col("step")
    z = (at - F.col("v")) / F.col("h")
    kernel = F.col("w") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return laid.groupBy(by, "point").agg(F.first(at).alias("x"), F.sum(kernel).alias("density"))


def density_2d(df: DataFrame, x: str, y: str, grid: int = 12) -> DataFrame:
    """Product-kernel density of (x, y) on a grid over their ranges, Scott's factor n^(-1/6)."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    s = known.agg(F.count(F.lit(1)).alias("n"), F.stddev("x").alias("sx"), F.stddev("y").alias("sy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if s.n < 2 or not s.sx or not s.sy:
        return known.select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("density")).limit(0)
    hx, hy = s.sx * s.n ** (-1 / 6), s.sy * s.n ** (-1 / 6)
    at_x, at_y = (np.linspace(lo, hi, grid) for lo, hi in ((s.x0, s.x1), (s.y0, s.y1)))
    sums = known.mapInArrow(_products(at_x, at_y, hx, hy), "i int, j int, v double")
    return sums.groupBy("i", "j").agg((F.sum("v") / (s.n * hx * hy * 2 * math.pi)).alias("density"))


def _products(at_x: np.ndarray, at_y: np.ndarray, hx: float, hy: float):
    """The kernel is a product, so a partition's sums over the grid are one matrix product."""

    def run(batches):
        total = np.zeros((len(at_x), len(at_y)))
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            total += np.exp(-0.5 * ((at_x[None, :] - x[:, None]) / hx) ** 2).T @ np.exp(-0.5 * ((at_y[None, :] - y[:, None]) / hy) ** 2)
        i, j = (v.ravel() for v in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    return run


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """lattice, ix, iy, n: counts per hexagon of two interleaved lattices, empty ones left out."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    r = known.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r.x0 is None:
        return known.select(F.lit(1).alias("lattice"), F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"), F.lit(0).cast("long").alias("n"))
    ny = int(gridsize / math.sqrt(3))
    u = (F.col("x") - r.x0) / (((r.x1 - r.x0) or 1.0) / gridsize)
    v = (F.col("y") - r.y0) / (((r.y1 - r.y0) or 1.0) / ny)
    at = known.select(u.alias("u"), v.alias("v")).select("u", "v", F.rint("u").alias("a"), F.rint("v").alias("b"), F.floor("u").alias("c"), F.floor("v").alias("d"))
    near1 = (F.col("u") - F.col("a")) * (F.col("u") - F.col("a")) + 3 * (F.col("v") - F.col("b")) * (F.col("v") - F.col("b"))
    du, dv = F.col("u") - F.col("c") - 0.5, F.col("v") - F.col("d") - 0.5
    first = near1 < du * du + 3 * dv * dv
    cell = at.select(F.when(first, 1).otherwise(2).alias("lattice"), F.when(first, F.col("a")).otherwise(F.col("c")).cast("long").alias("ix"), F.when(first, F.col("b")).otherwise(F.col("d")).cast("long").alias("iy"))
    return cell.groupBy("lattice", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def degree_outliers(nodes: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return nodes.withColumn("is_outlier", outlier(F.col(column), low, high))


def node_sizes(nodes: DataFrame, column: str, low: float = 50.0, high: float = 500.0) -> DataFrame:
    """Nodes with size: the column scaled to [low, high] within each image; missing values are 0."""
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    ends = nodes.groupBy("image_id").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return nodes.join(ends, "image_id").withColumn("size", scaled(value, F.col("__lo"), F.col("__hi"), low, high)).drop("__lo", "__hi")


def colour_scheme(df: DataFrame, column: str, by: str = "image_id") -> DataFrame:
    """by, n_values, scheme: few whole numbers get a qualitative palette, others a continuous one."""
    whole = F.bool_and(F.col(column) == F.floor(column))
    s = df.where(F.col(column).isNotNull()).groupBy(by).agg(F.count_distinct(column).alias("n_values"), whole.alias("whole"))
    n = F.col("n_values")
    scheme = F.when(F.col("whole") & n.between(2, 10), "tab10").when(F.col("whole") & n.between(11, 20), "tab20").otherwise("continuous")
    return s.select(by, "n_values", scheme.alias("scheme"))


def coloured_pixels(pixels: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pixels with their region's value; unknown regions get the image's least, background NULL."""
    floor_value = values.groupBy("image_id").agg(F.min(column).alias("__least"))
    joined = pixels.join(values.select("image_id", "label", F.col(column).alias("value")), ["image_id", "label"], "left").join(floor_value, "image_id", "left")
    return joined.select("image_id", "y", "x", "label", F.when(F.col("label") > 0, F.coalesce("value", "__least")).alias("value"))


def backdrop(pixels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """image_id, y, x, red, green, blue: what lies behind a network plot.

    images(image_id, y, row) are picture rows, cropped as those that were segmented; a grey picture
    gives all three bands. Where an image has no picture, or the picture ends before the raster,
    the thick boundaries of the raster are white on black.
    """
    near = with_neighbours(pixels)
    walls = thick_boundary(near).select("image_id", "y", "x", F.lit(255).alias("wall"))
    ground = pixels.select("image_id", "y", "x").join(walls, ["image_id", "y", "x"], "left").withColumn("wall", F.coalesce("wall", F.lit(0)))
    if images is None:
        return ground.select("image_id", "y", "x", *[F.col("wall").alias(c) for c in ("red", "green", "blue")])
    seen = images.where(F.col("row").isNotNull()).select("image_id", "y", F.posexplode("row").alias("x", "bands"))
    band = lambda i: F.coalesce(F.get("bands", F.lit(i)), F.get("bands", F.lit(0))).cast("int")
    joined = ground.join(seen, ["image_id", "y", "x"], "left")
    return joined.select("image_id", "y", "x", *[F.coalesce(band(i), F.col("wall")).alias(c) for i, c in enumerate(("red", "green", "blue"))])


def network_nodes(points: DataFrame, details: DataFrame, size: str = "area", colour: str = "area") -> DataFrame:
    nodes = points.join(details.select("image_id", "label", F.col(size).alias("__size"), F.col(colour).cast("double").alias("colour")), ["image_id", "label"], "left").fillna({"colour": 0.0})
    return node_sizes(nodes, "__size").drop("__size")


def ordered_samples(details: DataFrame, external: DataFrame, column: str, order: str) -> DataFrame:
    """sample, position, value: the column's values of samples that the order column knows, by it."""
    known = external.where(F.col(order).isNotNull()).select(F.col("sample_id").cast("string").alias("sample"), F.col(order).alias("by"))
    ranks = known.withColumn("position", F.dense_rank().over(Window.orderBy("by", "sample")))  # one row per sample
    return details.join(ranks, "sample").select("sample", "position", F.col(column).alias("value"))


def match_details(masks: DataFrame, details: DataFrame) -> DataFrame:
    """Each mask's details file: one ending in {parent}_{id}_details.csv, else in {id}_details.csv.

    masks(parent, id), details(path); the precise ending wins, then the smaller path. Files meet
    masks by their ending's words, not by comparing all with all.
    """
    words = F.split(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"_details\.csv$", ""), "_")
    named = details.where(F.endswith("path", F.lit("_details.csv"))).select("path", words.alias("w"))
    # every ending of the words is a possible id
    endings = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.size("w")), "_"))
    byid = named.select("path", F.explode(endings).alias("ending"))
    precise = masks.select("parent", "id", F.concat_ws("_", "parent", "id").alias("ending"), F.lit(0).alias("rank"))
    broad = masks.select("parent", "id", F.col("id").alias("ending"), F.lit(1).alias("rank"))
    found = precise.unionByName(broad).join(byid, "ending")
    best = found.groupBy("parent", "id").agg(F.min(F.struct("rank", "path")).alias("m"))
    return masks.join(best, ["parent", "id"], "left").select("parent", "id", F.col("m.path").alias("path"))


def ranked(column: Column) -> Column:
    """Descending order with missing and NaN values last."""
    return F.when(~F.isnan(column), column).desc_nulls_last()
