"""Label rasters as relations.

pixels(image_id, y, x, label) holds a dense raster: each image has every (y, x) of its frame,
label 0 is background. Rows can also be held as bands (image_id, y, labels), one array per
raster row, or as images (image_id, labels), an array of such rows. Neighbouring pixels meet in
these forms without a join per offset; operators that say so take any of the three.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id string, y int, x int, label int"
IMAGES = "image_id string, labels array<array<int>>"

#: The synthetic raster: frame, lattice cell, seeds per row and image, least gap between cells.
HEIGHT, WIDTH = 96, 128
CELL_Y, CELL_X = 19, 16
SEED_COLUMNS, SEEDS = 8, 40
GAP = 1.5


def _seeds(part: DataFrame) -> DataFrame:
    n = F.col("p_partkey") % SEEDS
    row, column = F.floor(n / SEED_COLUMNS).cast("int"), (n % SEED_COLUMNS).cast("int")
    key, size = F.col("p_partkey"), F.col("p_size")
    return part.select(
        F.floor(key / SEEDS).cast("string").alias("image_id"),
        (n + 1).cast("int").alias("seed"),
        row.alias("row"),
        column.alias("column"),
        (row * CELL_Y + 5 + (size * 7 + key * 3) % 10).cast("int").alias("sy"),
        (column * CELL_X + 3 + (size * 5 + key * 11) % 10).cast("int").alias("sx"),
        key.alias("key"),
        size.alias("size"),
    )


#: Rows of a partition of spread, about: a hundred images of seeds, whatever the table holds.
SPREAD_ROWS = 4000


def spread(df: DataFrame, key: str = "image_id", rows: int | None = None) -> DataFrame:
    """df dealt out by image in partitions of about SPREAD_ROWS rows, over twice the cluster's cores at least.

    For small rows from which much is made or computed: their bytes say nothing about the work,
    so they are not left to the sizing of shuffles. A task's share does not grow with the table;
    df is counted for that, unless rows says for how many. Later groupings by image need no shuffle.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS)), key)


def _draw(seed: np.ndarray, sy: np.ndarray, sx: np.ndarray, gap: float) -> np.ma.MaskedArray:
    """One raster; masked where neither a place's lattice cell nor one around it has a seed."""
    rows = (HEIGHT + CELL_Y - 1) // CELL_Y
    # a place and its seed as one integer, the cells with a rim; a cell without a seed has one far away
    nowhere = (20_000 * 65536 + 20_000) * 64
    packed = np.full((max(rows, SEEDS // SEED_COLUMNS) + 2, SEED_COLUMNS + 2), nowhere)
    at = ((seed - 1) // SEED_COLUMNS + 1, (seed - 1) % SEED_COLUMNS + 1)
    packed[at] = 0
    np.maximum.at(packed, at, (sy * 65536 + sx) * 64 + seed)
    y, x = np.arange(HEIGHT)[:, None], np.arange(WIDTH)[None, :]
    first = second = np.full((HEIGHT, WIDTH), np.iinfo(np.int64).max)
    seen = np.zeros((HEIGHT, WIDTH), bool)
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            c = packed[y // CELL_Y + dy, x // CELL_X + dx]
            py, px = y - (c >> 22), x - (c >> 6 & 65535)
            code = (py * py + px * px) * 64 + (c & 63)  # squared distance and seed in one integer
            first, second = np.minimum(first, code), np.minimum(second, np.maximum(first, code))
            seen |= c != nowhere
    far = np.sqrt(second >> 6) - np.sqrt(first >> 6) >= gap
    return np.ma.masked_array(np.where(far, first & 63, 0).astype(np.int32), ~seen)


def _nested(rasters: list[np.ndarray]) -> pa.ListArray:
    """Rasters as an array of rows each; masked places are null."""
    flat = [np.ma.ravel(r) for r in rasters] or [np.zeros(0, np.int32)]
    values = np.ma.concatenate(flat) if any(np.ma.isMaskedArray(r) for r in flat) else np.concatenate(flat)
    wide = np.concatenate([[0], *[np.full(r.shape[0], r.shape[1]) for r in rasters]])
    high = np.array([0, *[r.shape[0] for r in rasters]])
    off = np.ma.getmaskarray(values) if np.ma.is_masked(values) else None
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum(wide), pa.int32()), pa.array(np.ma.getdata(values).astype(np.int32, copy=False), mask=off))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(high), pa.int32()), inner)


def _drawings(gap: float):
    def run(seeds: pa.Array) -> pa.Array:
        out = []
        for one in seeds:
            points = one.values
            out.append(_draw(*(points.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seed", "sy", "sx")), gap))
        return _nested(out)

    return F.arrow_udf(run, "array<array<int>>")


def synthetic_images(part: DataFrame, gap: float = GAP) -> DataFrame:
    """image_id, labels: the rasters of part's seeds, a pixel to its nearest seed unless the second is near.

    With a gap of 0 every pixel is labelled and the regions touch. The lattice cell of a pixel and
    its eight neighbours hold all seeds that can matter. An image is made from its seeds in one
    go; places without such seeds are null.
    """
    seeds = spread(_seeds(part).where("sy is not null and sx is not null").select("image_id", "seed", "sy", "sx"))
    each = seeds.groupBy("image_id").agg(F.collect_list(F.struct("seed", "sy", "sx")).alias("seeds"))
    return each.select("image_id", _drawings(gap)("seeds").alias("labels"))


def synthetic_pixels(part: DataFrame, gap: float = GAP) -> DataFrame:
    """The same as pixels, without the places that no seed is near; whole images are dealt out before."""
    return flat(spread(synthetic_images(part, gap), rows=part.count()))


def synthetic_points(part: DataFrame) -> DataFrame:
    """image_id, label, y, x: the seeds with sub-pixel jitter, in general position."""
    s = _seeds(part)
    key, size = F.col("key"), F.col("size")
    return s.select(
        "image_id",
        F.col("seed").alias("label"),
        (F.col("sy") + F.lit(0.0001) * ((key * 7919 + size * 977) % 9739) / 10).alias("y"),
        (F.col("sx") + F.lit(0.0001) * ((key * 6007 + size * 131) % 8887) / 10).alias("x"),
    )


def load_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")


def raster(spark: SparkSession, sf_dir: str, gap: float = GAP) -> DataFrame:
    """The rasters of part's seeds, as images."""
    return synthetic_images(load_part(spark, sf_dir), gap)


def pixels(spark: SparkSession, sf_dir: str, gap: float = GAP) -> DataFrame:
    return synthetic_pixels(load_part(spark, sf_dir), gap)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic_points(load_part(spark, sf_dir))


def bands(pixels: DataFrame) -> DataFrame:
    """image_id, y, labels: one array per raster row, in order of x, from a raster in any form."""
    if "labels" in pixels.columns:
        return pixels if "y" in pixels.columns else pixels.select("image_id", F.posexplode("labels").alias("y", "labels"))
    row = F.array_sort(F.collect_list(F.struct("x", "label")))
    return pixels.groupBy("image_id", "y").agg(row.alias("row")).select("image_id", "y", F.col("row.label").alias("labels"))


def images(pixels: DataFrame) -> DataFrame:
    """image_id, labels: each raster as an array of rows, from any form. An image must fit in one worker."""
    if "labels" in pixels.columns and "y" not in pixels.columns:
        return pixels
    rows = F.array_sort(F.collect_list(F.struct("y", "labels")))
    return bands(pixels).groupBy("image_id").agg(rows.alias("rows")).select("image_id", F.col("rows.labels").alias("labels"))


def flat(rasters: DataFrame) -> DataFrame:
    """A raster in any form as pixels; null places of an array are none."""
    if "labels" not in rasters.columns:
        return rasters
    return bands(rasters).select("image_id", "y", F.posexplode("labels").alias("x", "label")).where("label is not null")


def background(rasters: DataFrame) -> DataFrame:
    """Images whose label is 1 where it was 0, and 0 elsewhere."""
    return rasters.select("image_id", F.transform("labels", lambda row: F.transform(row, lambda v: (v == 0).cast("int"))).alias("labels"))


def faults(pixels: DataFrame) -> DataFrame:
    """image_id, missing, repeated, unlabelled of the images that are no whole raster.

    The frame runs from (0, 0) to the greatest row and column. missing: places without a pixel (one
    at a negative place counts against its image as a repeated one); repeated: pixels beyond the
    first of a place; unlabelled: places with a label that is null or below 0.
    """
    place = pixels.groupBy("image_id", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("label") < 0, F.lit(True))).alias("odd"))
    inside = F.coalesce((F.col("y") >= 0) & (F.col("x") >= 0), F.lit(False))
    per = place.groupBy("image_id").agg(
        ((F.max("y") + 1).cast("long") * (F.max("x") + 1) - F.count_if(inside)).alias("missing"),
        F.sum(F.when(inside, F.col("n") - 1).otherwise(F.col("n"))).alias("repeated"), F.count_if("odd").alias("unlabelled"),
    )
    return per.where("missing <> 0 or repeated > 0 or unlabelled > 0")


def require_whole(pixels: DataFrame) -> DataFrame:
    """pixels as they are; a ValueError that names a few images if some are no whole raster."""
    bad = faults(pixels).orderBy("image_id").limit(5).collect()
    if bad:
        raise ValueError("not a whole raster: " + "; ".join(f"{r.image_id}: {r.missing} missing, {r.repeated} repeated, {r.unlabelled} unlabelled" for r in bad))
    return pixels


def _painted(masks: pa.Array, width: pa.Array) -> pa.Array:
    """Rows of (x, mask_id) as arrays of `width` places with the lowest mask, null where there is none."""
    wide = width.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(wide)))
    row = np.repeat(np.arange(len(wide)), np.nan_to_num(masks.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    places = masks.flatten()
    x, mask = (places.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "mask_id"))
    inside = (x >= 0) & (x < wide[row])
    lowest = np.full(start[-1], np.iinfo(np.int64).max)
    np.minimum.at(lowest, start[row[inside]] + x[inside], mask[inside])
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(lowest, mask=lowest == np.iinfo(np.int64).max))


def from_masks(masks: DataFrame, frame: DataFrame) -> DataFrame:
    """Pixels of masks(image_id, mask_id, y, x), where the lowest mask of a pixel wins.

    frame(image_id, height, width) gives each image's size; pixels of no mask get label 0, and
    label k is the k-th mask of the image by mask_id. The masks meet the frame as rows of the
    raster, so no join moves single pixels.
    """
    ids = masks.groupBy("image_id").agg(F.sort_array(F.collect_set(F.col("mask_id").cast("long"))).alias("ids"))
    lines = frame.join(ids.hint("shuffle_hash"), "image_id", "left")
    lines = lines.select("image_id", "width", "ids", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1)).alias("y"))
    rows = masks.groupBy("image_id", "y").agg(F.collect_list(F.struct("x", "mask_id")).alias("row"))
    joined = lines.join(rows.hint("merge"), ["image_id", "y"], "left")
    painted = joined.select("image_id", "y", "ids", F.arrow_udf(_painted, "array<long>")("row", "width").alias("masks"))
    each = painted.select("image_id", "y", "ids", F.posexplode("masks").alias("x", "mask"))
    return each.select("image_id", "y", "x", F.when(F.col("mask").isNull(), 0).otherwise(F.array_position("ids", F.col("mask"))).cast("int").alias("label"))
