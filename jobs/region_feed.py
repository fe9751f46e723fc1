"""Region tables that follow a growing folder of seeds, image by image.

    python -m jobs.region_feed INPUT OUT CHECKPOINT [--config FILE]

INPUT is a folder or a pattern of parquet files (p_partkey, p_size: the seeds of the synthetic
rasters). A file stream takes the files that came since the last run, until none is left. Its
checkpoint is the mark of what has been taken. Below OUT, partitioned by block of images:

    seeds/    every seed taken, also by the batch that brought it
    regions/  a row per region: geometry, and whether its area is an outlier
    images/   a row per image

A batch writes its seeds, then makes the blocks that it touches anew from all their seeds, so an
image may come in parts. It overwrites only its own partitions: a batch that is run again after a
failure leaves the same. Of a seed that came several times the last batch counts.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.columns import outlier
from mosaiq.operators import regions
from mosaiq.sources import raster

from . import config

log = logging.getLogger("jobs.region_feed")

SEEDS = "p_partkey long, p_size int"
WRITTEN = {
    "seeds": SEEDS + ", block long, batch long",
    "regions": "image_id string, label int, area long, centroid_y double, centroid_x double, equivalent_diameter double, rectangularity double, outlier boolean, block long",
    "images": "image_id string, regions long, area_mean double, area_std double, outliers long, block long",
}


def read(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A written table; `seeds`, `regions` or `images`."""
    return spark.read.schema(WRITTEN[table]).parquet(f"{out}/{table}")


def _write(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that df has rows of, and no others; a partition is written by one task, into one file."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    df.repartition(tasks, *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def region_table(seeds: DataFrame, settings: dict) -> DataFrame:
    """The regions of the seeds' rasters."""
    block = F.floor(F.col("image_id").cast("long") / settings["images_per_block"]).alias("block")
    odd = outlier(F.col("area"), settings["area_low"], settings["area_high"]).alias("outlier")
    found = regions.geometry(regions.sums(raster.synthetic_images(seeds), 1))
    return found.select("image_id", "label", "area", "centroid_y", "centroid_x", "equivalent_diameter", "rectangularity", odd, block)


def image_table(found: DataFrame) -> DataFrame:
    """Number, size and outliers of each image's regions."""
    return found.groupBy("block", "image_id").agg(
        F.count(F.lit(1)).alias("regions"), F.avg("area").alias("area_mean"), F.stddev_pop("area").alias("area_std"), F.count_if("outlier").alias("outliers")
    )


def take(new: DataFrame, batch: int, out: str, settings: dict) -> int:
    """One batch: its seeds, and the blocks that they belong to made anew; the number of its seeds."""
    spark = new.sparkSession
    block = F.floor(F.col("p_partkey") / (raster.SEEDS * settings["images_per_block"]))
    own = new.where(F.col("p_partkey").isNotNull()).withColumn("block", block).withColumn("batch", F.lit(batch).cast("long"))
    _write(own.groupBy("p_partkey", "block", "batch").agg(F.max("p_size").alias("p_size")), f"{out}/seeds", "block", "batch")
    # a partition that an interrupted later batch left is no part of this state
    written = read(spark, out, "seeds").where(F.col("batch") <= batch)
    own = written.where(F.col("batch") == batch)
    touched = own.select("block").distinct()
    seeds = written.join(touched, "block", "left_semi").groupBy("p_partkey").agg(F.max_by("p_size", "batch").alias("p_size"))
    _write(region_table(seeds, settings), f"{out}/regions", "block")
    _write(image_table(read(spark, out, "regions").join(touched, "block", "left_semi")), f"{out}/images", "block")
    taken = own.count()
    log.info("batch %d: %d seeds", batch, taken)
    return taken


def run(spark: SparkSession, source: str, out: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Takes what is new of `source` and ends; batches and rows read, rows that now stand below `out`."""
    settings = settings or config.load("region_feed")
    taken: list[int] = []
    stream = spark.readStream.schema(SEEDS).option("maxFilesPerTrigger", settings["files_per_trigger"]).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: taken.append(take(df, n, out, settings))).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    counts = {"batches": len(taken), "read": sum(taken)}
    log.info("read %d new seeds of %s in %d batches", counts["read"], source, counts["batches"])
    if taken:
        counts |= {name: read(spark, out, name).count() for name in WRITTEN}
        log.info("below %s now stand %s", out, ", ".join(f"{counts[n]} {n}" for n in WRITTEN))
    return counts


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.region_feed", description=__doc__.splitlines()[0])
    parser.add_argument("input")
    parser.add_argument("out")
    parser.add_argument("checkpoint")
    parser.add_argument("--config")
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("region_feed").getOrCreate()
    try:
        run(spark, a.input, a.out, a.checkpoint, config.load("region_feed", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
