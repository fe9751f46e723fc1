"""Rasters as they arrive: a file stream of pixels becomes region tables, image by image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import regions
from ..sources.raster import PIXELS


def pixel_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of the parquet files that land in folder; a file holds whole images."""
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", 64).parquet(folder)


def write_regions(pixels: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch's region geometry to out; a replayed batch overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        regions.geometry(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
