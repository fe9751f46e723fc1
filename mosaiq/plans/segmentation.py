"""From image files to deduplicated masks. The model that finds masks is a parameter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import sample_of_path
from ..operators import kernels
from ..sources import files
from ..sources.images import decode

Segmenter = Callable[[np.ndarray], list[np.ndarray]]


def otsu(grey: np.ndarray) -> int:
    """The grey level that separates two classes best (Otsu 1979)."""
    count = np.bincount(grey.ravel(), minlength=256).astype(float)
    below = np.cumsum(count)
    mass = np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))


def bright_components(image: np.ndarray) -> list[np.ndarray]:
    """The stand-in model: connected areas brighter than Otsu's level."""
    grey = image.mean(axis=2).astype(np.uint8)
    label, n = kernels.components(grey > otsu(grey))
    return [label == i for i in range(1, n + 1)]


def _segmented(segmenter: Segmenter, min_area: int, area_ratio: float | None):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    image = decode(content)[files.CROP_TOP : files.CROP_TOP + files.KEEP_ROWS, :, :3]
                    for number, (_, mask) in enumerate(kernels.deduplicate(segmenter(image), min_area, area_ratio), 1):
                        y, x = np.nonzero(mask)
                        box = [float(x.min()), float(y.min()), float(np.ptp(x) + 1), float(np.ptp(y) + 1)]
                        rows.append((path, number, float(len(y)), box, None, None, *mask.shape, [{"y": int(a), "x": int(b)} for a, b in zip(y, x, strict=True)], None))
                except Exception as e:  # one bad file is a row with its error
                    rows = [(path, *[None] * 8, str(e))]
                columns = list(zip(*rows)) or [()] * 10
                kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int32(), pa.int32(), files._POINT, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in files.MASKS.split(", ")])

    return run


def segment(spark: SparkSession, folder: str, pattern: str = "*.tif", segmenter: Segmenter = bright_components, min_area: int = 100, area_ratio: float | None = None) -> DataFrame:
    """One row per kept mask of every image below folder; a file that fails is an error row."""
    images = files.scan(spark, folder, pattern).select(F.col("relative").alias("path"), "content")
    return images.mapInArrow(_segmented(segmenter, min_area, area_ratio), files.MASKS).withColumn("sample_id", sample_of_path(F.col("path")))


def save(masks: DataFrame, out: str) -> dict[str, int]:
    """Write the masks by sample, error rows beside them; return how many images went which way."""
    masks.where("error is null").write.mode("overwrite").partitionBy("sample_id").parquet(f"{out}/masks")
    masks.where("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{out}/errors")
    spark = masks.sparkSession
    return {
        "images": spark.read.parquet(f"{out}/masks").select("path").distinct().count(),
        "masks": spark.read.parquet(f"{out}/masks").count(),
        "failed": spark.read.parquet(f"{out}/errors").count(),
    }
