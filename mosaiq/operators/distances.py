"""Exact Euclidean distance to the background, in two passes that hold a line of an image at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def envelope(x: np.ndarray, height: np.ndarray) -> np.ndarray:
    """At each x the least (x - x')^2 + height(x') over all x' whose height is known (not NaN).

    The parabolas that are lowest somewhere form a stack, left to right; each new one removes
    those it covers, so the work is linear in the length of the line.
    """
    seen = np.flatnonzero(~np.isnan(height))
    if not len(seen):
        return np.full(len(x), np.nan)
    px, ph = x[seen].astype(float).tolist(), height[seen].tolist()
    stack, starts = [0], [-np.inf]
    for i in range(1, len(px)):
        while True:
            j = stack[-1]
            meet = (ph[i] + px[i] * px[i] - ph[j] - px[j] * px[j]) / (2 * (px[i] - px[j]))
            if meet > starts[-1]:
                break
            stack.pop()
            starts.pop()
        stack.append(i)
        starts.append(meet)
    at = np.array(stack)[np.searchsorted(starts, x, "right") - 1]
    return (x - np.array(px)[at]) ** 2 + np.array(ph)[at]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("row")
        x, gaps = (row.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "gap"))
        gaps = gaps.astype(float)
        ends = np.cumsum(row.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        far = [np.sqrt(envelope(a, g * g)) for a, g in zip(np.split(x, ends), np.split(gaps, ends), strict=True)]
        flat = row.flatten()
        places = pa.StructArray.from_arrays([flat.field("x"), flat.field("label"), pa.array(np.concatenate(far or [np.zeros(0)]), from_pandas=True)], names=["x", "label", "distance"])
        places = pa.ListArray.from_arrays(pa.array(np.r_[0, ends, len(x)] if len(row) else [0], pa.int32()), places)
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("y"), places], names=["image_id", "y", "row"])


def distance_map(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, label, distance: from each pixel to the nearest of label 0; NULL in an image without one.

    The first pass finds the nearest background pixel of each column, the second the lower
    envelope of the parabolas over these distances along each row, whose labels travel with it.
    """
    column = Window.partitionBy("image_id", "x")
    back = F.last(F.when(F.col("label") == 0, F.col("y")), ignorenulls=True)
    seen = pixels.select("image_id", "y", "x", "label", back.over(column.orderBy("y")).alias("above"))
    seen = seen.withColumn("below", back.over(column.orderBy(F.desc("y"))))
    line = seen.select("image_id", "y", "x", "label", F.least(F.col("y") - F.col("above"), F.col("below") - F.col("y")).alias("gap"))
    rows = line.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "label", "gap"))).alias("row"))
    rows = rows.mapInArrow(_rows, "image_id string, y int, row array<struct<x:int,label:int,distance:double>>")
    return rows.select("image_id", "y", F.inline("row"))
