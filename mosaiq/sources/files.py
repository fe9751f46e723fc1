"""Files in and out: images, mask files, details and feature tables, reports, models."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import sample_of_path
from .images import decode
from .msgpack import pack, unpack

#: Rows cut from the top of an image, and rows kept after that.
CROP_TOP, KEEP_ROWS = 20, 850


def scan(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, relative, content of the files below folder that match, in no order: sorting would move every file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    relative = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    return files.select("path", relative.alias("relative"), "content")


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, relative of the files below folder that match, in path order; their contents are not read."""
    return scan(spark, folder, pattern).select("path", "relative").orderBy("path")


def _decoded(batches):
    """Rows by their buffers: an array of pixels, each an array of bands."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            try:
                image = decode(content.as_py())[CROP_TOP : CROP_TOP + KEEP_ROWS, :, :3]
                if not image.size:
                    raise ValueError("no row is left below the part that is cut off")
                h, w, bands = image.shape
                pixels = pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1, dtype=np.int32) * bands), pa.array(image.astype(np.int16).ravel()))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(h + 1, dtype=np.int32) * w), pixels)
                yield pa.RecordBatch.from_arrays([pa.array([path] * h), pa.array(np.arange(h, dtype=np.int32)), rows, pa.nulls(h, pa.string())], names=["path", "y", "row", "error"])
            except Exception as e:  # one bad file is a row with its error, not a failed job
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.list_(pa.int16()))), pa.array([str(e)])], names=["path", "y", "row", "error"])


def read_images(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """path, y, row (bands of each pixel), error: images cropped at the top, alpha dropped."""
    return scan(spark, folder, pattern).select("path", "content").mapInArrow(_decoded, "path string, y int, row array<array<short>>, error string")


MASKS = "path string, mask_id int, area double, bbox array<double>, predicted_iou double, stability_score double, height int, width int, pixels array<struct<y:int,x:int>>, error string"
_POINT = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32())]))


def _masks(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = []
            try:
                for i, m in enumerate(unpack(content), 1):
                    a = m.get("segmentation")
                    if not isinstance(a, np.ndarray):
                        continue
                    y, x = np.nonzero(a)
                    number = lambda k, m=m: None if m.get(k) is None else float(m[k])
                    rows.append((path, i, number("area") if "area" in m else float(len(y)), [float(v) for v in m["bbox"]] if m.get("bbox") is not None else None, number("predicted_iou"), number("stability_score"), *a.shape[:2], [{"y": int(p), "x": int(q)} for p, q in zip(y, x, strict=True)], None))
            except Exception as e:
                rows = [(path, *[None] * 8, str(e))]
            columns = list(zip(*rows)) or [()] * 10
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int32(), pa.int32(), _POINT, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MASKS.split(", ")])


def read_masks(spark: SparkSession, folder: str, pattern: str = "*.mask") -> DataFrame:
    """One row per mask of the mask files below folder; a file that cannot be read is an error row."""
    rows = scan(spark, folder, pattern).select("relative", "content").withColumnRenamed("relative", "path").mapInArrow(_masks, MASKS)
    return rows.withColumn("sample_id", sample_of_path(F.col("path")))


def pack_masks(masks: list[dict]) -> bytes:
    """A mask file's bytes; masks without an array are left out, a missing area is counted."""
    out = []
    for m in masks:
        if isinstance(m.get("segmentation"), np.ndarray):
            out.append({**m, "area": m.get("area", int(m["segmentation"].sum()))})
    return pack(out)


def _packed(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            masks = []
            for m in sorted(r["masks"], key=lambda m: m["mask_id"]):
                a = np.zeros((m["height"], m["width"]), bool)
                if m["pixels"]:
                    a[[p["y"] for p in m["pixels"]], [p["x"] for p in m["pixels"]]] = True
                masks.append({"segmentation": a, **{k: m[k] for k in ("area", "bbox", "predicted_iou", "stability_score") if m[k] is not None}})
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([pack_masks(masks)], pa.binary())], names=["path", "content"])


def mask_contents(masks: DataFrame) -> DataFrame:
    """path, content: the mask file of each image's masks, by mask_id; error rows are left out.

    An image's masks meet in one task, as its file is written at once.
    """
    one = F.struct("mask_id", "area", "bbox", "predicted_iou", "stability_score", "height", "width", "pixels")
    return masks.where("error is null").groupBy("path").agg(F.collect_list(one).alias("masks")).mapInArrow(_packed, "path string, content binary")


def _saver(folder: str):
    def run(batches):
        for batch in batches:
            done = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = os.path.join(folder, os.path.splitext(path)[0] + ".mask")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                # a task that is run again replaces the file as a whole
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, target)
                done.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    return run


def write_masks(masks: DataFrame, folder: str) -> int:
    """Write a .mask file per image below folder, which all executors must share; the number of files."""
    return mask_contents(masks).mapInArrow(_saver(folder), "file string").count()


#: Columns that order the rows of a file as they stand in it.
PLACE = ["file_name", "block_start", "seq"]


def read_table(spark: SparkSession, path: str, schema: str | None = None, place: bool = False) -> DataFrame:
    """A CSV with a header; its first column becomes sample_id. With place, PLACE says where a row stands.

    Files come by name and their rows as they stand: numbers of rows grow within a block, whatever
    the order in which blocks are dealt out.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    first = df.columns[0]
    if place:
        df = df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]), F.monotonically_increasing_id().alias(PLACE[2]))
    return df.withColumnRenamed(first, "sample_id")


def read_details(spark: SparkSession, folder: str, pattern: str = "*_details.csv") -> DataFrame:
    """All details tables below folder by name, with their path."""
    df = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder)
    return df.withColumn("path", F.col("_metadata.file_path"))


def write_table(df: DataFrame, path: str, form: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def write_details(details: DataFrame, path: str) -> None:
    """Details by image, so a reader of one image reads one folder."""
    details.write.mode("overwrite").partitionBy("image_id").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """The first column as lines of text."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)
