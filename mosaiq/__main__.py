"""python -m mosaiq {segmentation,features,analysis,correlation,model,degrees} ...: the stages as commands."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import sample_of_path
from .operators import morphology
from .plans import analysis, degrees, features, segmentation
from .plans.scratch import materialise
from .sources import files, raster


def _segmentation(spark: SparkSession, a: argparse.Namespace) -> None:
    masks = segmentation.segment(spark, a.input, a.pattern, min_area=a.min_area, area_ratio=a.area_ratio)
    # written once: the masks are saved, counted and made into files
    masks = materialise(masks, "masks")
    print(segmentation.save(masks, a.output))
    if a.mask_files:
        print({"files": files.write_masks(masks, a.mask_files)})


def _pixels(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    masks = files.read_masks(spark, a.input).where("error is null")
    frame = masks.groupBy(F.col("path").alias("image_id")).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    pixels = masks.select(F.col("path").alias("image_id"), "mask_id", F.explode("pixels").alias("p")).select("image_id", "mask_id", "p.y", "p.x")
    if a.deduplicate:
        pixels = morphology.deduplicate_masks(pixels, frame, a.min_area)
    return raster.from_masks(pixels, frame)


def _features(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_table(features.image_features(_pixels(spark, a)), a.output, a.format)


def _degrees(spark: SparkSession, a: argparse.Namespace) -> None:
    pixels = materialise(_pixels(spark, a), "pixels")
    details = materialise(features.region_details(features.Rasters(pixels)), "details")
    config = {"degree": a.degree, "property": a.property, "low": a.low, "high": a.high, "distance": a.distance, "bin_width": a.bin_width}
    for name, table in degrees.image_tables(details, pixels, config).items():
        files.write_table(table, f"{a.output}/{name}", a.format)
    if a.external:
        known = files.read_table(spark, a.external)
        by_sample = details.withColumn("sample", sample_of_path(F.col("image_id")))
        for name, table in degrees.comparison_tables(by_sample, known, [a.degree, a.property], a.order).items():
            files.write_table(table, f"{a.output}/compare_{name}", a.format)


def _analysis(spark: SparkSession, a: argparse.Namespace) -> None:
    # raters are numbered by the column named, else by the row's place in its file
    table = files.read_table(spark, a.input, place=not a.order)
    results, kept = analysis.select_features(table, a.icc, a.corr, a.raters, a.alpha, order=a.order or files.PLACE)
    files.write_table(results, f"{a.output}/results")
    files.write_table(kept, f"{a.output}/features")


def _correlation(spark: SparkSession, a: argparse.Namespace) -> None:
    found = analysis.correlate(files.read_table(spark, a.input), files.read_table(spark, a.external))
    files.write_table(analysis.report(found), a.output)


def _model(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, table in analysis.model(files.read_table(spark, a.input), files.read_table(spark, a.external), a.target).items():
        if name == "selected":
            files.write_lines(table, f"{a.output}/{name}")
        else:
            files.write_table(table, f"{a.output}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mosaiq")
    stages = parser.add_subparsers(dest="stage", required=True)
    for name, run in (("segmentation", _segmentation), ("features", _features), ("analysis", _analysis), ("correlation", _correlation), ("model", _model), ("degrees", _degrees)):
        p = stages.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        p.set_defaults(run=run)
        if name == "segmentation":
            p.add_argument("--pattern", default="*.tif")
            p.add_argument("--area-ratio", type=float)
            p.add_argument("--mask-files", help="also write a .mask file per image below this shared folder")
        if name in ("features", "degrees"):
            p.add_argument("--format", default="parquet")
            p.add_argument("--deduplicate", action="store_true")
        if name in ("segmentation", "features", "degrees"):
            p.add_argument("--min-area", type=int, default=100)
        if name == "degrees":
            p.add_argument("--external")
            p.add_argument("--degree", default=degrees.CONFIG["degree"])
            p.add_argument("--property", default=degrees.CONFIG["property"])
            p.add_argument("--low", type=float, default=degrees.CONFIG["low"])
            p.add_argument("--high", type=float, default=degrees.CONFIG["high"])
            p.add_argument("--distance", type=float, default=degrees.CONFIG["distance"])
            p.add_argument("--bin-width", type=float, default=degrees.CONFIG["bin_width"])
            p.add_argument("--order", default=degrees.CONFIG["order"])
        if name == "analysis":
            p.add_argument("--icc", type=float, default=0.75)
            p.add_argument("--corr", type=float, default=0.95)
            p.add_argument("--raters", type=int, default=8)
            p.add_argument("--alpha", type=float, default=0.05)
            p.add_argument("--order")
        if name in ("correlation", "model"):
            p.add_argument("--external", required=True)
        if name == "model":
            p.add_argument("--target", required=True)
    a = parser.parse_args(argv)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
