import numpy as np
from pyspark.ml import PipelineModel

from mosaiq.__main__ import main as command
from mosaiq.operators import models
from mosaiq.plans import degrees, features, segmentation
from mosaiq.sources import files, raster


def picture(*boxes):
    image = np.zeros((60, 40, 3), np.uint8)
    for y, x, n in boxes:
        image[20 + y : 20 + y + n, x : x + n] = 200
    return b"P6\n40 60\n255\n" + image.tobytes()


def test_segmentation(spark, tmp_path):
    (tmp_path / "in" / "S1").mkdir(parents=True)
    (tmp_path / "in" / "S1" / "a.ppm").write_bytes(picture((2, 2, 12), (20, 20, 11), (35, 1, 3)))
    (tmp_path / "in" / "S1" / "b.ppm").write_bytes(b"not an image")
    masks = segmentation.segment(spark, str(tmp_path / "in"), "*.ppm")
    assert segmentation.save(masks, str(tmp_path / "out")) == {"images": 1, "masks": 2, "failed": 1}
    back = spark.read.parquet(str(tmp_path / "out" / "masks"))
    assert sorted((r.area, r.sample_id) for r in back.collect()) == [(121, "S1"), (144, "S1")]


def test_degree_tables(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 40")
    pixels = raster.synthetic_pixels(part).cache()
    details = features.region_details(features.Rasters(pixels)).cache()
    assert details.columns[1:] == features.DETAILS and details.count() == 40
    tables = degrees.image_tables(details, pixels)
    assert tables["histogram"].agg({"n": "sum"}).first()[0] == tables["counts"].agg({"n": "sum"}).first()[0] == 40
    assert tables["nodes"].count() == tables["outliers"].count() == 40
    assert tables["colouring"].where("label = 0 and value is not null").count() == 0 == tables["colouring"].where("label > 0 and value is null").count()
    degree = sum(r.delaunay_degree_fixed_50 for r in details.collect())
    assert degree == 2 * tables["edges"].count()
    external = spark.createDataFrame([("0", 1.0)], "sample_id string, Hc20 double")
    c = degrees.comparison_tables(details.withColumnRenamed("image_id", "sample"), external, ["area", "circularity", "perimeter"])
    assert c["values"].count() == 80 and c["box"].count() == 2
    assert degrees.comparison_tables(details, external, ["circularity"])["values"].count() == 0


def test_details_files(spark, tmp_path):
    d = spark.createDataFrame([("S1", 1, 2.0), ("S2", 1, 3.0)], "image_id string, label int, area double")
    files.write_details(d, str(tmp_path / "d"))
    assert {r.area for r in files.read_details(spark, str(tmp_path / "d"), "*.csv").collect()} == {2.0, 3.0}
    files.write_table(d, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).columns == ["sample_id", "label", "area"]
    files.write_lines(d, str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ["S1", "S2"]


def test_saved_pipeline(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 3) if i % 4 else None, 2.0 * i) for i in range(40)], "a double, b double, y double")
    m = models.fit_pipeline(df, ["a", "b"], "y", {"n_estimators": 3, "max_depth": 3, "min_samples_split": 2})
    m.write().overwrite().save(str(tmp_path / "m"))
    assert PipelineModel.load(str(tmp_path / "m")).transform(df).select("prediction").collect() == m.transform(df).select("prediction").collect()


def test_commands_from_images_to_degree_tables(spark, tmp_path):
    folder = tmp_path / "in" / "S1"
    folder.mkdir(parents=True)
    (folder / "b.ppm").write_bytes(picture((2, 2, 12), (2, 20, 12), (20, 20, 11), (22, 2, 11)))
    (folder / "a.ppm").write_bytes(b"not an image")
    assert [r.relative for r in files.listing(spark, str(tmp_path / "in"), "*.ppm").collect()] == ["S1/a.ppm", "S1/b.ppm"]
    command(["segmentation", str(tmp_path / "in"), str(tmp_path / "out"), "--pattern", "*.ppm", "--mask-files", str(tmp_path / "masks")])
    back = files.read_masks(spark, str(tmp_path / "masks")).collect()
    assert [(r.path, r.mask_id, r.error) for r in sorted(back, key=lambda r: r.mask_id)] == [("S1/b.mask", i, None) for i in (1, 2, 3, 4)]
    assert sorted(r.area for r in back) == [121, 121, 144, 144]
    (tmp_path / "external.csv").write_text("name,Hc20\nS1,1.5\n")
    command(["degrees", str(tmp_path / "masks"), str(tmp_path / "tables"), "--external", str(tmp_path / "external.csv")])
    assert spark.read.parquet(str(tmp_path / "tables" / "nodes")).count() == 4
    assert spark.read.parquet(str(tmp_path / "tables" / "compare_values")).count() == 8
