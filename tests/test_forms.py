"""Rasters as pixels, rows and images; shares of a task that do not grow; joins that broadcast nothing of pixel size."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from mosaiq.operators import distances, graph, models, morphology, neighbours, regions, stats, tiles
from mosaiq.sources import raster

#: Seeds of an image with three points in line on the rim.
RIM_SIZES = [11, 22, 26, 5, 41, 1, 25, 49, 45, 44, 36, 10, 32, 8, 49, 18, 3, 6, 5, 17, 9, 36, 35, 12, 6, 39, 3, 47, 15, 2, 36, 28, 44, 4, 21, 28, 16, 2, 6, 25]


def part_of(spark, n):
    return spark.range(n).select(F.col("id").alias("p_partkey"), (F.col("id") * 7 % 50 + 1).cast("int").alias("p_size"))


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("gap", [0.0, 1.5])
def test_images_are_the_pixels(spark, gap):
    """The second image lacks seeds: places that no seed is near are no pixels."""
    part = part_of(spark, 63)
    got = {(r.image_id, r.y, r.x): r.label for r in raster.synthetic_pixels(part, gap).collect()}
    seeds = [(str(r.p_partkey // 40), (k := r.p_partkey % 40) + 1, k // 8, k % 8, k // 8 * 19 + 5 + (r.p_size * 7 + r.p_partkey * 3) % 10, k % 8 * 16 + 3 + (r.p_size * 5 + r.p_partkey * 11) % 10) for r in part.collect()]
    want = {}
    for image in ("0", "1"):
        for y in range(96):
            for x in range(128):
                near = sorted(((y - sy) ** 2 + (x - sx) ** 2, s) for i, s, row, column, sy, sx in seeds if i == image and abs(y // 19 - row) <= 1 and abs(x // 16 - column) <= 1)
                if near:
                    lone = len(near) == 1 or near[1][0] ** 0.5 - near[0][0] ** 0.5 >= gap
                    want[image, y, x] = near[0][1] if lone else 0
    assert got == want and len(got) < 2 * 96 * 128


def test_operators_take_any_form(spark):
    images = raster.synthetic_images(part_of(spark, 80)).cache()
    pixels, rows = raster.flat(images), raster.bands(images)
    for form in (rows, images):
        assert as_rows(neighbours.adjacency(neighbours.with_neighbours(form))) == as_rows(neighbours.adjacency(neighbours.with_neighbours(pixels)))
        assert as_rows(neighbours.inner_boundary(neighbours.with_neighbours(form))) == as_rows(neighbours.inner_boundary(neighbours.with_neighbours(pixels)))
        assert as_rows(morphology.region_measures(form)) == as_rows(morphology.region_measures(pixels))
    spots = neighbours.inner_boundary(neighbours.with_neighbours(pixels))
    near = raster.flat(morphology.near_boundary(images, 3)).where("label = 1").select("image_id", "y", "x")
    assert as_rows(near) == as_rows(neighbours.dilate(spots, pixels, 3))
    images.unpersist()


def test_grown_masks(spark):
    images = raster.synthetic_images(part_of(spark, 40), 0.0)
    runs = images.select("image_id", F.inline(morphology.grown_masks(2)("labels")))
    got = {(r.mask_id, r.y, x) for r in runs.collect() for x in range(r.x0, r.x1 + 1)}
    want = {(r.label, r.y + dy, r.x + dx) for r in raster.flat(images).collect() for dy, dx in neighbours.disk(2)}
    assert got == {(m, y, x) for m, y, x in want if 0 <= y < 96 and 0 <= x < 128}
    assert len(got) == sum(r.x1 - r.x0 + 1 for r in runs.collect())


def test_shares_do_not_grow(spark):
    many = raster.spread(part_of(spark, 400_000), "p_partkey")
    assert many.rdd.getNumPartitions() == 100


def test_nothing_of_pixel_size_is_broadcast(spark):
    """Sizes estimated from the seeds or from packed files say nothing of the pixels made of them."""
    pixels = raster.synthetic_pixels(part_of(spark, 80))
    masks = pixels.where("label > 0").withColumnRenamed("label", "mask_id")
    frame = pixels.select("image_id").distinct().select("image_id", F.lit(96).alias("height"), F.lit(128).alias("width"))
    for df in (distances.distance_map(pixels), raster.from_masks(masks, frame), tiles.connected_components(pixels, tile=32), morphology.deduplicate_masks(masks, frame)):
        assert "Broadcast" not in plan(df)
    assert as_rows(raster.from_masks(masks, frame)) == as_rows(pixels)


def test_masks_beyond_the_frame_and_bare_rows(spark):
    masks = spark.createDataFrame([("a", 7, 0, 0), ("a", 9, 0, 0), ("a", 9, 0, 5), ("a", 9, 9, 0), ("a", 8, -1, 0)], "image_id string, mask_id int, y int, x int")
    frame = spark.createDataFrame([("a", 2, 3), ("b", 1, 2)], "image_id string, height int, width int")
    got = {(r.image_id, r.y, r.x): r.label for r in raster.from_masks(masks, frame).collect()}
    want = {("a", y, x): 0 for y in range(2) for x in range(3)} | {("b", 0, 0): 0, ("b", 0, 1): 0, ("a", 0, 0): 1}
    assert got == want


def test_joins_of_points_broadcast_nothing(spark):
    points = raster.synthetic_points(part_of(spark, 80))
    limits = points.select("image_id").distinct().select("image_id", F.array(*[F.lit(50.0)] * 29).alias("t"))
    edges = graph.delaunay(points)
    for df in (edges, graph.degrees(points, edges, limits), graph.clustering(points, edges, limits), graph.nearest_neighbours(points)):
        assert "Broadcast" not in plan(df)


def test_medians_are_exact(spark):
    """By brackets, with ties, null and one value; no map of all distinct values is kept."""
    rows = [("f", "odd", float(i * i % 10_007)) for i in range(30_001)] + [("f", "even", float(i % 7)) for i in range(1000)] + [("g", "one", -3.5), ("g", "two", 1.0), ("g", "two", 2.0)]
    long = spark.createDataFrame(rows, "feature string, sample string, value double")
    got = {(r.feature, r.sample): r.median for r in stats.medians(long, ["feature", "sample"]).collect()}
    want = {}
    for f, s, v in rows:
        want.setdefault((f, s), []).append(v)
    assert got == {k: 0.5 * sorted(v)[(len(v) - 1) // 2] + 0.5 * sorted(v)[len(v) // 2] for k, v in want.items()}


def test_no_edge_spans_a_point_on_the_rim(spark):
    """The middle one of three points in line on the rim; rounding about the mean must not hide it."""
    whole = spark.range(20440, 20480).select(F.col("id").alias("p_partkey"))
    sizes = spark.createDataFrame(list(zip(range(20440, 20480), RIM_SIZES)), "p_partkey long, p_size int")
    points = raster.synthetic_points(whole.join(sizes, "p_partkey"))
    assert as_rows(graph.delaunay(points, 0).select("image_id", "src", "dst")) == as_rows(graph.delaunay(points).select("image_id", "src", "dst"))


def test_alike_rows_are_explained_once_and_weigh_all(spark):
    rows = [(i, float(i % 3), float(i % 2), float(i % 3) * 2 + i % 2) for i in range(60)] + [(60 + i, None, 1.0, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    each = models.attributions(df, ["a", "b"], "y", "id", "Ridge", {"alpha": 1.0}).collect()
    got = {r.feature: r.mean_abs_shap for r in models.mean_attribution(df, ["a", "b"], "y", "id", "Ridge", {"alpha": 1.0}).collect()}
    assert len(each) == 80 and got == pytest.approx({c: sum(abs(r["values"][i]) for r in each) / 80 for i, c in enumerate("ab")})


def test_model_rows_are_dealt_by_number(spark):
    """One small file is one task as read; the forests' work is in its rows."""
    df = spark.range(20_000).coalesce(1).withColumnRenamed("id", "k")
    assert models.dealt(df, "k").rdd.getNumPartitions() == 4 and models.dealt(df.limit(10), "k").rdd.getNumPartitions() == 1


def test_regions_from_images_are_those_from_pixels(spark):
    """Also with null places, gaps between labels and an image without regions; no pixel becomes a row."""
    rows = [("a", [[0, 7, 7, None], [2, 2, 7, 0], [0, 2, 7, 7]]), ("b", [[0, 0], [0, 0]]), ("c", [[5]]), ("d", [])]
    images = spark.createDataFrame(rows, raster.IMAGES)
    pixels, sums = raster.flat(images), regions.sums(images)
    for form in (regions.geometry, regions.central_moments):
        want, got = form(pixels), form(sums)
        assert want.dtypes == got.dtypes
        assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
    assert "explode" not in regions.geometry(sums)._jdf.queryExecution().executedPlan().toString()
