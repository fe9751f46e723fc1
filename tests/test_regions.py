import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import queries
from mosaiq.operators import graph, kernels, morphology, neighbours, regions
from mosaiq.plans import features
from mosaiq.sources import raster

SQUARE = ["0" * 14] * 2 + ["00" + "1" * 10 + "00"] * 10 + ["0" * 14] * 2


def test_square(pixels):
    p = pixels({"a": SQUARE})
    g = regions.geometry(p).first()
    assert (g.area, g.centroid_y, g.centroid_x, g.rectangularity) == (100, 6.5, 6.5, 1.0)
    assert g.equivalent_diameter == pytest.approx(math.sqrt(400 / math.pi))
    a = regions.axes(regions.central_moments(p)).first()
    assert a.major_axis_length == pytest.approx(a.minor_axis_length) and a.aspect_ratio == pytest.approx(1, abs=1e-5)
    n = neighbours.with_neighbours(p)
    assert neighbours.perimeters(n).first().perimeter == pytest.approx(36)
    assert neighbours.boundary_counts(n).first().boundary_pixels == 36
    assert neighbours.adjacency(n).count() == 0
    s = morphology.region_shapes(p).first()
    assert (s.convexity, s.convex_defect) == (1.0, 0.0)


def test_touching_squares(pixels):
    side = pixels({"edge": ["11111" + "22222"] * 5, "corner": ["11100"] * 3 + ["00022"] * 3})
    pairs = {(r.image_id, r.src, r.dst): r.contact for r in neighbours.adjacency(neighbours.with_neighbours(side)).collect()}
    assert pairs[("corner", 1, 2)] == pairs[("corner", 2, 1)] == 1
    assert pairs[("edge", 1, 2)] == pairs[("edge", 2, 1)] == 13
    around = graph.neighbour_areas(regions.geometry(side), neighbours.adjacency(neighbours.with_neighbours(side)))
    assert around.where("image_id = 'edge'").first().neighbor_area_mean == 25


def test_one_pixel_and_empty(pixels, spark):
    dot = pixels({"a": ["000", "010", "000"]})
    assert regions.fractal_dimension(dot).first().fractal_dimension_boxcount == 0
    assert regions.orientation(regions.central_moments(dot)).first().orientation == 0
    assert morphology.region_shapes(dot).first().skeleton_length_ratio == 0
    empty = spark.createDataFrame([], raster.PIXELS)
    assert regions.geometry(empty).count() == 0 and neighbours.with_neighbours(empty).count() == 0
    blank = pixels({"a": ["000"] * 3})
    assert regions.geometry(blank).count() == 0 and morphology.region_shapes(blank).count() == 0


def test_orientation_of_bars(pixels):
    flat = pixels({"h": ["0000000", "0111110", "0000000"], "v": ["010", "010", "010", "010"], "d": ["1000", "0100", "0010", "0001"]})
    o = {r.image_id: r.orientation for r in regions.orientation(regions.central_moments(flat)).collect()}
    assert o["v"] == pytest.approx(0) and abs(o["h"]) == pytest.approx(math.pi / 2) and o["d"] == pytest.approx(math.pi / 4)


def test_dilation_and_distance(pixels):
    p = pixels({"a": ["0000000"] * 3 + ["0001000"] + ["0000000"] * 3})
    assert neighbours.dilate(p.where("label = 1"), p, 2).count() == len(neighbours.disk(2)) == 13
    assert neighbours.within_distance(p.where("label = 0"), p.where("label = 1"), 1).count() == 4


def test_boundaries_of_all_regions_dilate(spark, monkeypatch, pixels):
    rng = np.random.default_rng(4)
    drawings = {name: ["".join(map(str, row)) for row in np.kron(rng.integers(0, 5, (3, 4)), np.ones((6, 5), int))] for name in ("a", "b")}
    monkeypatch.setattr(queries.raster, "raster", lambda spark, sf_dir: pixels(drawings))
    want = {}
    for name, lines in drawings.items():
        at = {(y, x): c for y, line in enumerate(lines) for x, c in enumerate(line)}
        edge = [(y, x) for (y, x), c in at.items() if c != "0" and any(at.get((y + dy, x + dx), c) != c for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
        hit = {(y, x) for y, x in at if any((y - v) ** 2 + (x - u) ** 2 <= 9 for v, u in edge)}
        want[name] = (len(hit), sum(y * 131 + x for y, x in hit))
    assert {r.image_id: (r.pixels, r.place) for r in queries.QUERIES["dilate_disk_all"](spark, "").collect()} == want


def points(spark, rows):
    return spark.createDataFrame([("a", i + 1, float(y), float(x)) for i, (y, x) in enumerate(rows)], "image_id string, label int, y double, x double")


def test_triangle_network(spark):
    p = points(spark, [(0, 0), (0, 10), (8.660254, 5)])
    for up_to in (0, 150):
        edges = graph.delaunay(p, up_to)
        assert edges.count() == 3
    limits = p.select("image_id").distinct().select("image_id", F.array(*[F.lit(float(t)) for t in [20, 5] + [20] * 27]).alias("t"))
    d = graph.degrees(p, edges, limits).first()
    assert d.delaunay_degree_fixed_20 == 2 and d.delaunay_degree_fixed_50 == 0
    c = graph.clustering(p, edges, limits).first()
    assert c.c0 == 1.0 and c.c1 == 0.0


def test_two_points(spark):
    p = points(spark, [(0, 0), (3, 4)])
    assert graph.delaunay(p, 0).count() == graph.delaunay(p).count() == 0
    assert graph.nearest_neighbours(p).first().nn_dist_mean == graph.pairwise_distances(p).first().pairwise_dist_mean == 5
    assert graph.nearest_neighbours(points(spark, [(1, 1)])).first().nn_dist_mean == 0


def test_homology_of_a_square(spark):
    bars = [(r.dim, round(r.birth, 6), round(r.death, 6)) for r in morphology.persistence(points(spark, [(0, 0), (0, 1), (1, 0), (1, 1)])).collect()]
    assert sorted(bars) == [(0, 0, 1)] * 3 + [(1, 1, 1.414214)]


def test_delaunay_edge_count(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    p = raster.synthetic_points(part)
    a = {tuple(r)[:3] for r in graph.delaunay_relational(p).collect()}
    assert a == {tuple(r)[:3] for r in graph.delaunay(p, 0).collect()}


def test_triangulation_decides_as_the_relational_form(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    grid = np.array([(y, x) for y in range(8) for x in range(15)], float)
    spoilt = [grid + e * rng.standard_normal(grid.shape) for e in (0, 1e-14, 1e-9, 1e-6)]
    # three of the rim in line but for rounding: the middle one lies inside by 1e-14
    line = np.array([(7.0476, 83.05648), (8.0691, 100.05912), (9.0906, 117.06176), (71.0745, 36.07639), (71.03297, 116.05401), (87.08019, 107.00133)])
    for k, points in enumerate([line, *spoilt]):
        y, x = points.T
        fast, slow = (set(map(tuple, graph.triangulate(y, x, few).tolist())) for few in (0, 1000))
        assert fast == slow, k
    rows = [("a", i, *p) for i, p in enumerate(line.tolist())]
    df = spark.createDataFrame(rows, "image_id string, label int, y double, x double")
    want = {tuple(r)[1:3] for r in graph.delaunay_relational(df).collect()}
    assert (0, 2) in want and want == {tuple(r)[1:3] for r in graph.delaunay(df, 0).collect()}


def test_skeleton_segments(pixels):
    import numpy as np

    draw = lambda lines: np.array([[c == "1" for c in line] for line in lines])
    loop = draw(["00000000000", "00001110000", "01110001110", "00001110000", "00000000000"])
    nodes, segments = kernels.skeleton_graph(loop)
    assert nodes == [(2, 1), (2, 3), (2, 7), (2, 9)]
    assert sorted((a, b, len(p)) for a, b, p in segments) == [(0, 1, 2), (1, 2, 4), (1, 2, 4), (2, 3, 2)]
    back = draw(["0000000", "0001100", "1110010", "0001100"])
    assert sorted((a, b, len(p)) for a, b, p in kernels.skeleton_graph(back)[1]) == [(0, 1, 2), (1, 1, 6)]
    line = pixels({"a": ["0" * 9, "011111110", "0" * 9]})
    r = morphology.boundary_networks(line).first()
    assert (r.nodes, r.edges, r.components, r.network_euler_number, r.segments, r.segment_pixels) == (2, 1, 1, 2, 1, 6)
    assert [(e.src, e.dst, e.length) for e in morphology.skeleton_edges(line).collect()] == [(0, 1, 6)]


def test_components_and_morphology():
    import numpy as np

    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert kernels.components(m)[1] == 3 and kernels.components(m, diagonal=False)[1] == 4
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert kernels.fill_holes(ring).all()
    assert kernels.keep_large(m, 2, diagonal=True).sum() == 2
    assert kernels.thin(np.ones((3, 9), bool)).sum() <= 9


def test_deduplicate(spark):
    box = lambda i, y0, x0, n: [("a", i, y, x) for y in range(y0, y0 + n) for x in range(x0, x0 + n)]
    masks = spark.createDataFrame(box(1, 0, 0, 4) + box(2, 0, 2, 6) + box(3, 1, 3, 2), "image_id string, mask_id int, y int, x int")
    frame = spark.createDataFrame([("a", 10, 10)], "image_id string, height int, width int")
    left = {r.mask_id: r["count"] for r in morphology.deduplicate_masks(masks, frame, 5).groupBy("mask_id").count().collect()}
    assert left == {2: 36, 1: 8}
    labelled = raster.from_masks(masks, frame)
    assert labelled.count() == 100 and labelled.where("label = 1").count() == 16


def test_boundary_classes_never_touch(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 40")
    typed = morphology.typed_pixels(raster.synthetic_pixels(part))
    walls = typed.where("region_type in ('thinw', 'junc')").select(F.concat_ws("|", "image_id", "region_type").alias("image_id"), "y", "x", "label")
    assert walls.where("label > 0").count() > 0
    assert neighbours.adjacency(neighbours.with_neighbours(walls)).count() == 0


def test_feature_vector_has_701_columns(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 80")
    f = features.image_features(raster.synthetic_pixels(part))
    assert len(features.DETAILS) == 62 and len(f.columns) == 702
    rows = f.collect()
    assert len(rows) == 2 and all(r.global_num_grains == 40 for r in rows)
    assert all(sum(r[f"global_degree_dist_{d}_150"] for d in range(9)) <= 40 for r in rows)
    assert all(r.grain_area_mean == pytest.approx(r.global_area_mean) and r.grain_area_std == pytest.approx(r.global_area_std) for r in rows)
    assert all(0 < r.global_avg_clustering_150 <= 1 and r.global_avg_clustering_adaptive_1r0std == 0 for r in rows)
    assert all(r.thinw_neighbor_count_mean == 0 and r.junc_triple_junction_mean == 0 for r in rows)


def test_kernel_measures_match_the_relations(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    for gap in (0.0, 1.5):
        p = raster.synthetic_pixels(part, gap)
        found = {(r.image_id, r.label): r for r in morphology.region_measures(p).collect()}
        for r in neighbours.perimeters(neighbours.with_neighbours(p)).collect():
            assert found[r.image_id, r.label].perimeter == pytest.approx(r.perimeter)
        for r in regions.fractal_dimension(p).collect():
            assert found[r.image_id, r.label].fractal_dimension_boxcount == pytest.approx(r.fractal_dimension_boxcount)
        near = morphology.near_labels(p, 2).where("label = 0 and near").select("image_id", "y", "x")
        edge = neighbours.inner_boundary(neighbours.with_neighbours(p))
        assert sorted(near.collect()) == sorted(neighbours.within_distance(p.where("label = 0").select("image_id", "y", "x"), edge, 2).collect())
