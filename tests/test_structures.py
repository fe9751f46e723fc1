"""Grid search, envelopes, tiles, range numbering and masked products, against brute force."""

import random

import numpy as np
import pytest

from mosaiq.functions import columns
from mosaiq.operators import distances, graph, morphology, plots, select, tiles
from mosaiq.sources import raster


def drawing(rng, h, w, share):
    return ["".join("1" if rng.random() < share else "0" for _ in range(w)) for _ in range(h)]


# --- numbers within a key -------------------------------------------------------------------------


@pytest.mark.parametrize("order", [["a"], ["a", "b"], ["name"]])
def test_numbers_within_a_hot_key(spark, order):
    rng = random.Random(1)
    # one key holds most rows, the first order column never changes in it; null keys and values, equal rows
    rows = [(rng.choice(["hot"] * 8 + ["x", "y", None]), 7.0, rng.choice([None, *range(40)]), rng.choice("pqr")) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, a double, b int, name string").repartition(5)
    got = columns.number_within(df, ["k"], order, "n").collect()
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, len(own) + 1))
        keys = [tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in order) for r in own]
        assert keys == sorted(keys)
    none = columns.number_within(df.limit(0), ["k"], order, "n")
    assert none.count() == 0 and none.columns == ["k", "a", "b", "name", "n"]


def test_random_rows_repeat(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = [r.k for r in columns.random_rows(df, "k", 50).collect()]
    assert first == [r.k for r in columns.random_rows(df.repartition(7), "k", 50).collect()] and len(set(first)) == 50
    assert first != sorted(first) and columns.random_rows(df.where("k < 3"), "k", 50).count() == 3


# --- nearest neighbours -----------------------------------------------------------------------------


def test_nearest_distances(spark):
    rng = random.Random(2)
    images = {
        "even": [(rng.random() * 100, rng.random() * 100) for _ in range(200)],
        "clusters": [(rng.gauss(c, 0.01), rng.gauss(c, 0.01)) for c in (0, 500) for _ in range(60)] + [(250.0, 10.0)],
        "line": [(5.0, float(i * i)) for i in range(30)],
        "same": [(1.0, 1.0)] * 4,
        "two": [(0.0, 0.0), (300.0, 400.0)],
        "one": [(3.0, 3.0)],
    }
    rows = [(name, i, y, x) for name, points in images.items() for i, (y, x) in enumerate(points)]
    got = {(r.image_id, r.label): r.d for r in graph.nearest_distances(spark.createDataFrame(rows, "image_id string, label int, y double, x double")).collect()}
    want = {(n, i): min(((y - v) ** 2 + (x - u) ** 2) ** 0.5 for j, (v, u) in enumerate(p) if j != i) for n, p in images.items() if len(p) > 1 for i, (y, x) in enumerate(p)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    stats = {r.image_id: r for r in graph.nearest_neighbours(spark.createDataFrame(rows, "image_id string, label int, y double, x double")).collect()}
    assert stats["one"].nn_dist_mean == 0.0 and stats["two"].nn_dist_mean == 500.0 and len(stats) == 6


# --- distance transform ---------------------------------------------------------------------------------


def test_envelope():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30):
        for gaps in (0.0, 0.5, 1.0):
            x = np.sort(rng.choice(100, n, replace=False))
            h = np.where(rng.random(n) < gaps, np.nan, rng.integers(0, 60, n) ** 2.0)
            got = distances.envelope(x, h)
            if np.isnan(h).all():
                assert np.isnan(got).all()
            else:
                assert np.allclose(got, np.nanmin((x[:, None] - x[None, :]) ** 2 + h[None, :], axis=1))


def test_distance_map(pixels):
    rng = random.Random(4)
    images = {"dense": drawing(rng, 17, 23, 0.93), "sparse": drawing(rng, 9, 30, 0.4), "full": ["111", "111"], "none": ["000"], "dot": ["1111", "1101"]}
    got = {(r.image_id, r.y, r.x): r.distance for r in distances.distance_map(pixels(images)).collect()}
    for name, lines in images.items():
        spots = [(y, x) for y, line in enumerate(lines) for x, c in enumerate(line)]
        back = [p for p in spots if lines[p[0]][p[1]] == "0"]
        for y, x in spots:
            want = min((((y - v) ** 2 + (x - u) ** 2) ** 0.5 for v, u in back), default=None)
            assert got[name, y, x] == (want if want is None else pytest.approx(want))


# --- tiles --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [1, 3, 8, 64])
@pytest.mark.parametrize("diagonal", [True, False])
def test_tiles_give_the_components_of_the_whole(pixels, tile, diagonal):
    rng = random.Random(tile)
    snake = ["1111111111", "0000000001", "1111111111", "1000000000", "1111111111", "0000000001", "1111111111"]
    images = {"noise": drawing(rng, 14, 19, 0.55), "snake": snake, "full": ["1" * 12] * 9, "none": ["0" * 5] * 4, "dots": ["10101", "00000", "10101"]}
    df = pixels(images)
    want = morphology.connected_components(df, diagonal)
    got = tiles.connected_components(df, diagonal, tile)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# --- masked products and densities -----------------------------------------------------------------------------


def test_correlations_over_the_rows_that_have_both(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) + 1e6  # far from zero
    x[:, 2] = 7.0
    x[:, 3] = x[:, 0] * 2
    gaps = np.where(rng.random(x.shape) < 0.3, np.nan, x)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (None, "text") for r in gaps]
    df = spark.createDataFrame(rows, "a double, b double, flat double, t double, empty double, word string").repartition(5)
    got = {(r.feature, r.target): r["corr"] for r in select.feature_target_correlation(df, ["a", "b", "flat", "empty", "word", "gone"], ["t", "b"]).collect()}
    assert len(got) == 10
    for f in ("a", "b"):
        for t in ("t", "b"):
            i, j = "abft".index(f), {"t": 3, "b": 1}[t]
            both = ~np.isnan(gaps[:, i]) & ~np.isnan(gaps[:, j])
            assert got[f, t] == pytest.approx(np.corrcoef(gaps[both, i], gaps[both, j])[0, 1], abs=1e-7)
    assert all(got[f, t] is None for f in ("flat", "empty", "word") for t in ("t", "b"))
    assert select.feature_target_correlation(df, ["gone"], ["t"]).count() == 0


def test_correlations_of_a_wide_table(spark):
    names = [f"f{i}" for i in range(701)]
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(12, 713))], ", ".join(f"{n} double" for n in [*names, *[f"t{i}" for i in range(12)]]))
    assert select.feature_target_correlation(df, names, [f"t{i}" for i in range(12)]).where("corr is not null").count() == 701 * 12


def test_density_in_two_directions(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=200), rng.normal(size=200) * 3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double").repartition(3)
    got = {(r.i, r.j): r.density for r in plots.density_2d(df, "x", "y", 5).collect()}
    hx, hy = (v.std(ddof=1) * 200 ** (-1 / 6) for v in (x, y))
    for i, a in enumerate(np.linspace(x.min(), x.max(), 5)):
        for j, b in enumerate(np.linspace(y.min(), y.max(), 5)):
            want = np.exp(-0.5 * (((a - x) / hx) ** 2 + ((b - y) / hy) ** 2)).sum() / (200 * hx * hy * 2 * np.pi)
            assert got[i, j] == pytest.approx(want)


# --- rasters ------------------------------------------------------------------------------------------------


def test_faults_of_rasters(spark):
    whole = [("ok", y, x, y + x) for y in range(3) for x in range(4)]
    rows = whole + [("hole", y, x, 1) for y in range(3) for x in range(4) if (y, x) != (1, 1)]
    rows += [("twice", 0, x, 1) for x in (0, 1, 1, 2, 2, 2)] + [("odd", 0, 0, -1), ("odd", 0, 1, None), ("odd", 1, 0, 5), ("odd", 1, 1, 0)] + [("left", 0, -1, 1), ("left", 0, 0, 1)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, label int")
    got = {r.image_id: (r.missing, r.repeated, r.unlabelled) for r in raster.faults(df).collect()}
    assert got == {"hole": (1, 0, 0), "twice": (0, 3, 0), "odd": (0, 0, 2), "left": (0, 1, 0)}
    with pytest.raises(ValueError, match="hole: 1 missing"):
        raster.require_whole(df)
    assert raster.require_whole(df.where("image_id = 'ok'")).count() == 12


def test_backdrop(spark, pixels):
    labels = pixels({"a": ["1122", "1122", "3333"], "b": ["11", "11"]})
    picture = spark.createDataFrame([("a", 0, [[1, 2, 3], [4, 5, 6], [7, 8, 9]]), ("a", 1, [[10], [20], [30], [40], [50]]), ("b", None, None)], "image_id string, y int, row array<array<short>>")
    got = {(r.image_id, r.y, r.x): (r.red, r.green, r.blue) for r in plots.backdrop(labels, picture).collect()}
    assert got["a", 0, 1] == (4, 5, 6) and got["a", 1, 3] == (40, 40, 40) and len(got) == 16
    assert got["a", 0, 3] == (0, 0, 0) and got["a", 2, 2] == (255, 255, 255) and got["b", 0, 0] == (0, 0, 0)
    plain = {(r.image_id, r.y, r.x): r.red for r in plots.backdrop(labels).collect()}
    assert plain["a", 0, 0] == 0 and plain["a", 0, 1] == plain["a", 0, 2] == plain["a", 2, 0] == 255
