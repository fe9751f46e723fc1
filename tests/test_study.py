import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import columns, special
from mosaiq.operators import models, plots, select, stats
from mosaiq.plans import analysis
from mosaiq.sources import files, msgpack

DEMO = [
    ("A", 1, 1.1, 10.0, 100.0, 5.0, 0.1), ("A", 2, 1.0, 20.0, 101.0, 5.0, 0.1), ("A", 3, 1.2, 15.0, 100.0, 5.0, 0.1),
    ("B", 1, 5.0, 12.0, 102.0, 5.0, 0.2), ("B", 2, 5.1, 22.0, 100.0, 5.0, 0.2), ("B", 3, 4.9, 18.0, 101.0, 5.0, 0.2),
    ("C", 1, 3.0, 11.0, 101.0, 5.0, 0.1), ("C", 2, 3.1, 21.0, 100.0, 5.0, 0.1), ("C", 3, 2.9, 16.0, 102.0, 5.0, 0.1),
]


@pytest.fixture()
def demo(spark):
    wide = spark.createDataFrame(DEMO, "sample string, rater int, f1 double, f2 double, f3 double, f4 double, f5_std double").withColumn("f5", F.col("f1"))
    return wide, stats.unpivot(wide, ["sample", "rater"], ["f1", "f2", "f3", "f4", "f5", "f5_std"])


def test_icc_and_anova_of_the_demo(demo):
    icc = {r.feature: r.icc for r in stats.icc3k(demo[1]).collect()}
    assert icc["f1"] == pytest.approx(0.998831, abs=1e-6) and icc["f2"] == pytest.approx(0.972973, abs=1e-6)
    assert icc["f3"] == pytest.approx(-1.125) and icc["f4"] is None and icc["f5_std"] == pytest.approx(1)
    t = {r.feature: r for r in stats.anova(demo[1]).collect()}
    assert t["f1"].f == pytest.approx(1141) and t["f1"].p_value == pytest.approx(1.80337e-08, rel=1e-4) and t["f1"].reject_h0
    assert t["f2"].p_value == pytest.approx(0.852650, abs=1e-6) and t["f3"].p_value == pytest.approx(0.592704, abs=1e-6)
    assert t["f4"].p_value == t["f5_std"].p_value == 1.0
    good = stats.good_features(stats.icc3k(demo[1]), stats.anova(demo[1])).where("good_feature")
    assert sorted(r.feature for r in good.collect()) == ["f1", "f5"]


def test_selection_of_the_demo(demo):
    _, kept = analysis.select_features(demo[0].withColumnRenamed("sample", "sample_id").withColumnRenamed("rater", "seq"))
    assert kept.columns == ["Sample", "f5"] and kept.count() == 3


def test_missing_raters_drop_the_sample(spark):
    rows = [("f", s, r, float(10 * i + r)) for i, s in enumerate("abc") for r in (1, 2, 3) if (s, r) != ("c", 3)]
    assert stats.icc3k(spark.createDataFrame(rows, "feature string, sample string, rater int, value double")).first().icc == pytest.approx(1.0)
    lone = spark.createDataFrame([("f", "a", 1, 1.0)], "feature string, sample string, rater int, value double")
    assert stats.icc3k(lone).first().icc is None and stats.anova(lone).first().f is None


def test_special_functions():
    assert special.f_survival(4.0, 2, 10) == pytest.approx(0.052922, abs=1e-6)
    assert special.f_survival(1.0, 5, 5) == pytest.approx(0.5)
    assert special.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    w, p = special.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.001)


def test_normality_uses_all_values_of_a_sample(spark):
    rng = np.random.default_rng(5)
    groups = {"large": rng.normal(size=6001) + 1000, "tied": rng.integers(0, 9, 700).astype(float), "three": np.array([1.0, 2.0, 4.0]), "five": np.array([3.0, 1.0, 4.0, 1.0, 5.0]), "six": np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0]), "two": np.array([1.0, 2.0]), "flat": np.full(50, 5.0)}
    rows = [("f", s, float(v)) for s, x in groups.items() for v in x] + [("f", "three", None)]
    found = {r["sample"]: (r.w, r.p_value) for r in stats.normality(spark.createDataFrame(rows, "feature string, sample string, value double")).collect()}
    assert sorted(found) == ["five", "flat", "large", "six", "three", "tied"]
    assert found["flat"] == (None, None)
    for s in ("large", "tied", "three", "five", "six"):
        assert found[s] == pytest.approx(special.shapiro(groups[s]), rel=1e-9)


def test_filters(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        a, b = rng.random(), rng.random()
        rows.append((a, 2 * a, 3 * a + 1e-3 * b, b, 1.0, None))
    df = spark.createDataFrame(rows, "a double, b double, c_std double, d double, flat double, none double")
    assert select.variance_filter(df, df.columns) == ["a", "b", "c_std", "d"]
    assert select.variance_filter(df.select("flat"), ["flat"]) == ["flat"]
    assert select.correlation_filter(df, ["a", "b", "c_std", "d"]) == ["b", "d"]
    m = {(r.feature_a, r.feature_b): r["corr"] for r in select.correlation_matrix(df, ["a", "b", "d", "flat"]).collect()}
    x = np.array(rows, dtype=object)[:, [0, 3]].astype(float)
    assert m["a", "b"] == pytest.approx(1) and m["a", "flat"] is None and m["a", "d"] == pytest.approx(np.corrcoef(x.T)[0, 1])


def test_correlation_skips_incomplete_pairs(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, nan), (None, 1.0), (4.0, 7.0)], "a double, b double")
    want = np.corrcoef([1, 2, 4], [2, 4.5, 7])[0, 1]
    assert select.correlation_matrix(df, ["a", "b"]).first()["corr"] == pytest.approx(want)
    assert select.feature_target_correlation(df, ["a", "zzz"], ["b"]).first()["corr"] == pytest.approx(want)


def test_columns(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r.v for r in columns.coerce_numeric(df, ["v"]).collect()] == [1.5, None, None, None]
    assert spark.range(1).select(columns.sample_of_path(__import__("pyspark").sql.functions.lit("S1_02.mask"))).first()[0] == "S1"
    rows = [(k, i, k * 1000 + i) for k in (0, 1) for i in range(200)] + [(2, i, i) for i in range(3000)]
    numbered = columns.number_within(spark.createDataFrame(rows, "k int, o int, id int"), ["k"], ["o", "id"], "n")
    assert numbered.where("n <> o + 1").count() == 0 and numbered.count() == len(rows)
    z = columns.standardize(spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "v double"), ["v"])
    v = np.array([r.v for r in z.collect()])
    assert v.mean() == pytest.approx(0) and v.std() == pytest.approx(1)


def test_plots_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double, w double")
    assert plots.histogram(none, "v", 1.0).count() == plots.hexbin(none, "v", "w").count() == plots.density_2d(none, "v", "w").count() == 0
    assert plots.density(none, "v", "g").count() == plots.box_summary(none, "v", "g").count() == 0


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "v double")
    assert {(r.bin, r.n) for r in plots.histogram(df, "v", 1.0).collect()} == {(0, 2), (1, 2)}


def test_linear_models_match_closed_forms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.0] + 3 + 0.1 * rng.normal(size=200)
    df = models.with_folds(spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double"), "id", 4)
    total = models.fold_products(df, ["a", "b", "c"], "y", 4).sum(axis=0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert models.ridge(total, 10.0)[:3] == pytest.approx(want)
    w = models.lasso(total, 0.5)
    assert w[2] == 0 and 0 < w[0] < 1
    table = models.compare_models(df.drop("fold"), ["a", "b", "c"], "y", "id", {"Ridge": {"alpha": [0.1, 100.0]}, "GaussianProcess": {"kernel": ["rbf"]}}, 3).collect()
    assert table[0].best_r2 > 0.9 and {r.model for r in table} == {"Ridge", "GaussianProcess"}


def test_shapley_adds_up():
    rng = np.random.default_rng(1)
    x, base = rng.normal(size=(5, 3)), rng.normal(size=(7, 3))
    f = lambda q: q[:, 0] * q[:, 1] + 2 * q[:, 2]
    v = models.shapley(f, x, base)
    assert v.sum(axis=1) == pytest.approx(f(x) - f(base).mean())
    assert v[:, 2] == pytest.approx(2 * (x[:, 2] - base[:, 2].mean()))


def test_mask_files_round_trip(spark, tmp_path):
    a = np.zeros((4, 5), bool)
    a[1:3, 2:4] = True
    (tmp_path / "S1").mkdir()
    (tmp_path / "S1" / "img_1.mask").write_bytes(files.pack_masks([{"segmentation": a, "bbox": [2, 1, 2, 2], "predicted_iou": 0.5}, {"area": 3}]))
    (tmp_path / "S1" / "bad.mask").write_bytes(b"\xdd\x00")
    rows = {r.path.split("/")[-1]: r for r in files.read_masks(spark, str(tmp_path)).collect()}
    m = rows["img_1.mask"]
    assert (m.area, m.height, m.width, m.sample_id, len(m.pixels)) == (4, 4, 5, "S1", 4) and rows["bad.mask"].error
    for v in (None, True, -5, 300, 1 << 40, -(1 << 40), 1.5, "é" * 40, b"x" * 300, [1, [2]], {"a": {"b": 1}}, list(range(70000))):
        assert msgpack.unpack(msgpack.pack(v)) == v


def test_images_are_cropped(spark, tmp_path):
    image = np.arange(30 * 4 * 3, dtype=np.uint8).reshape(30, 4, 3)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# x\n4 30\n255\n" + image.tobytes())
    rows = files.read_images(spark, str(tmp_path), "*.ppm").orderBy("y").collect()
    assert len(rows) == 10 and rows[0].row == image[20].tolist()


def test_greedy_drop_prefers_std():
    assert select.greedy_drop(["a", "b_std", "c"], [("a", "b_std")]) == ["a", "c"]
    assert select.greedy_drop(["a", "b", "c"], [("a", "b"), ("b", "c")]) == ["a", "c"]


def test_stream(spark, tmp_path, pixels):
    from mosaiq.streaming import ingest

    pixels({"a": ["0110"], "b": ["2222"]}).write.parquet(str(tmp_path / "in"))
    q = ingest.write_regions(ingest.pixel_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.image_id, r.area) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("b", 4)]


def test_report_orders_by_first_target(spark):
    f = spark.createDataFrame([("s1", 1.0, 5.0), ("s2", 2.0, 4.0), ("s3", 3.0, 4.5)], "sample_id string, up double, down double")
    e = spark.createDataFrame([("s1", 1.0), ("s2", 2.1), ("s3", 2.9)], "sample_id string, Hc20 double")
    rows = analysis.report(analysis.correlate(f, e)).collect()
    assert [r.feature for r in rows] == ["up", "down"] and rows[0].target == "Hc20" and not math.isnan(rows[0]["corr"])


def test_gaps_are_filled_by_the_training_folds(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 2)) + [5.0, 0.0]
    y = x @ [2.0, 1.0] + 0.1 * rng.normal(size=90)
    x[rng.random(x.shape) < 0.3] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = models.with_folds(spark.createDataFrame(rows, "id int, a double, b double, y double"), "id", 3)
    fold = np.array([r.fold for r in df.orderBy("id").collect()])
    r2 = []
    for f in range(3):
        held = fold == f
        z = np.where(np.isnan(x), np.nanmean(x[~held], axis=0), x)
        s = (z - z[~held].mean(0)) / z[~held].std(0)
        w = np.linalg.solve(s[~held].T @ s[~held] + 2.0 * np.eye(2), s[~held].T @ (y[~held] - y[~held].mean()))
        e = s[held] @ w + y[~held].mean() - y[held]
        r2.append(1 - (e**2).sum() / ((y[held] - y[held].mean()) ** 2).sum())
    found = models.search_linear(df, ["a", "b"], "y", models.ridge, [2.0], 3)
    assert found["r2"].iloc[0] == pytest.approx(np.mean(r2))
    options = {"n_estimators": 2, "max_depth": 3, "min_samples_split": 2}
    assert np.isfinite(models.search_forests(df, ["a", "b"], "y", [options], 3)["r2"].iloc[0])
    assert np.isfinite(models.search_kernel(df, ["a", "b"], "y", "GaussianProcess", [{"kernel": "rbf"}], 3)["r2"].iloc[0])


def test_rows_keep_their_place_in_the_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,v\n" + "".join(f"S{i % 2},{i}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        table = files.read_table(spark, str(tmp_path / "t.csv"), place=True)
        rows = [r.v for r in table.orderBy(*files.PLACE).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == list(range(500)) and table.columns[0] == "sample_id"
