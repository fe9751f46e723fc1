"""Boosted trees, support vectors, Gaussian processes and Shapley values, against brute force."""

import itertools
import math

import numpy as np
import pytest

from mosaiq.operators import attribution, boosting, kernel_models, models
from mosaiq.plans import analysis


def table(spark, x, y, fold=None):
    rows = [(i, 0 if fold is None else int(fold[i]), *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, fold int, " + ", ".join(f"f{j} double" for j in range(x.shape[1])) + ", y double")


def names(x):
    return [f"f{j}" for j in range(x.shape[1])]


# --- boosting -----------------------------------------------------------------------------------


def brute_split(x, g, reg):
    """Greatest gain over every feature, threshold and side of missing values; hessians are 1."""
    score = lambda m: g[m].sum() ** 2 / (m.sum() + reg)
    best = (0.0, None)
    for j in range(x.shape[1]):
        for t in np.unique(x[~np.isnan(x[:, j]), j]):
            for to_left in (False, True):
                left = np.where(np.isnan(x[:, j]), to_left, x[:, j] <= t).astype(bool)
                if left.any() and not left.all():
                    gain = 0.5 * (score(left) + score(~left) - score(np.ones(len(g), bool)))
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, t, to_left))
    return best


@pytest.mark.parametrize("reg", [0.0, 1.0])
def test_first_split_is_the_best(spark, reg):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (300, 4)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    y = np.where(np.isnan(x[:, 2]), 3.0, x[:, 2] > 11) + 0.1 * rng.normal(size=300)
    model = boosting.fit(table(spark, x, y).repartition(4), names(x), "y", "id", [boosting.Setting(1, 1.0, 1, reg=reg)], [-1])[0][0]
    gain, (feature, threshold, to_left) = brute_split(x, y.mean() - y, reg)
    t = model.trees[0]
    assert (t.feature[0], t.threshold[0], bool(t.missing_left[0])) == (feature, threshold, to_left) and gain > 0
    left = np.where(np.isnan(x[:, feature]), to_left, x[:, feature] <= threshold).astype(bool)
    for node, rows in ((t.left[0], left), (t.right[0], ~left)):
        assert t.value[node] == pytest.approx((y[rows] - y.mean()).sum() / (rows.sum() + reg)) and t.cover[node] == rows.sum()


def test_models_of_one_pass_are_those_of_their_own(spark):
    """Folds, settings and subsamples side by side give what each gives alone; margins are predictions."""
    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(240, 3)), np.arange(240) % 3
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0)
    df = table(spark, x, y, fold)
    settings = [boosting.Setting(12, 0.3, 3), boosting.Setting(5, 0.5, 2, subsample=0.7)]
    together, seen = boosting.fit(df, names(x), "y", "id", settings, [0, 1, 2], (5, 12))
    alone = boosting.fit(df.where("fold <> 1"), names(x), "y", "id", settings[1:], [-1])[0][0]
    other = together[4]
    assert np.allclose(boosting.predict(alone, x), boosting.predict(other, x), atol=0.2) and len(other.trees) == 5
    assert other.trees[0].cover[0] == boosting.drawn(np.array([r.row for r in _rows(df)], np.int64).view(np.uint64)[fold != 1], 0, 0.7).sum()
    for r in seen[12].collect():
        margins = np.frombuffer(r.margins)
        at = int(np.argmin(np.abs(y - r.label)))
        assert margins == pytest.approx([boosting.predict(m, x[at : at + 1])[0] for m in together])
    r2 = lambda m, own: 1 - ((boosting.predict(m, x[own]) - y[own]) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum()
    assert all(r2(together[f], fold == f) > 0.5 for f in range(3))


def _rows(df):
    from pyspark.sql import functions as F

    return df.select("id", F.xxhash64(F.col("id"), F.lit(42)).alias("row")).orderBy("id").collect()


def test_boosting_of_odd_tables(spark, tmp_path):
    x = np.array([[1.0, np.nan], [1.0, np.nan], [1.0, np.nan]])
    flat = boosting.fit(table(spark, x, np.array([1.0, 2.0, 6.0])), names(x), "y", "id", [boosting.Setting(2, 0.1, 3)], [-1])[0][0]
    assert boosting.predict(flat, x) == pytest.approx([3.0] * 3)  # nothing to split by
    none = boosting.fit(table(spark, x, np.ones(3)).limit(0), names(x), "y", "id", [boosting.Setting(1, 0.1, 2)], [-1])[0][0]
    assert none.base == 0.0 and len(none.trees) == 1
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    m = boosting.fit(table(spark, x, x[:, 0]), names(x), "y", "id", [boosting.Setting(3, 0.5, 2)], [-1])[0][0]
    boosting.write(spark, m, str(tmp_path / "m"))
    back = boosting.read(spark, str(tmp_path / "m"))
    assert np.array_equal(boosting.predict(back, x), boosting.predict(m, x))


def test_grid_shares_its_passes(spark):
    """Candidates that differ by their number of trees only are one model, scored on the way."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 2))
    y = x[:, 0] + 0.1 * rng.normal(size=150)
    df = models.with_folds(table(spark, x, y).drop("fold"), "id", 3)
    options = [("XGBoost", {"n_estimators": n, "learning_rate": 0.2, "max_depth": 2, "subsample": s}) for n in (4, 9) for s in (0.8, 1.0)]
    options.append(("GradientBoosting", {"n_estimators": 4, "learning_rate": 0.2, "max_depth": 2}))
    found = models.search_boosting(df, names(x), "y", "id", options, 3)
    assert sorted(found.index) == [0, 1, 2, 3, 4] and (found["r2"][[2, 3]].to_numpy() > found["r2"][[0, 1]].to_numpy()).all()
    fold = np.array([r.fold for r in df.orderBy("id").collect()])
    one = boosting.fit(df, names(x), "y", "id", [models.setting(*options[3])], [0, 1, 2])[0]
    e = [boosting.predict(one[f], x[fold == f]) - y[fold == f] for f in range(3)]
    assert found["mae"][3] == pytest.approx(np.abs(np.concatenate(e)).mean())


# --- support vectors ------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["rbf", "linear"])
@pytest.mark.parametrize("cost", [0.1, 10.0])
def test_dual_is_optimal(kind, cost):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(120, 3))
    z[7] = z[8]  # repeated rows
    y = 2 * z[:, 0] + np.sin(3 * z[:, 1]) + 0.2 * rng.normal(size=120)
    kernel = kernel_models.svr_kernel(kind, 3)
    coef, offset = kernel_models.svr_dual(z, y, kernel, cost, tolerance=1e-5)
    f = kernel(z, z) @ coef + offset
    r = y - f
    assert abs(coef.sum()) < 1e-8 and np.abs(coef).max() <= cost + 1e-12
    # complementary slackness: free ones lie on the tube, bound ones outside, the rest within
    free, bound = (np.abs(coef) > 1e-9) & (np.abs(coef) < cost - 1e-9), np.abs(coef) >= cost - 1e-9
    assert np.allclose(np.abs(r[free]), 0.1, atol=1e-3) and (np.sign(coef[free]) == np.sign(r[free])).all()
    assert (np.abs(r[bound]) >= 0.1 - 1e-3).all() and (np.abs(r[coef == 0]) <= 0.1 + 1e-3).all()
    primal = 0.5 * coef @ kernel(z, z) @ coef + cost * np.maximum(np.abs(r) - 0.1, 0).sum()
    dual = -0.5 * coef @ kernel(z, z) @ coef + y @ coef - 0.1 * np.abs(coef).sum()
    assert primal - dual <= 1e-3 * max(1.0, primal)


def test_dual_with_a_small_cache(monkeypatch):
    monkeypatch.setattr(kernel_models, "CACHE_BYTES", 1)
    z = np.random.default_rng(2).normal(size=(50, 2))
    kernel = kernel_models.svr_kernel("rbf", 2)
    coef, offset = kernel_models.svr_dual(z, z[:, 0], kernel, 10.0)
    assert np.abs(kernel(z, z) @ coef + offset - z[:, 0]).max() < 0.35
    assert kernel_models.svr_dual(z[:0], z[:0, 0], kernel, 1.0)[1] == 0.0


def test_primal_beyond_one_task_is_the_dual(spark):
    """All rows as landmarks: the same function as the dual's; few landmarks: nearly."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2))
    y = 5 + 3 * x[:, 0] + np.cos(2 * x[:, 1])
    df, choices = table(spark, x, y, np.arange(150) % 3), [{"kernel": k, "C": c} for k in ("rbf", "linear") for c in (0.1, 1)]
    data = models.numeric(df, names(x), "y")
    exact = kernel_models.fit_svr(data, names(x), "y", choices, [0, -1])
    wide = kernel_models.fit_svr(data, names(x), "y", choices, [0, -1], exact_rows=10)
    assert set(exact) == set(wide)
    for at, predict in exact.items():
        assert np.abs(predict(x) - wide[at](x)).max() < 0.06, at


@pytest.mark.parametrize("times", [1, 60])
def test_support_vectors_are_the_same_at_any_size(spark, times):
    """Every row sixty times at a sixtieth of the cost, and once, are the same problem; the dual is the yardstick."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 2))
    y = 5 + 3 * x[:, 0] + np.cos(2 * x[:, 1])
    df = table(spark, np.repeat(x, times, axis=0), np.repeat(y, times), np.zeros(100 * times, int))
    data = models.numeric(df, names(x), "y")
    predict = kernel_models.fit_svr(data, names(x), "y", [{"kernel": "rbf", "C": 6.0 / times}], [-1])["rbf", 6.0 / times, -1]
    z, kernel = (x - x.mean(0)) / x.std(0), kernel_models.svr_kernel("rbf", 2)
    coef, offset = kernel_models.svr_dual(z, y, kernel, 6.0, tolerance=1e-5)
    assert np.abs(predict(x) - kernel(z, z) @ coef - offset).max() < 0.02


# --- Gaussian processes ----------------------------------------------------------------------------


def test_process_is_exact_with_all_rows_as_landmarks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    y = 10 + np.sin(2 * x[:, 0]) + 0.05 * rng.normal(size=90)
    data = models.numeric(table(spark, x, y, np.arange(90) % 3), names(x), "y")
    found = kernel_models.fit_processes(data, names(x), "y", ["rbf", "matern"], [1, -1])
    for (kind, f), predict in found.items():
        own = np.arange(90) % 3 != f
        z = (x - x[own].mean(0)) / x[own].std(0)
        t = (y[own] - y[own].mean()) / y[own].std()
        best = None
        for length in kernel_models.LENGTHS:
            for noise in kernel_models.NOISES:
                k = kernel_models.covariance(kind, kernel_models.distances(z[own], z[own]), length) + noise * np.eye(own.sum())
                score = -0.5 * t @ np.linalg.solve(k, t) - 0.5 * np.linalg.slogdet(k)[1]
                if best is None or score > best[0]:
                    best = (score, kernel_models.covariance(kind, kernel_models.distances(z, z[own]), length) @ np.linalg.solve(k, t) * y[own].std() + y[own].mean())
        assert np.allclose(predict(x), best[1], atol=1e-4)


def test_process_with_few_landmarks(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2))
    y = x[:, 0] + 0.01 * rng.normal(size=400)
    data = models.numeric(table(spark, x, y), names(x), "y")
    predict = kernel_models.fit_processes(data, names(x), "y", ["rbf"], [-1], most=40)["rbf", -1]
    assert np.abs(predict(x) - y).mean() < 0.05
    gaps = np.array([[np.nan, 0.0]])
    assert predict(gaps) == pytest.approx(predict(np.array([[x[:, 0].mean(), 0.0]])))


# --- Shapley values ----------------------------------------------------------------------------------


def grown(rng, p, depth, n=150):
    """A random tree over random rows: flat nodes, and the rows."""
    x, nodes = rng.normal(size=(n, p)), []

    def grow(rows, left_over):
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, False, rng.normal(), len(rows)))
        f, t = int(rng.integers(p)), float(rng.normal() / 2)
        low = x[rows, f] <= t
        if left_over and low.any() and not low.all():
            left, right = grow(rows[low], left_over - 1), grow(rows[~low], left_over - 1)
            nodes[at] = (f, t, left, right, bool(rng.integers(2)), 0.0, len(rows))
        return at

    grow(np.arange(n), depth)
    return [np.array(c) for c in zip(*nodes, strict=True)], x


def follow(tree, row, known, at=0):
    """The value of a row of which only some features are known."""
    feature, threshold, left, right, missing_left, value, cover = tree
    f = feature[at]
    if f < 0:
        return value[at]
    if f not in known:
        return sum(cover[c] / cover[at] * follow(tree, row, known, c) for c in (left[at], right[at]))
    low = missing_left[at] if np.isnan(row[f]) else row[f] <= threshold[at]
    return follow(tree, row, known, left[at] if low else right[at])


def all_subsets(tree, row, p):
    out = np.zeros(p)
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        for k in range(p):
            weight = math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p)
            for s in itertools.combinations(rest, k):
                out[i] += weight * (follow(tree, row, {*s, i}) - follow(tree, row, set(s)))
    return out


@pytest.mark.parametrize("depth", [1, 4, 8])
def test_tree_values_are_those_of_all_subsets(depth):
    rng = np.random.default_rng(depth)
    trees = [grown(rng, 5, depth)[0] for _ in range(2)]
    x = rng.normal(size=(6, 5))
    x[1, 2] = x[2, :3] = np.nan
    leaves = [attribution.paths(*t) for t in trees]
    got = attribution.tree_values(leaves, x)
    assert np.allclose(got, [sum(all_subsets(t, r, 5) for t in trees) for r in x])
    whole = lambda q: np.array([sum(follow(t, r, set(range(5))) for t in trees) for r in q])
    assert np.allclose(got.sum(axis=1), whole(x) - attribution.expected(leaves))
    back = rng.normal(size=(7, 5))
    assert np.allclose(attribution.tree_values(leaves, x, back), models.shapley(whole, x, back))


def test_wide_trees_add_up():
    rng = np.random.default_rng(11)
    tree, x = grown(rng, 701, 14, 3000)
    leaves = [attribution.paths(*tree)]
    got = attribution.tree_values(leaves, x[:20])
    assert np.allclose(got.sum(axis=1), [follow(tree, r, set(range(701))) for r in x[:20]] - np.array(attribution.expected(leaves)))


def test_sampled_values_add_up():
    rng = np.random.default_rng(12)
    f = lambda q: q[:, 0] * q[:, 1] + 2 * q[:, 2]
    x, back = rng.normal(size=(4, 3)), rng.normal(size=(9, 3))
    got = attribution.sampled_values(f, x, back, rounds=60)
    assert np.allclose(got.sum(axis=1), f(x) - f(back).mean()) and np.allclose(got, models.shapley(f, x, back), atol=0.15)


@pytest.mark.parametrize("name", sorted(models.GRIDS))
def test_every_model_can_be_explained(spark, name):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 12))  # more features than all subsets would allow
    y = 3 * x[:, 4] + 0.05 * rng.normal(size=120)
    x[3, 4] = x[5, 0] = np.nan
    df = table(spark, x, y).drop("fold")
    options = models.grid(models.GRIDS[name])[-1]
    options |= {"n_estimators": 8, "max_depth": 4} if "n_estimators" in options else {"alpha": 0.1} if "alpha" in options else {}
    final = models.final_model(df, names(x), "y", "id", name, options)
    values = final.values(x[:10])
    assert values.shape == (10, 12) and np.isfinite(values).all()
    if name in ("RandomForest", "GradientBoosting", "XGBoost"):
        assert final.expected == pytest.approx(y.mean(), abs=0.6)
    top = models.mean_attribution(df, names(x), "y", "id", name, options).first()
    assert top.feature == "f4" and top.mean_abs_shap > 0.3


def test_forest_leaves_predict_like_spark(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(150, 3))
    df = table(spark, x, x[:, 0] * x[:, 1])
    data = models.assembled(df, names(x), "y")
    m = models.tree_model({"n_estimators": 5, "max_depth": 6, "min_samples_split": 2}).fit(data)
    want = np.array([r.prediction for r in m.transform(data).collect()])
    got = np.array([(r.features.toArray(), r.prediction) for r in m.transform(data).collect()], dtype=object)
    leaves = models.forest_paths(m)
    q = np.vstack(got[:, 0])
    assert np.allclose(attribution.tree_values(leaves, q).sum(axis=1) + attribution.expected(leaves), want)


def test_the_model_stage_explains_its_winner(spark):
    rng = np.random.default_rng(15)
    rows = [(f"s{i}", *map(float, r)) for i, r in enumerate(rng.normal(size=(60, 12)))]
    f = spark.createDataFrame(rows, "sample_id string, " + ", ".join(f"f{j} double" for j in range(12)))
    e = spark.createDataFrame([(r[0], 2 * r[4] + r[5]) for r in rows], "sample_id string, Hc20 double")
    grids = {"Ridge": {"alpha": [0.01]}, "XGBoost": {"n_estimators": [3], "learning_rate": [0.1], "max_depth": [2], "subsample": [1.0]}}
    out = analysis.model(f, e, "Hc20", grids=grids, k=3, trees=3)
    assert out["models"].first().model == "Ridge"
    assert out["attribution"].first().feature == "f3"
    assert out["attribution"].count() == out["selected"].count()
