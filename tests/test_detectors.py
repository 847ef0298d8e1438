import numpy as np
import pytest
from pyspark.sql import functions as F

from stackpulse.operators import forest, ordered, reduce, series as ops, windows
from stackpulse.operators.warping import warp, warp_distances
from stackpulse.plans import votes


def make(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def slow_warp(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return d[-1, -1]


def test_warp_properties():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(6, 30, 2)), rng.normal(size=(30, 2))
    got = warp(a, b)
    assert np.allclose(got, [slow_warp(x, b) for x in a])
    assert warp(b[None], b)[0] == 0
    assert np.allclose(got, [warp(b[None], x)[0] for x in a])
    aligned = np.linalg.norm(a - b, axis=2).sum(axis=1)
    assert (got <= aligned + 1e-9).all()
    assert np.allclose(warp(a, b, band=0), aligned)
    assert (warp(a, b, band=3) >= got - 1e-9).all()


@pytest.mark.parametrize("block", [30, 41, 4096])
def test_warp_distances_by_block(spark, block):
    rng = np.random.default_rng(1)
    rows = [(s, i, float(rng.normal()), float(rng.normal())) for s, n in (("a", 120), ("b", 31), ("c", 30)) for i in range(n)]
    df = ordered.index_rows(spark.createDataFrame(rows, "s string, t long, u double, v double"), ["t"], ["s"])
    ref = ops.reference_window(df, ["u", "v"], series=["s"])
    got = warp_distances(df, ["u", "v"], ref, 30, ["s"], block_rows=block).toPandas()
    assert len(got) == 90 + 1
    refs = {r["s"]: np.array(r["reference"]) for r in ref.collect()}
    pdf = df.toPandas().sort_values(["s", "row_no"])
    for s in ("a", "b"):
        x = pdf[pdf["s"] == s][["u", "v"]].to_numpy()
        part = got[got["s"] == s].sort_values("row_no")
        assert np.allclose(part["dtw_distance"], [slow_warp(x[t - 30:t], refs[s]) for t in part["row_no"]])


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(380, 4)), rng.normal(loc=9, size=(20, 4)) * rng.choice([-1, 1], size=(20, 4))]
    df = make(spark, x)
    model = forest.fit_forest(df, "id", "x").with_threshold(df, "x")
    s = model.score(df, "x").toPandas().set_index("id")["score"].sort_index().to_numpy()
    assert ((s > 0) & (s < 1)).all() and s[380:].min() > np.median(s[:380])
    flags = model.flag(df, "x").filter("iso_anomaly").toPandas()["id"]
    assert len(flags) == 20 and set(flags) == set(range(380, 400))
    again = forest.fit_forest(df, "id", "x").score(df, "x").toPandas().set_index("id")["score"].sort_index()
    assert np.allclose(s, again)


def test_forest_save_load_and_small_samples(spark, tmp_path):
    df = make(spark, np.random.default_rng(3).normal(size=(40, 2)))
    model = forest.fit_forest(df, "id", "x", trees=5).with_threshold(df, "x")
    model.save(str(tmp_path / "forest"))
    back = forest.IsolationForest.load(spark, str(tmp_path / "forest"))
    assert model.psi == back.psi == 40
    assert np.allclose([r["score"] for r in model.score(df, "x").orderBy("id").collect()],
                       [r["score"] for r in back.score(df, "x").orderBy("id").collect()])
    one = make(spark, np.ones((10, 2)))
    assert forest.fit_forest(one, "id", "x", trees=2).score(one, "x").count() == 10


def test_samples_of_a_large_table(spark):
    df = make(spark, np.random.default_rng(4).normal(size=(3000, 1)))
    sizes = [r["count"] for r in forest.tree_samples(df, "id", 5, 64, 1).groupBy("tree").count().collect()]
    assert len(sizes) == 5 and max(sizes) == 64 and min(sizes) > 40


def test_shapley_adds_up(spark):
    df = make(spark, np.random.default_rng(5).normal(size=(30, 3)))
    model = forest.fit_forest(df, "id", "x", trees=10)
    base = forest.background_rows(df, "id", "x", 6)
    got = forest.shapley_values(df, "id", "x", model, base, permutations=4).groupBy("id").agg(F.sum("contribution").alias("s"))
    total = got.toPandas().set_index("id")["s"].sort_index()
    s = -model.score(df, "x").toPandas().set_index("id")["score"].sort_index()
    mean = -np.mean([r["score"] for r in model.score(make(spark, base), "x").collect()])
    assert np.allclose(total, s - mean)


def test_shapley_paths_and_full_settings(spark, sf, monkeypatch):
    """Paths score as the rows that they stand for, and the registered query
    takes 100 trees, 100 background rows and 4 orders."""
    import __spark_entry__ as entry

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(80, 5)), 1)
    model = forest.fit_forest(make(spark, x), "id", "x", trees=12)
    trees, path = model.tables(), rng.permutation(5)
    steps = np.repeat(x[None, :9], 6, axis=0)
    for i, feature in enumerate(path):
        steps[i + 1:, :, feature] = x[20, feature]
    want = forest.forest_scores(steps.reshape(-1, 5), trees, model.psi).reshape(6, 9)
    assert np.allclose(forest.path_scores(x[20], x[:9], np.argsort(path), forest.one_table(trees), model.psi), want)
    seen = {}

    def values(df, key, vector, model, background, permutations=4, **more):
        seen.update(trees=len(model.tables()), rows=len(background), orders=permutations)
        return df.select(key)

    monkeypatch.setattr(forest, "shapley_values", values)
    entry.queries()["i27_shapley"](spark, sf)
    assert seen == dict(trees=100, rows=min(100, spark.read.parquet(f"{sf}/embeddings.parquet").count()), orders=4)


def test_shapley_rows_share_their_work(spark):
    """Many rows are explained by a few matrix products a feature, and as if each
    were explained alone; gaps go right like in the trees."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(700, 6)), 1)
    x[3, 2], x[4, 0] = np.nan, np.inf
    model = forest.fit_forest(make(spark, x[10:]), "id", "x", trees=15)
    trees, joined = model.tables(), forest.one_table(model.tables())
    got = forest.mean_gains(x[:40], x[600:612], forest.leaf_boxes(joined), model.psi, 4, 42)
    for row, gains in zip(x[:8], got):
        want = np.zeros(6)
        for order in range(4):
            path = np.random.default_rng([42, order // 2]).permutation(6)[::-1 if order % 2 else 1]
            steps = np.repeat(x[None, 600:612], 7, axis=0)
            for i, feature in enumerate(path):
                steps[i + 1:, :, feature] = row[feature]
            scores = forest.forest_scores(steps.reshape(-1, 6), trees, model.psi).reshape(7, 12).mean(axis=1)
            want[path] -= np.diff(scores) / 4
        assert np.allclose(gains, want)
    # One file of rows is dealt out over all cores.
    one = make(spark, x[:300]).coalesce(1)
    plan = forest.shapley_values(one, "id", "x", model, x[600:612])
    assert "REPARTITION_BY_NUM" in plan._jdf.queryExecution().toString()
    assert plan.count() == 300 * 6
    # Tables with keys that repeat give the mean of their rows.
    twice = forest.shapley_values(one.unionByName(one), "id", "x", model, x[600:612])
    assert twice.count() == 300 * 6


def test_forests_of_single_leaves(spark):
    model = forest.fit_forest(make(spark, np.ones((20, 3))), "id", "x", trees=3)
    got = forest.shapley_values(make(spark, np.arange(12.0).reshape(4, 3)), "id", "x", model, np.ones((2, 3)))
    assert got.count() == 12 and got.filter("contribution <> 0").count() == 0


def test_axes_of_wide_and_thin_tables(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(240, 6)) * [9, 7, 5, 4, 3, 2] @ rng.normal(size=(6, 3_000)) + 0.01 * rng.normal(size=(240, 3_000)) + 3
    df = make(spark, x).repartition(5)
    for fit, table in ((reduce.fit_pca, x - x.mean(axis=0)), (reduce.fit_svd, x)):
        axes = fit(df, "x", 4)
        _, s, vt = np.linalg.svd(table, full_matrices=False)
        assert np.allclose(axes.singular, s[:4], rtol=1e-8)
        assert np.allclose(np.abs((axes.components() * vt[:4]).sum(axis=1)), 1, atol=1e-8)
    y = rng.normal(size=(300, 12)) + 5
    exact, wide = (reduce.fit_pca(make(spark, y).repartition(7), "x", 3, wide=w) for w in (2048, 2))
    assert np.allclose(exact.singular, np.linalg.svd(y - y.mean(axis=0))[1][:3])
    assert np.allclose(exact.singular, wide.singular) and np.allclose(exact.components(), wide.components(), atol=1e-6)


def test_axes_of_odd_tables(spark):
    few = make(spark, np.array([[1.0, 2.0, 2.0], [1.0, 2.0, 2.0]]))
    axes = reduce.fit_svd(few, "x", 3)
    assert np.allclose(axes.singular, [18 ** .5, 0, 0])
    assert np.allclose(axes.components() @ axes.components().T, np.eye(3))
    assert np.allclose(reduce.fit_pca(few, "x", 2).singular, 0)
    gap = few.unionByName(few.limit(1).withColumn("x", F.lit(None).cast("array<double>")))
    assert np.allclose(reduce.fit_svd(gap, "x", 1).singular, [18 ** .5])
    with pytest.raises(ValueError):
        reduce.fit_pca(few.limit(0), "x", 1)
    with pytest.raises(ValueError):
        reduce.fit_pca(few, "x", 4)


def test_axes(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(200, 5)) @ np.diag([5, 3, 1, .5, .1]) + 4
    df = make(spark, x)
    axes = reduce.fit_pca(df, "x", 2)
    v = axes.components()
    assert np.allclose(v @ v.T, np.eye(2))
    got = reduce.with_pca_columns(df, axes, "x").orderBy("id").toPandas()[["PCA1", "PCA2"]].to_numpy()
    assert np.allclose(got, (x - x.mean(axis=0)) @ v.T)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(np.abs(vt[:2]), np.abs(v))
    s = reduce.fit_svd(df, "x", 2)
    _, _, vt = np.linalg.svd(x)
    assert np.allclose(np.abs(vt[:2]), np.abs(s.components()))
    err = reduce.reconstruction_error(df, axes, "x").orderBy("id").toPandas()["recon_error"]
    c = x - x.mean(axis=0)
    assert np.allclose(err, ((c - c @ v.T @ v) ** 2).mean(axis=1))
    axes.save(spark, str(tmp_path / "axes"))
    back = reduce.Axes.load(spark, str(tmp_path / "axes"))
    assert np.allclose(back.components(), v)


def test_vote(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in ("a", "b"):
        for i in range(260):
            rows.append((s, i, float(np.sin(i / 5) + rng.normal(scale=.1) + (8 if 230 < i < 245 else 0)), float(rng.normal())))
    df = spark.createDataFrame(rows, "s string, t long, current double, voltage double")
    table = ops.series_features(df, ["t"], ["s"])
    model = votes.fit_series_model(table, ["s"], trees=30)
    result = votes.vote_series(table, model)
    summary = result.summary.first()
    assert summary["total_rows"] == 2 * (251 - 30) == result.windows.count()
    assert 0 < summary["anomalies"] <= 0.1 * summary["total_rows"] + 1
    rows = result.rows.toPandas()
    assert rows["anomaly"].sum() == summary["anomalies"] and len(rows) == 502
    assert rows.query("anomaly == 1")["source_row"].between(230, 260).all()


@pytest.mark.parametrize("block", [64, 4096])
def test_window_errors_without_a_window_table(spark, block):
    """Equal to principal axes fitted on a table of all windows."""
    rng = np.random.default_rng(12)
    rows = [(s, i, float(5 + np.sin(i / 5) + rng.normal() / 9), float(rng.normal())) for s, n in (("a", 200), ("b", 33), ("c", 30), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, row_no long, u double, v double").repartition(5)
    plain = ordered.sequences(df, ["u", "v"], 30, ["s"]).selectExpr("s", "row_no", "flatten(window) AS w")
    axes = reduce.fit_pca(plain, "w", 4)
    want = {(r["s"], r["row_no"]): r["recon_error"] for r in reduce.reconstruction_error(plain, axes, "w").collect()}
    mine = windows.fit_window_axes(df, ["u", "v"], 30, 4, ["s"], block)
    got = {(r["s"], r["row_no"]): r["recon_error"] for r in windows.window_errors(df, ["u", "v"], 30, mine, ["s"], block).collect()}
    assert got.keys() == want.keys() and len(got) == 173
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_window_covariance_of_nothing(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "s string, row_no long, u double")
    n, mean, covariance = windows.window_covariance(df, ["u"], 30, ["s"])
    assert n == 0 and not mean.any() and not covariance.any()


def test_all_trees_are_walked_at_once():
    """Scores equal those of a walk through one tree after another, whatever rows
    stand beside a row, and the number of trees adds no calls."""
    rng = np.random.default_rng(8)
    trees = []
    for levels in (0, 1, 3, 4):
        n = 2 ** (levels + 1) - 1
        inner, node = np.arange(n) < 2 ** levels - 1, np.arange(n)
        trees.append({"left": np.where(inner, 2 * node + 1, node), "right": np.where(inner, 2 * node + 2, node), "feature": np.where(inner, rng.integers(0, 3, n), 0),
                      "threshold": rng.normal(size=n), "path": rng.random(n) * 5, "levels": levels})
    x = rng.normal(size=(600, 3))
    x[5, 1] = np.nan

    def walk(row):
        total = 0.0
        for t in trees:
            at = 0
            while t["left"][at] != at:
                at = t["left"][at] if row[t["feature"][at]] < t["threshold"][at] else t["right"][at]
            total += t["path"][at]
        return 2.0 ** (-(total / len(trees)) / float(forest.average_path(16)))

    table = forest.packed(trees)
    got = forest.forest_scores(x, table, 16)
    assert np.allclose(got, [walk(r) for r in x], rtol=1e-12)
    assert (got == forest.forest_scores(x, trees, 16)).all() and (got[300:303] == forest.forest_scores(x[300:303], table, 16)).all()
    assert len(forest.forest_scores(x[:0], table, 16)) == 0 and np.isnan(forest.forest_scores(x, forest.packed([]), 0)).all()
