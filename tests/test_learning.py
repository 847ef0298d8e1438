import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F, types as T

from stackpulse.operators import balance, clean, evaluate, folded, learn, profile
from stackpulse.plans import classifiers, stack
from stackpulse.sources import models, sinks
from stackpulse.streaming import scoring


@pytest.fixture(scope="module")
def faults(spark):
    rng = np.random.default_rng(0)
    n = 900
    y = rng.choice([0, 1, 2], size=n, p=[.7, .2, .1])
    a = y * 2.0 + rng.normal(scale=.3, size=n)
    rows = [(i, float(a[i]), float(a[i] * 2 + 1), float(rng.normal()), 5.0, float(rng.normal(scale=.01)), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, copy double, noise double, flat double, thin double, fault int")


def test_smote(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(130, 3))
    y = np.r_[np.zeros(100), np.ones(20), np.full(9, 2), [3]].astype(int)
    x[y == 1] += 10
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(130)], "id long, y int, x array<double>")
    out = balance.smote(df, "id", "x", "y", 5, block_points=16).toPandas()
    assert out.groupby("y").size().to_dict() == {0: 100, 1: 100, 2: 100, 3: 1}
    for _, r in out[out["synthetic"]].iterrows():
        own, p = x[r["id"]], np.array(r["x"])
        others = x[(y == r["y"])]
        along = [np.dot(p - own, o - own) / max(np.dot(o - own, o - own), 1e-12) for o in others]
        on_line = [np.allclose(own + t * (o - own), p) and -1e-9 <= t <= 1 for o, t in zip(others, along)]
        assert any(on_line)


def test_stratified_split_is_exact(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(120)], "id long, y string")
    train, test = balance.stratified_split(df, "id", "y")
    assert {r["y"]: r["count"] for r in train.groupBy("y").count().collect()} == {"a": 72, "b": 24}
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 120


def test_prune_and_guards(faults):
    assert profile.prune_features(faults.drop("id"), "fault") == ["a", "noise"]
    with pytest.raises(ValueError):
        clean.require_trainable(faults.filter("fault = 0"), "fault")
    with pytest.raises(ValueError):
        clean.require_trainable(faults.limit(1), "fault")


def test_fault_plan(spark, faults):
    model, scored, features, score = classifiers.train_fault(
        faults, "id", "fault", grid={"numTrees": [5], "maxDepth": [4], "minInstancesPerNode": [2]})
    assert set(features) == {"a", "noise"} and score > 0.9
    metrics = evaluate.classification_metrics(scored, "fault", "predicted_class").first()
    assert metrics["accuracy"] > 0.95 and metrics["balanced_accuracy"] > 0.9
    r = scored.first()
    assert r["prediction_label"] == ("Normal" if r["predicted_class"] == 0 else "Faulty") and 0 < r["confidence"] <= 1


def dump(model):
    """Every stage of a fitted pipeline, as text; sums over tasks may differ in
    the last digits."""
    texts = [s.getStatement() if hasattr(s, "getStatement") else getattr(s, "toDebugString", None) and s.toDebugString.split("\n", 1)[1] for s in model.stages]
    return [t and re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda m: f"{float(m[0]):.9g}", t) for t in texts]


def test_plans_learn_from_the_training_part_alone(spark):
    rng = np.random.default_rng(8)
    n = 600
    y = rng.choice([0, 1], size=n, p=[.7, .3])
    x = np.c_[y * 2.0 + rng.normal(scale=.3, size=n), rng.normal(size=n), rng.normal(scale=.05, size=n)]
    rows = [(i, *(None if rng.random() < .05 else float(v) for v in x[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, thin double, y int")

    def spoilt(test):
        """Other values in test rows: far off, missing, and no longer thin."""
        changed = F.col("id").isin([r["id"] for r in test.collect()])
        return df.withColumns({c: F.when(changed, F.when(F.col("id") % 2 == 0, F.col("id") * 1000.0)).otherwise(F.col(c)) for c in ("a", "b", "thin")})

    grid = {"numTrees": [3], "maxDepth": [3], "minInstancesPerNode": [2]}
    one, two = (classifiers.train_fault(d, "id", "y", grid=grid) for d in (df, spoilt(balance.stratified_split(df, "id", "y")[1])))
    assert one[2] == two[2] and one[3] == pytest.approx(two[3]) and dump(one[0]) == dump(two[0])
    assert two[1].count() < one[1].count()  # outliers by the training limits
    grid = {"maxIter": [3], "maxDepth": [3], "stepSize": [0.3]}
    one, two = (classifiers.train_voltage(d, "id", "a", grid=grid) for d in (df, spoilt(balance.hash_split(df, "id")[1])))
    assert one[2] == pytest.approx(two[2]) and dump(one[0]) == dump(two[0])


def test_health_plan(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(i), float(v), float(rng.normal()), 2.0) for i, v in enumerate(rng.normal(3.2, 0.05, size=800))]
    df = spark.createDataFrame(rows, "id long, time double, utot double, other double, flat double").withColumn("u1", F.col("utot") * 10)
    model, top_model, metrics, top = classifiers.train_health(df, "id", "utot", "time", trees=10, depth=6)
    assert "u1" in top and "flat" not in top
    table = {(r["features"], r["part"]): r for r in metrics.collect()}
    assert table[("all", "train")]["accuracy"] > 0.85 and len(table) == 4
    assert np.isclose(table[("all", "test")]["critical_threshold"], np.quantile([r[2] for r in rows], 0.05))


def test_health_plan_augments_training_rows_only(spark, monkeypatch):
    rows = [(i, float(i), 3 + i / 400, None if i % 50 == 0 else float(i % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, time double, utot double, other double")
    seen, augment = [], learn.augment_extremes

    def watched(part, *args, **options):
        seen.extend(r["id"] for r in part.collect())
        return augment(part, *args, **options)

    monkeypatch.setattr(learn, "augment_extremes", watched)
    classifiers.train_health(df, "id", "utot", "time", trees=2, depth=2)
    assert len(seen) == len(set(seen)) and 300 < len(seen) < 330


def test_voltage_plan_and_storage(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(3 * a - b)) for i, (a, b) in enumerate(rng.uniform(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model, metrics, rmse = classifiers.train_voltage(df, "id", "y", grid={"maxIter": [10], "maxDepth": [4], "stepSize": [0.3]})
    assert metrics.first()["r2"] > 0.9 and rmse < 0.4
    models.save_model(model, str(tmp_path / "m"))
    back = models.load_model(str(tmp_path / "m"))
    one = learn.score_voltage(df, model).orderBy("id").toPandas()["Utot_Predicted"]
    assert np.allclose(one, learn.score_voltage(df, back).orderBy("id").toPandas()["Utot_Predicted"])
    # An absent feature counts as 0.
    assert learn.score_voltage(df.drop("b"), back).count() == 600


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    model = learn.train_boosted(df, ["a"], "y", n_estimators=3, max_depth=2)
    for part in range(3):
        df.filter(F.col("id") % 3 == part).coalesce(1).write.json(str(tmp_path / f"in{part}"))
    source, sink, mark = str(tmp_path / "in*"), str(tmp_path / "out"), str(tmp_path / "mark")
    score = lambda d: learn.score_voltage(d, model)
    scoring.score_records(spark, source, df.schema, score, sink, mark, max_files=1).awaitTermination()
    got = spark.read.parquet(sink).orderBy("id").toPandas()
    want = score(df).orderBy("id").toPandas()
    assert np.allclose(got["Utot_Predicted"], want["Utot_Predicted"]) and len(got) == 90
    scoring.score_records(spark, source, df.schema, score, sink, mark).awaitTermination()
    assert spark.read.parquet(sink).count() == 90


def test_stack_report_edges(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(0.7, 0.01, size=(60, 6))
    x[:3] += rng.normal(scale=5, size=(3, 6))
    x[5, 2] = 0.0
    rows = [(i, "2024-01-01 00:00:00" if i else "bad", [float(v) for v in r], float(i % 2)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:10], "id long, Date_Time string, cells array<double>, Load double")
    result = stack.stack_report(df, "id", conditions=["Load"], n_cells=6, eps=1.0, min_samples=5)
    s = result.summary.first()
    assert s["total_rows"] == 60 and 1 <= s["total_anomalies"] <= 3
    assert "1970-01-01 00:00:00" in {r["Date_Time"] for r in result.report.collect()} or s["total_anomalies"] < 3
    stack.write_stack_report(result, str(tmp_path / "r"), "run1")
    stack.write_stack_report(result, str(tmp_path / "r"), "run1")
    assert sinks.read_latest_run(spark, str(tmp_path / "r" / "anomalies")).count() == s["total_anomalies"]
    quiet = stack.stack_report(df, "id", conditions=["Load"], n_cells=6, eps=100.0, min_samples=2).summary.first()
    assert quiet["total_anomalies"] == 0 and quiet["most_affected_cell"] == "None" and quiet["max_voltage"] == 0


def test_thresholds_default(spark, tmp_path):
    assert sinks.read_thresholds(spark, str(tmp_path / "none")) == {"critical_threshold": 3.1, "degraded_threshold": 3.25}


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "y int, p int")
    rows = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rows["0"]["precision"] == rows["0"]["recall"] == rows["0"]["f1"] == 0 and rows["1"]["recall"] == 1


def test_one_vs_rest_curves(spark):
    df = spark.createDataFrame([(0, [.9, .1]), (1, [.2, .8]), (1, [.6, .4])], "y int, p array<double>")
    got = evaluate.one_vs_rest_curves(df, "y", "p", [0, 1]).toPandas()
    end = got[got["threshold"].isna()]
    assert sorted(end["class"]) == [0, 1] and (end["precision"] == 1).all()
    assert got[(got["class"] == 1) & (got["threshold"] == .4)]["precision"].iloc[0] == 1.0


def test_full_boosted_search_ends(spark, sf):
    """The registered search, with its whole grid and all rows."""
    import __spark_entry__ as entry

    got = entry.queries()["i17_grid_search_regression"](spark, sf).collect()
    assert got and len({r["cv_rmse"] for r in got}) == 1 and got[0]["cv_rmse"] > 0


def test_full_forest_search_ends(spark, sf):
    """The registered search, with its whole grid and all rows."""
    import __spark_entry__ as entry

    got = entry.queries()["i18_grid_search_classifier"](spark, sf).collect()
    assert len(got) == 8 and all(0 < r["score"] <= 1 for r in got)
    assert len({r["params"] for r in got}) == 8


def three_classes(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(int) + (x[:, 2] > 0.8)
    return spark.createDataFrame([(i, *map(float, r), int(c), i % 2) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y int, fold int")


def assembled(rows):
    return Pipeline(stages=[learn.preparation_stage(rows, list("abcd"), bounds=None), VectorAssembler(inputCols=[f"x_{c}" for c in "abcd"], outputCol="features")]).fit(rows)


def test_cut_back_trees_equal_shallow_ones(spark):
    df = three_classes(spark)
    rows = assembled(df).transform(df).withColumn(learn.WEIGHT, F.lit(1.0)).select("id", "features", "y", learn.WEIGHT).cache()
    params = dict(minInstancesPerNode=2, featureSubsetStrategy="2")
    deep = learn._search_forest("y", 6, 12, **params).fit(rows)
    x = np.array([r["features"].toArray() for r in rows.orderBy("id").collect()])
    forest = learn.saved_nodes(deep, spark)
    for depth in (3, 6, 12):
        shallow = learn._search_forest("y", 6, depth, **params).fit(rows)
        want = [r["prediction"] for r in shallow.transform(rows).orderBy("id").collect()]
        leaves = [learn.cut_back(t, depth) for t in forest]
        assert learn.staged_votes(x, forest, 6, leaves).tolist() == want


def test_forest_search_fits_preparation_inside_folds(spark):
    """Rows of the other fold change nothing in what a fold is fitted on."""
    df = three_classes(spark)
    seen = []

    def prepare(train):
        seen.append({r["fold"] for r in train.select("fold").distinct().collect()})
        return assembled(train)

    grid = {"numTrees": [2, 4], "maxDepth": [2, 5], "minInstancesPerNode": [2], "featureSubsetStrategy": ["sqrt", "log2"]}
    search, best = learn.tune_forest(df, "y", "fold", grid, prepare=prepare, weighted=True)
    assert seen == [{1}, {0}, {0, 1}]
    assert len(search.points) == 8 and best == max(search.scores)
    # With four features both strategies take two of them at each node.
    by = {tuple(p.values()): s for p, s in zip(search.points, search.scores)}
    assert all(by[t, d, 2, "sqrt"] == by[t, d, 2, "log2"] for t in (2, 4) for d in (2, 5))
    assert search.bestModel.transform(df).filter("prediction = y").count() > 700


def test_forest_search_in_parts(spark, monkeypatch):
    """A forest of many nodes is grown and scored a few trees at a time, with the
    scores that its trees have together."""
    df = three_classes(spark)
    rows = assembled(df).transform(df).withColumn(learn.WEIGHT, F.lit(1.0)).select("id", "features", "y", learn.WEIGHT).cache()
    learner = learn._search_forest("y", 7, 9, minInstancesPerNode=2, featureSubsetStrategy="2")
    assert len(list(learn.grown_forests(learner, rows, 900, 4))) == 1
    monkeypatch.setattr(learn, "GROWN_NODES", 400)
    parts = list(learn.grown_forests(learner, rows, 900, 4))
    assert len(parts) > 2 and sum(p.getNumTrees for p in parts) == 7 and parts[0].getNumTrees == 1
    assert all(p.getNumTrees == 1 or p.totalNumNodes < 800 for p in parts)
    assert len({t.toDebugString for p in parts for t in p.trees}) == 7
    stages = [(3, 4), (7, 9), (7, 4), (1, 9)]
    trees = [t for p in parts for t in learn.saved_nodes(p, spark)]
    x, y = (np.array([r[c].toArray() if c == "features" else r[c] for r in rows.collect()]) for c in ("features", "y"))
    want = []
    for n, depth in stages:
        said = learn.staged_votes(x, trees, n, [learn.cut_back(t, depth) for t in trees])
        want.append(np.mean([(said[y == c] == c).mean() for c in np.unique(y)]))
    held = []
    for most in (1, 300, 1 << 20):
        monkeypatch.setattr(learn, "SCORED_NODES", most)
        held.append([len(f) for f in learn._held_together(iter(parts), spark)])
        assert np.allclose(learn._stage_scores(iter(parts), rows, "y", stages), want)
    assert held[0] == [p.getNumTrees for p in parts] and held[-1] == [7]
    grid = {"numTrees": [2, 4], "maxDepth": [2, 5], "minInstancesPerNode": [2], "featureSubsetStrategy": ["sqrt"]}
    monkeypatch.setattr(learn, "GROWN_NODES", 40)
    search, best = learn.tune_forest(df, "y", "fold", grid, prepare=assembled, weighted=True)
    assert best == max(search.scores) and search.bestModel.transform(df).filter("prediction = y").count() > 700


def test_boosted_search_scores_rounds_of_one_fit(spark):
    """The same scores as fitting every grid point, from half the fits."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2]
    df = spark.createDataFrame([(Vectors.dense(a), float(b), i % 2) for i, (a, b) in enumerate(zip(x, y))], ["features", "y", "fold"])
    grid = {"maxIter": [3, 8], "maxDepth": [2, 3], "stepSize": [0.3]}
    search, rmse = learn.tune_boosted(df, "y", "fold", grid)
    want = []
    for point in search.points:
        learner = learn.boosted_trees("y", point["maxIter"], point["maxDepth"], point["stepSize"])
        want.append(np.mean([RegressionEvaluator(labelCol="y", metricName="mse").evaluate(
            learner.fit(df.filter(F.col("fold") != t).coalesce(1)).transform(df.filter(F.col("fold") == t))) for t in (0, 1)]))
    assert len(want) == 4 and np.allclose(search.scores, want, rtol=1e-3) and abs(rmse - min(search.scores) ** 0.5) < 1e-12
    best = search.points[int(np.argmin(search.scores))]
    assert search.bestModel.getNumTrees == best["maxIter"] and search.bestModel.getOrDefault("maxDepth") == best["maxDepth"]
    assert learn.search_table(search, spark).count() == 4


def _folding_rows(spark, n=6000):
    rng = np.random.default_rng(21)
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(0, 3, n)
    y = np.sin(a) + 0.5 * b * c + rng.normal(scale=.3, size=n)
    kind = (a + 2 * b + rng.normal(scale=2, size=n) > 12).astype(int) + (c == 2) * (a > 8)
    return spark.createDataFrame(
        [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i]), int(kind[i])) for i in range(n)], "id long, a double, b double, c double, y double, kind int")


def test_folded_boosting_equals_boosting_of_rows(spark):
    """Trees need the weight and mean of a cell only."""
    df, names = _folding_rows(spark), ["a", "b", "c"]
    whole = learn.score_voltage(df, learn.train_boosted(df, names, "y", n_estimators=4, max_depth=3), "p").orderBy("id").toPandas()["p"]
    model = learn.train_boosted(df, names, "y", n_estimators=4, max_depth=3, fold_rows=0)
    assert "EXCEPT" in model.stages[0].getStatement()
    assert np.allclose(learn.score_voltage(df, model, "p").orderBy("id").toPandas()["p"], whole)
    grid = {"maxIter": [2, 4], "maxDepth": [3], "stepSize": [0.1]}
    _, rows_metrics, rows_rmse = classifiers.train_voltage(df.drop("kind"), "id", "y", grid=grid)
    _, metrics, rmse = classifiers.train_voltage(df.drop("kind"), "id", "y", grid=grid, fold_rows=0)
    assert np.allclose(rmse, rows_rmse) and np.allclose(metrics.first(), rows_metrics.first())


def test_folded_forest_draws_rows(spark, tmp_path):
    df, names = _folding_rows(spark), ["a", "b", "c"]
    stage = learn.preparation_stage(df, names)
    _, cells = learn.fold_cells(df, stage, names, ["kind"], fold_rows=0)
    total = cells.agg(F.count("*"), F.sum("_n")).first()
    assert total[0] <= 540 and total[1] == 6000
    drawn = learn._with_draws(cells, 20, 42).agg(*[F.sum(f"_d{t}") for t in range(20)], F.var_samp(F.col("_d0") - F.col("_n")), F.avg("_n")).first()
    sums = np.array(drawn[:20])
    # Each tree draws Poisson(rows of a cell), trees apart from each other.
    assert len(set(sums)) > 15 and abs(sums.mean() - 6000) < 100 and 0.7 < drawn[20] / drawn[21] < 1.3
    whole = learn.train_forest(df, names, "kind", 8, 4)
    model = learn.train_forest(df, names, "kind", 8, 4, fold_rows=0)
    assert model.stages[-1].getNumTrees == 8 and model.stages[-1].numClasses == whole.stages[-1].numClasses
    said = [evaluate.classification_metrics(m.transform(df), "kind", "prediction").first()["balanced_accuracy"] for m in (whole, model)]
    assert abs(said[0] - said[1]) < 0.05
    weights = [{r["feature"]: r["importance"] for r in learn.importances(m, spark).collect()} for m in (whole, model)]
    assert all(abs(weights[0][c] - weights[1][c]) < 0.1 for c in names)
    models.save_model(model, str(tmp_path / "m"))
    back = learn.score_fault(df, models.load_model(str(tmp_path / "m")))
    assert back.join(learn.score_fault(df, model).select("id", F.col("predicted_class").alias("same")), "id").filter("same = predicted_class").count() == 6000


def test_folding_keeps_rows_that_do_not_repeat(spark):
    df = spark.createDataFrame([(i, float(i), float(i * 7919 % 6000), float(i % 2)) for i in range(600)], "id long, a double, b double, y double")
    stage = learn.preparation_stage(df, ["a", "b"])
    assert learn.fold_cells(df, stage, ["a", "b"], ["y"], fold_rows=0) is None
    assert learn.fold_cells(df, stage, ["a"], ["y"], fold_rows=0) is not None
    assert learn.fold_cells(df, stage, ["a"], ["y"]) is None


def _distinct_rows(spark, n=1500):
    """Rows of which hardly two share a cell."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(int) + (x[:, 2] > 0.8)
    return spark.createDataFrame([(i, *map(float, r), int(c), i % 2) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int, fold int")


def _unwanted(*args, **options):
    raise AssertionError("large tables are not fitted by rows")


def test_tree_of_cells_equals_spark_tree(spark):
    """Without draws, and with all features at each node, cells give the tree
    that Spark grows from the rows."""
    df, names = _folding_rows(spark, 2500).drop("y"), ["a", "b", "c"]
    rows = df.withColumn(learn.WEIGHT, F.when(F.col("kind") == 1, 2.5).otherwise(0.75))
    cuts = learn.bin_cuts(rows, names)
    held = folded.fold_rows(rows, names, [cuts[c] for c in names], "kind", learn.WEIGHT)
    assert held.n.sum() == 2500 and len(held.codes) < 600
    per_class = np.zeros((len(held.kinds), held.classes))
    for i, (label, weight) in enumerate(held.kinds):
        per_class[i, label] = weight
    shaped = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    x, y = np.array([[r[c] for c in names] for r in df.orderBy("id").collect()]), df.count()
    for depth, least in ((1, 1), (4, 1), (7, 3)):
        tree = folded.grow_tree(*folded.decoded(held.codes, held.sizes, len(held.kinds)), held.n, held.sizes, per_class, depth, least, 3, np.random.default_rng(0))
        model = learn.random_forest("kind", 1, depth, bootstrap=False, featureSubsetStrategy="all", minInstancesPerNode=least).fit(shaped)
        want = [r["prediction"] for r in model.transform(shaped).orderBy("id").collect()]
        at = np.zeros(y, int)
        bins = np.stack([folded.bins_of(x[:, f], held.cuts[f]) for f in range(3)], axis=1)
        said = learn.staged_votes(bins, [tree], 1, [tree["left"] < 0])
        assert said.tolist() == want and len(tree["left"]) == model.trees[0].numNodes
        assert (tree["raw"][0], at.sum()) == (2500, 0)


def test_large_forests_are_grown_a_tree_a_task(spark, monkeypatch):
    """Cells need not be far fewer than rows."""
    df, names = _distinct_rows(spark), ["a", "b", "c"]
    whole = learn.train_forest(df, names, "y", 12, 6)
    monkeypatch.setattr(learn, "random_forest", _unwanted)
    model = learn.train_forest(df, names, "y", 12, 6, fold_rows=0)
    forest = model.stages[-1]
    assert forest.getNumTrees == 12 and forest.numClasses == 3 and len({t.toDebugString for t in forest.trees}) == 12
    said = [evaluate.classification_metrics(m.transform(df), "y", "prediction").first()["balanced_accuracy"] for m in (whole, model)]
    assert abs(said[0] - said[1]) < 0.05
    weights = [m.stages[-1].featureImportances.toArray() for m in (whole, model)]
    assert np.allclose(*weights, atol=0.1)


def test_large_forest_search_uses_cells(spark, monkeypatch):
    """Both sides of a fold are folded; scores are those of the same trees on rows."""
    df = _distinct_rows(spark)
    prepare = lambda rows: Pipeline(stages=[learn.preparation_stage(rows, ["a", "b", "c"], bounds=None), VectorAssembler(inputCols=["x_a", "x_b", "x_c"], outputCol="features")]).fit(rows)
    grid = {"numTrees": [4, 12], "maxDepth": [2, 7], "minInstancesPerNode": [2], "featureSubsetStrategy": ["sqrt", "log2"]}
    rows, _ = learn.tune_forest(df, "y", "fold", grid, prepare=prepare, weighted=True)
    monkeypatch.setattr(learn, "grown_forests", _unwanted)
    cells, best = learn.tune_forest(df, "y", "fold", grid, prepare=prepare, weighted=True, fold_rows=0)
    assert cells.points == rows.points and best == max(cells.scores)
    assert np.allclose(cells.scores, rows.scores, atol=0.06)
    model = cells.bestModel.stages[-1]
    assert model.getNumTrees == cells.points[int(np.argmax(cells.scores))]["numTrees"]
    assert evaluate.classification_metrics(cells.bestModel.transform(df), "y", "prediction").first()["balanced_accuracy"] > 0.85
    # One stage, scored on rows by hand.
    shaped = prepare(df.filter("fold = 1")).transform(df)
    train = evaluate.with_class_weight(shaped.filter("fold = 1"), "y", learn.WEIGHT).select("features", "y", learn.WEIGHT)
    held = learn.folded_columns(*learn.as_columns(train, 3), "y")
    trees = [t for part in folded.held_trees(held.trees(5, 6, 2, 2, 42), held.classes) for t in part]
    test = shaped.filter("fold = 0").select("features", "y")
    got = learn._stage_scores(iter([trees[:3], trees[3:]]), learn.folded_test(test, held, 3, "y"), "y", [(5, 6), (2, 3)], "_n")
    forest = held.model(held.trees(5, 6, 2, 2, 42), "y", maxDepth=6)
    want = evaluate.classification_metrics(forest.transform(test), "y", "prediction").first()["balanced_accuracy"]
    assert got[0] == pytest.approx(want)


def test_unknown_grid_parameters_are_not_folded(spark):
    grid = {"numTrees": [2], "maxDepth": [3], "minInfoGain": [0.5]}
    search, _ = learn.tune_forest(_distinct_rows(spark, 300), "y", "fold", grid, prepare=lambda rows: Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features")]).fit(rows), weighted=True, fold_rows=0)
    assert search.bestModel.stages[-1].totalNumNodes == 2


def test_scores_looked_up_equal_scores_of_the_model(spark):
    df, names = _folding_rows(spark, 800), ["a", "b", "c"]
    for model in (learn.train_forest(df, names, "kind", 5, 4), learn.train_forest(df, names, "kind", 5, 4, fold_rows=0)):
        far = df.unionByName(df.limit(9).withColumns({"id": F.col("id") + 10_000, "a": F.lit(1e9), "b": F.lit(None).cast("double")}))
        got, want = (d.orderBy("id").select("id", "prediction", "probability", "rawPrediction").collect() for d in (learn.classified(far, model, 0), model.transform(far)))
        assert got == want and len(got) == 809
        assert "ArrowEvalPython" in learn.classified(far, model, 0)._jdf.queryExecution().toString()
        assert "ArrowEvalPython" not in learn.classified(far, model)._jdf.queryExecution().toString()
    loose = learn.train_forest(df, names, "kind", 2, 2, bounds=None)
    for least in (0, 1000):
        with pytest.raises(Exception):
            learn.classified(df.withColumn("a", F.lit(float("nan"))), loose, least).select("prediction").collect()
