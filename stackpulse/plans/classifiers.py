"""Training plans of the health, fault and voltage models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators import balance, clean, evaluate, learn, profile
from ..schema import numeric_columns, require_columns
from ..session import materialise


def _filled(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Both parts with the means of the training part in place of nulls."""
    means = clean.stored_means(train, columns).first().asDict()
    return [p.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in columns}) for p in (train, test)]


def train_health(
    df: DataFrame, key: str, target: str, time: str, exclude: Sequence[str] = (), trees: int = 100, depth: int = 10, augment: bool = True
) -> tuple[PipelineModel, PipelineModel, DataFrame, list[str]]:
    """(model, model on top features, metrics, top features).

    Labels are cut at the 5 % and 50 % quantiles of the target. The source rows
    are split first; fill values and the choice of columns come from the
    training part, and only that part gets synthetic extremes, so no copy of a
    row is on the other side.
    """
    require_columns(df, [key, target, time])
    numeric = numeric_columns(df, [key])
    labelled, cuts = learn.health_labels(df, target)
    parts = [materialise(p.drop("Health_State", "Health_State_Code"), "health_rows") for p in balance.stratified_split(labelled, key, "Health_State_Code")]
    train, test = _filled(*parts, numeric)
    flat = profile.low_spread_columns(train, [c for c in numeric if c != target])
    features = [c for c in numeric if c not in {target, *exclude, *flat}]
    if augment:
        train = learn.augment_extremes(train, target, time, key=key)
    train, test = [materialise(learn.health_labels(p, target, thresholds=list(cuts.values()))[0], name) for p, name in ((train, "train"), (test, "test"))]
    model = learn.train_forest(train, features, "Health_State_Code", trees, depth)
    top_model, top = learn.retrain_on_top(train, model, "Health_State_Code", trees=trees, depth=depth)
    parts = None
    for name, m in (("all", model), ("top", top_model)):
        for part, data in (("train", train), ("test", test)):
            scored = learn.classified(data, m)
            one = evaluate.classification_metrics(scored, "Health_State_Code", "prediction").withColumns(
                {"features": F.lit(name), "part": F.lit(part), **{k: F.lit(v) for k, v in cuts.items()}})
            parts = one if parts is None else parts.unionByName(one)
    return model, top_model, parts, top


def train_voltage(
    df: DataFrame, key: str, target: str, exclude: Sequence[str] = (), grid=learn.BOOSTED_GRID, parallelism: int = 4,
    fold_rows: int = learn.FOLD_ROWS,
) -> tuple[PipelineModel, DataFrame, float]:
    """(model, test metrics, cross-validated RMSE) of the boosted regression.

    Rows are split first; fill values, the choice of columns, bounds and scale
    come from the training part.
    """
    train, test = _filled(*balance.hash_split(df, key), numeric_columns(df, [key]))
    flat = profile.low_spread_columns(train, numeric_columns(train, [key, target]), 1e-6)
    features = sorted(c for c in numeric_columns(train, [key, target, *exclude]) if c not in flat)
    stage = learn.preparation_stage(train, features, bounds="iqr")
    assembler = VectorAssembler(inputCols=[f"x_{c}" for c in features], outputCol="features")
    dealt = balance.hash_folds(train, key, seed=7)
    whole = all(v == 1.0 for v in grid.get("subsamplingRate", [1.0]))
    folded = learn.fold_cells(dealt, stage, features, ["fold"], target, fold_rows) if whole else None
    if folded is None:
        shaped = assembler.transform(stage.transform(dealt)).select("features", target, "fold")
        search, rmse = learn.tune_boosted(materialise(shaped, "shaped"), target, "fold", grid, parallelism=parallelism)
    else:
        stage, cells = folded
        search, rmse = learn.tune_boosted(assembler.transform(cells), target, "fold", grid, parallelism=parallelism, weight="_n", within="_within")
    model = PipelineModel(stages=[stage, assembler, search.bestModel])
    return model, evaluate.regression_metrics(model.transform(test), target, "prediction"), rmse


def train_fault(
    df: DataFrame, key: str, label: str, k: int = 6, z_limit: float = 3.0, grid=learn.FOREST_GRID
) -> tuple[PipelineModel, DataFrame, list[str], float]:
    """(model, scored test rows, features, cross-validated balanced accuracy).

    The table is split by class first. Fill values, the choice of columns and the
    outlier limits come from the training part and are put to both; the training
    part is scaled, reduced to the k best features and balanced with synthetic
    rows before the search.
    """
    parts = [materialise(p, "fault_rows") for p in balance.stratified_split(df, key, label)]
    train, test = _filled(*parts, numeric_columns(df, [key, label]))
    features = profile.prune_features(train.drop(key), label)
    train, test = [p.select(key, label, *features) for p in (train, test)]
    test = clean.zscore_filter(test, features, z_limit, over=train)
    train = clean.require_trainable(materialise(clean.zscore_filter(train, features, z_limit), "train"), label)
    best = [r["feature"] for r in profile.select_k_best(train, features, label, k).collect()]
    shaper = Pipeline(stages=[
        learn.preparation_stage(train, best, bounds=None),
        VectorAssembler(inputCols=[f"x_{c}" for c in best], outputCol="features"),
    ]).fit(train)
    vectors = shaper.transform(train).select(key, label, vector_to_array("features").alias("x"))
    grown = balance.smote(vectors, key, "x", label)
    grown = grown.withColumn("_id", F.pmod(F.xxhash64(key, "x", "synthetic"), F.lit(2**40)))
    folded = balance.stratified_folds(grown, "_id", label)
    ready = folded.select(array_to_vector("x").alias("features"), label, "fold", F.lit(1.0).alias(learn.WEIGHT))
    search, score = learn.tune_forest(materialise(ready, "ready"), label, "fold", grid)
    model = PipelineModel(stages=[*shaper.stages, search.bestModel])
    return model, learn.score_fault(test, model), best, score


def evaluation_set(scored: DataFrame, label: str, predicted: str, score: str, positive: int = 1) -> dict[str, DataFrame]:
    """Every evaluation table of a scored table, which is pinned once."""
    kept = materialise(scored.select(label, predicted, score), "scored")
    hit = F.col(label) == positive
    return {
        "metrics": evaluate.classification_metrics(kept, label, predicted),
        "confusion": evaluate.confusion_counts(kept, label, predicted),
        "report": evaluate.classification_report(kept, label, predicted),
        "precision_recall": evaluate.precision_recall_curve(kept, score, hit),
        "roc": evaluate.roc_curve(kept, score, hit),
        "roc_auc": evaluate.roc_auc(kept, score, hit),
    }
