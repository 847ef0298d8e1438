"""Training, tuning and scoring with Spark ML.

A model is one pipeline: a SQL stage that holds the training statistics as
numbers (fill, bounds, scale), an assembler and the learner. Saving the
pipeline saves the statistics with it, and scoring uses them instead of those
of the batch at hand.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalars import HEALTH_LABELS, argmax_code, confidence, fault_label, left_closed_bins, map_codes, uniform
from ..schema import with_missing_as_zero
from ..session import materialise, scratch_path, spread
from .clean import iqr_bounds, quantile_bounds, sample_rows
from .evaluate import feature_importance, with_class_weight
from .folded import FoldedRows, bins_of, coded_cells, cut_back, decoded, depths, fold_rows as held_cells, held_trees, kind_of
from .quantiles import quantiles

WEIGHT = "_weight"
# Trees see features in at most this many bins, Spark's own default.
BINS = 32
# Larger tables are folded to one row per occupied cell of bins, if that leaves
# at most this share of the rows. Forests of tables above ``FOREST_FOLD_ROWS``
# are grown a tree a task, whatever the share, if a task can hold the cells.
# With more cells than that a folded forest costs a fit a tree, so it takes more
# rows to pay; that limit, ``FITTED_FOLD_ROWS``, is an estimate, not measured.
FOLD_ROWS, FOREST_FOLD_ROWS, FITTED_FOLD_ROWS, FOLD_SHARE = 1 << 20, 1 << 17, 1 << 23, 0.125
# Tables above this many rows are scored through a table of all cells between the
# cuts of a forest, if there are at most so many cells.
LOOKUP_ROWS, LOOKUP_CELLS = 1 << 17, 1 << 18
# Nodes that the driver grows at once in a forest search, and holds to score
# them; a single tree may have more.
GROWN_NODES, SCORED_NODES = 1 << 20, 1 << 21


def health_labels(df: DataFrame, target: str, critical: float = 0.05, degraded: float = 0.5, thresholds: Sequence[float] | None = None, **options) -> tuple[DataFrame, dict[str, float]]:
    """Add the health code and label cut at two quantiles of the target."""
    lo, mid = thresholds or quantiles(df, {target: [critical, degraded]}, **options)[target]
    out = df.withColumn("Health_State_Code", left_closed_bins(F.col(target), [lo, mid]))
    out = out.withColumn("Health_State", map_codes(F.col("Health_State_Code"), HEALTH_LABELS))
    return out, {"critical_threshold": lo, "degraded_threshold": mid}


def augment_extremes(
    df: DataFrame, target: str, time: str, fraction: float = 0.05, seed: int = 42, key: str | None = None
) -> DataFrame:
    """Add sampled copies with very low (2 to 3) and very high (5 to 10)
    targets, moved 100 forward and 50 back in time."""
    low = sample_rows(df, fraction, seed, key).withColumns({target: uniform(2.0, 3.0, seed), time: F.col(time) + 100})
    high = sample_rows(df, fraction, seed + 1, key).withColumns({target: uniform(5.0, 10.0, seed + 1), time: F.col(time) - 50})
    types = {f.name: f.dataType for f in df.schema.fields}
    cast = lambda part: part.withColumns({target: F.col(target).cast(types[target]), time: F.col(time).cast(types[time])})
    return df.unionByName(cast(low)).unionByName(cast(high))


def preparation_stage(df: DataFrame, features: Sequence[str], bounds: str | None = "quantile", scale: bool = True, **options) -> SQLTransformer:
    """Fit fill value, bounds and population scale on ``df``; the stage adds
    ``x_<feature>`` columns."""
    clip: Mapping[str, tuple[float, float]] = {}
    if bounds == "quantile":
        clip = quantile_bounds(df, features, **options)
    elif bounds == "iqr":
        clip = iqr_bounds(df, features, **options)
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
    shaped = {}
    for i, c in enumerate(features):
        value = f"coalesce(CAST(`{c}` AS DOUBLE), {float(means[f'm{i}'] or 0.0)!r}D)"
        if clip and clip[c][0] is not None:
            value = f"least(greatest({value}, {float(clip[c][0])!r}D), {float(clip[c][1])!r}D)"
        shaped[c] = value
    if scale:
        row = df.agg(*[e for i, c in enumerate(features) for e in (
            F.expr(f"avg({shaped[c]})").alias(f"m{i}"), F.expr(f"stddev_pop({shaped[c]})").alias(f"s{i}"))]).first()
        for i, c in enumerate(features):
            shaped[c] = f"({shaped[c]} - {float(row[f'm{i}'] or 0.0)!r}D) / {float(row[f's{i}'] or 1.0)!r}D"
    picks = ", ".join(f"{v} AS `x_{c}`" for c, v in shaped.items())
    return SQLTransformer(statement=f"SELECT *, {picks} FROM __THIS__")


def _fit(df: DataFrame, features: Sequence[str], learner, **preparation) -> PipelineModel:
    stages = [
        preparation_stage(df, features, **preparation),
        VectorAssembler(inputCols=[f"x_{c}" for c in features], outputCol="features"),
        learner,
    ]
    return Pipeline(stages=stages).fit(spread(df))


def bin_cuts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Upper ends of all bins but the last: every value of a column of few
    values, else quantiles of all rows."""
    few = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    short = [c for c in columns if few[c] <= 2 * BINS]
    cuts = {}
    if short:
        # The counts are off by a few hundredths, so the sets are small.
        found = df.agg(*[F.collect_set(F.when(~F.isnan(c), F.col(c))).alias(c) for c in short]).first()
        cuts = {c: sorted(found[c])[:-1] for c in short if len(found[c]) <= BINS}
    many = [c for c in columns if c not in cuts]
    if many:
        found = df.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.001)
        cuts.update((c, sorted(set(q))) for c, q in zip(many, found))
    return cuts


def fold_cells(
    df: DataFrame, stage: SQLTransformer, features: Sequence[str], by: Sequence[str] = (), target: str | None = None, fold_rows: int = FOLD_ROWS
) -> tuple[SQLTransformer, DataFrame] | None:
    """(stage with bin numbers as ``x_<feature>``, cells), or None where folding
    does not pay.

    Trees only compare bins, so rows of one cell, alike in all bins and in
    ``by``, count as one row of weight ``_n``. With a target a cell holds its mean
    and ``_within``, the sum of squares around it; splits and leaves need no more.
    """
    names = [f"x_{c}" for c in features]
    if df.count() <= fold_rows:
        return None
    cuts = bin_cuts(stage.transform(df).select(*names), names)
    ends = {c: ", ".join(f"{float(v)!r}D" for v in cuts[c]) for c in names}
    bins = [f"CAST(size(filter(array({ends[c]}), t -> t < `{c}`)) AS DOUBLE) AS `{c}`" if ends[c] else f"0D AS `{c}`" for c in names]
    drop = ", ".join(f"`{c}`" for c in names)
    binned = SQLTransformer(statement=f"SELECT * EXCEPT ({drop}), {', '.join(bins)} FROM ({stage.getStatement()})")
    keys = [*names, *by]
    rows = binned.transform(df).select(*keys, *([target] if target else []))
    known = F.count(target) if target else F.count(F.lit(1))
    size = rows.agg(F.count(F.lit(1)).alias("n"), known.alias("known"), F.approx_count_distinct(F.struct(*keys)).alias("cells")).first()
    if size["known"] < size["n"] or size["cells"] > FOLD_SHARE * size["n"]:
        return None
    values = [F.avg(target).alias(target), (F.var_pop(target) * F.count(F.lit(1))).alias("_within")] if target else []
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), *values)
    return binned, materialise(cells.sortWithinPartitions(*keys), "cells")


def folded_columns(rows: DataFrame, names: Sequence[str], label: str) -> FoldedRows | None:
    """Cells of a table with columns ``names``, a label and ``WEIGHT``."""
    cuts = bin_cuts(rows.select(*names), names)
    return held_cells(rows, names, [cuts[c] for c in names], label, WEIGHT)


def as_columns(rows: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
    """(rows with the elements of features as columns, their names)."""
    names = [f"_x{i}" for i in range(size)]
    values = rows.withColumn("_x", vector_to_array("features"))
    return values.select("*", *[F.col("_x")[i].alias(c) for i, c in enumerate(names)]).drop("_x", "features"), names


def _with_draws(cells: DataFrame, trees: int, seed: int) -> DataFrame:
    """Adds ``_d<t>``: how many rows of a cell the bootstrap of tree t draws. A
    row is drawn Poisson(1) times, so a cell of n rows Poisson(n) times. The seed
    of a batch comes from its cells."""
    draws = [f"_d{t}" for t in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = 0
            for column in batch.columns:
                mark = zlib.crc32(column.to_numpy(zero_copy_only=False).tobytes(), mark)
            rng = np.random.default_rng([seed, mark])
            n = batch.column("_n").to_numpy()
            drawn = [pa.array(rng.poisson(n).astype(np.int32)) for _ in draws]
            yield pa.RecordBatch.from_arrays([*batch.columns, *drawn], names=[*batch.schema.names, *draws])

    schema = T.StructType([*cells.schema.fields, *[T.StructField(d, T.IntegerType()) for d in draws]])
    return materialise(cells.mapInArrow(run, schema), "draws")


def _forest_of_cells(cells: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int = 42, parallelism: int = 4) -> RandomForestClassificationModel:
    """Random forest from folded rows. Spark's own bootstrap would draw a cell as
    a whole, so each tree is fitted alone on the draws of its rows."""
    spark = cells.sparkSession
    drawn = _with_draws(cells, trees, seed).persist()
    classes = int(cells.agg(F.max(label)).first()[0]) + 1
    nominal = {"ml_attr": {"type": "nominal", "num_vals": max(2, classes)}}
    assembler = VectorAssembler(inputCols=[f"x_{c}" for c in features], outputCol="features")
    each = features_per_node("sqrt", len(features)) if trees > 1 else len(features)

    def grow(t: int):
        rows = drawn.filter(F.col(f"_d{t}") > 0).withColumn(WEIGHT, F.col(WEIGHT) * F.col(f"_d{t}"))
        rows = assembler.transform(rows).select("features", F.col(label).alias(label, metadata=nominal), WEIGHT)
        learner = random_forest(label, 1, depth, seed + t, bootstrap=False, featureSubsetStrategy=str(each) if each < len(features) else "all")
        return learner.fit(rows).trees[0]

    with ThreadPool(max(1, parallelism)) as pool:
        grown = pool.map(inheritable_thread_target(spark)(grow), range(trees), chunksize=1)
    drawn.unpersist()
    return forest_of(grown, len(features), max(2, classes))


def forest_of(trees: Sequence, features: int, classes: int) -> RandomForestClassificationModel:
    """Forest model of single trees."""
    context = SparkContext._active_spark_context
    kind = context._jvm.org.apache.spark.ml.classification
    one = context._gateway.new_array(kind.DecisionTreeClassificationModel, len(trees))
    for t, tree in enumerate(trees):
        one[t] = tree._java_obj
    model = kind.RandomForestClassificationModel(one, features, classes)
    model.set(model.numTrees(), len(trees))  # its default stands otherwise, and goes into saved models
    return RandomForestClassificationModel(model)


def random_forest(label: str, trees: int = 100, depth: int = 10, seed: int = 42, **params: Any) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol=WEIGHT, numTrees=trees, maxDepth=depth, seed=seed, **params)


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10, fold_rows: int = FOREST_FOLD_ROWS, **preparation) -> PipelineModel:
    """Random forest with balanced class weights. Large tables are folded to
    cells of bins first."""
    weighted = with_class_weight(df, label, WEIGHT)
    stage = preparation_stage(weighted, features, **preparation)
    assembler = VectorAssembler(inputCols=[f"x_{c}" for c in features], outputCol="features")
    large = weighted.count() > fold_rows
    held = folded_columns(stage.transform(weighted), [f"x_{c}" for c in features], label) if large else None
    if held is not None:
        grown = held.trees(trees, depth, 1, features_per_node("sqrt", len(features)) if trees > 1 else len(features), 42)
        return PipelineModel(stages=[stage, assembler, held.model(grown, label, maxDepth=depth, weightCol=WEIGHT, seed=42)])
    folded = fold_cells(weighted, stage, features, [label, WEIGHT], fold_rows=max(fold_rows, FITTED_FOLD_ROWS)) if large else None
    if folded is None:
        return Pipeline(stages=[stage, assembler, random_forest(label, trees, depth)]).fit(spread(weighted))
    forest = _forest_of_cells(folded[1], features, label, trees, depth)
    return PipelineModel(stages=[folded[0], assembler, forest.setFeaturesCol("features")])


def train_logistic(df: DataFrame, features: Sequence[str], label: str, iterations: int = 100, **preparation) -> PipelineModel:
    return _fit(df, features, LogisticRegression(labelCol=label, featuresCol="features", maxIter=iterations), **preparation)


def boosted_trees(
    label: str, n_estimators: int = 100, max_depth: int = 7, learning_rate: float = 0.1, subsample: float = 1.0,
    colsample: float = 1.0, gamma: float = 0.0, seed: int = 42,
) -> GBTRegressor:
    return GBTRegressor(
        labelCol=label, featuresCol="features", maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate,
        subsamplingRate=subsample, featureSubsetStrategy="all" if colsample >= 1.0 else str(colsample), minInfoGain=gamma, seed=seed)


def train_boosted(df: DataFrame, features: Sequence[str], label: str, bounds: str = "iqr", fold_rows: int = FOLD_ROWS, **params: Any) -> PipelineModel:
    """Boosted regression. Large tables are folded to cells of bins first, where
    that leaves far fewer rows; rounds that draw rows need the rows."""
    features, learner = sorted(features), boosted_trees(label, **params)
    stage = preparation_stage(df, features, bounds=bounds)
    folded = fold_cells(df, stage, features, target=label, fold_rows=fold_rows) if learner.getSubsamplingRate() == 1.0 else None
    assembler = VectorAssembler(inputCols=[f"x_{c}" for c in features], outputCol="features")
    if folded is None:
        return Pipeline(stages=[stage, assembler, learner]).fit(spread(df))
    rows = spread(assembler.transform(folded[1]))
    return PipelineModel(stages=[folded[0], assembler, learner.setWeightCol("_n").fit(rows)])


def importances(model: PipelineModel, spark) -> DataFrame:
    """(feature, importance) of a fitted tree pipeline, most important first."""
    names = [c.removeprefix("x_") for c in model.stages[1].getInputCols()]
    return feature_importance(names, model.stages[-1].featureImportances.toArray(), spark)


def important_features(table: DataFrame, limit: float = 0.05) -> list[str]:
    return [r["feature"] for r in table.filter(F.col("importance") > limit).orderBy(F.desc("importance"), "feature").collect()]


def retrain_on_top(df: DataFrame, model: PipelineModel, label: str, limit: float = 0.05, trees: int = 100, depth: int = 10, **preparation) -> tuple[PipelineModel, list[str]]:
    """Second forest on the important features only; each pipeline keeps its
    own scale. Without any important feature the first model stays."""
    top = important_features(importances(model, df.sparkSession), limit)
    if not top:
        return model, [c.removeprefix("x_") for c in model.stages[1].getInputCols()]
    return train_forest(df, top, label, trees, depth, **preparation), top


# Search grids of the two tuned models.
BOOSTED_GRID = {"maxIter": [50, 100], "maxDepth": [5, 7], "stepSize": [0.1], "subsamplingRate": [1.0], "minInfoGain": [0.0]}
FOREST_GRID = {"numTrees": [10, 20], "maxDepth": [10, 20], "minInstancesPerNode": [2], "featureSubsetStrategy": ["sqrt", "log2"]}


@dataclass
class GridSearch:
    """Grid points in the grid's order with their mean scores, and the model
    fitted on all rows with the best of them."""

    points: list[dict[str, Any]]
    scores: list[float]
    bestModel: PipelineModel | RandomForestClassificationModel | GBTRegressionModel


def tune_boosted(df: DataFrame, label: str, fold: str, grid: Mapping[str, Sequence] = BOOSTED_GRID, folds: int = 2, parallelism: int = 4, weight: str | None = None, within: str | None = None) -> tuple[GridSearch, float]:
    """Grid search by mean squared error; also the root of the best mean. Rows
    may be folded ones of a ``weight``, with the squares ``within`` them.

    Rounds of boosting build on each other, so for each fold and choice of the
    other parameters one model is fitted, with the most rounds of the grid, and
    its error after fewer rounds is that of the smaller grid points. Up to
    ``parallelism`` models are fitted at once. Ties go to the first point.
    """
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    learner = boosted_trees(label)
    usual = learner.getMaxIter()
    alike: dict[tuple, list[int]] = {}
    for i, point in enumerate(points):
        alike.setdefault(tuple((k, v) for k, v in point.items() if k != "maxIter"), []).append(i)
    if weight:
        learner.setWeightCol(weight)
    kept = ["features", label, *[c for c in (weight, within) if c]]
    parts = [[spread(materialise(df.filter(test).select(*kept), "boosted-rows")) for test in (F.col(fold) != turn, F.col(fold) == turn)]
             for turn in range(folds)]
    spare = [float(test.agg(F.sum(within) / F.sum(weight)).first()[0]) if within else 0.0 for _, test in parts]

    def errors(job: tuple) -> list[tuple[int, float]]:
        ((train, test), extra), (rest, members) = job
        rounds = [points[i].get("maxIter", usual) for i in members]
        model = learner.copy({learner.getParam(k): v for k, v in (*rest, ("maxIter", max(rounds)))}).fit(train)
        after = model.evaluateEachIteration(test, "squared")
        return [(i, after[min(n, len(after)) - 1] + extra) for i, n in zip(members, rounds)]

    scores = np.zeros(len(points))
    with ThreadPool(max(1, parallelism)) as pool:
        for found in pool.map(inheritable_thread_target(df.sparkSession)(errors), list(itertools.product(zip(parts, spare), alike.items()))):
            for i, error in found:
                scores[i] += error / folds
    best = points[int(scores.argmin())]
    model = learner.copy({learner.getParam(k): v for k, v in best.items()}).fit(spread(df))
    return GridSearch(points, scores.tolist(), model), float(scores.min()) ** 0.5


def features_per_node(strategy: str, n: int) -> int:
    """What Spark's forests make of a feature subset strategy."""
    if strategy in ("sqrt", "auto"):
        return max(1, math.ceil(math.sqrt(n)))
    if strategy == "log2":
        return max(1, math.ceil(math.log2(n)))
    if strategy == "onethird":
        return max(1, math.ceil(n / 3))
    if strategy.isdigit():
        return min(int(strategy), n)
    return n if strategy == "all" else max(1, math.ceil(float(strategy) * n))


def _search_forest(label: str, trees: int, depth: int, **params: Any) -> RandomForestClassifier:
    """Rows keep the number of the node they are in, which is checkpointed in
    the shared folder, so deep levels do not send the trees again; statistics of
    all nodes of a level fit in memory at once."""
    return random_forest(label, trees, depth, cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024, **params)


def saved_nodes(model: RandomForestClassificationModel, spark) -> list[dict[str, np.ndarray]]:
    """Per tree: feature, cut, children (-1 at a leaf), class counts and depth of
    its nodes, the root first. They are read from the model's files; their number
    is bounded by the trees and their depth, not by the rows."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    split = F.col("nodeData.split")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        split["featureIndex"].alias("feature"), F.coalesce(F.get(split["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("cut"),
        F.col("nodeData.impurityStats").alias("stats")).toArrow()
    stats = rows.column("stats").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    column = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "stats"}
    order = np.lexsort((column["id"], column["treeID"]))
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(column["treeID"][order])) + 1):
        tree = {c: column[c][at].astype(np.int32) for c in ("left", "right", "feature")} | {"cut": column["cut"][at], "stats": stats[at]}
        out.append(tree | {"depth": depths(tree)})
    return out


def added_votes(x: np.ndarray, tree: dict[str, np.ndarray], leaf: np.ndarray) -> np.ndarray:
    """Class shares of the leaves that the rows reach."""
    at = np.zeros(len(x), np.int64)
    while True:
        go = np.flatnonzero(~leaf[at])
        if not len(go):
            break
        node = at[go]
        at[go] = np.where(x[go, tree["feature"][node]] <= tree["cut"][node], tree["left"][node], tree["right"][node])
    stats = tree["stats"][at]
    return stats / stats.sum(axis=1, keepdims=True)


def staged_votes(x: np.ndarray, forest: list[dict[str, np.ndarray]], trees: int, leaves: list[np.ndarray]) -> np.ndarray:
    """Class of each row by the first ``trees`` trees with the given leaves."""
    return sum(added_votes(x, tree, leaf) for tree, leaf in zip(forest[:trees], leaves)).argmax(axis=1)


def grown_forests(learner: RandomForestClassifier, rows: DataFrame, count: int, dim: int) -> Iterator[RandomForestClassificationModel]:
    """A forest in parts of about ``GROWN_NODES`` nodes, or of one tree. A forest
    that cannot have more comes whole. Each part draws from its own seed."""
    trees, depth, least = (learner.getOrDefault(p) for p in ("numTrees", "maxDepth", "minInstancesPerNode"))
    most, done = min(2 ** (depth + 1), 2 * max(1, count // least)), 0
    if trees * most <= GROWN_NODES:
        yield learner.fit(rows)
        return
    each = features_per_node(learner.getFeatureSubsetStrategy(), dim)
    fixed = learner.copy({learner.featureSubsetStrategy: str(each) if each < dim else "all"})
    while done < trees:
        some = min(trees - done, max(1, GROWN_NODES // most))
        part = fixed.copy({fixed.numTrees: some, fixed.seed: learner.getSeed() + 7919 * done}).fit(rows)
        done, most = done + some, max(tree.numNodes for tree in part.trees)
        yield part


def _held_together(parts: Iterator[RandomForestClassificationModel | list[dict[str, np.ndarray]]], spark) -> Iterator[list[dict[str, np.ndarray]]]:
    """Nodes of consecutive trees, about ``SCORED_NODES`` at once."""
    held: list[dict[str, np.ndarray]] = []
    for part in parts:
        trees = part if isinstance(part, list) else saved_nodes(part, spark)
        if held and sum(len(t["left"]) for t in held + trees) > SCORED_NODES:
            yield held
            held = []
        held = held + trees
    yield held


def _stage_scores(parts: Iterator[RandomForestClassificationModel | list[dict[str, np.ndarray]]], test: DataFrame, label: str, stages: Sequence[tuple[int, int]], weight: str | None = None) -> list[float]:
    """Balanced accuracy of each (trees, depth) stage of a forest that comes in
    parts. The votes of a row so far go with it from part to part. A test row
    may stand for ``weight`` rows."""
    spark, done, last = test.sparkSession, 0, max(t for t, _ in stages)
    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    voted = test.select(F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x"), F.array().cast("array<double>").alias("votes"), n.alias("n"))
    for forest in _held_together(parts, spark):
        leaves = {d: [cut_back(t, d) for t in forest] for d in {d for _, d in stages}}
        shared = spark.sparkContext.broadcast((forest, leaves, done))  # bounded by ``SCORED_NODES`` or one tree

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            nodes, ends, before = shared.value
            classes = nodes[0]["stats"].shape[1]
            for batch in batches:
                if len(batch):
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                    votes = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                    votes = votes.reshape(len(x), len(stages), classes).copy() if len(votes) else np.zeros((len(x), len(stages), classes))
                    for d, leaf in ends.items():
                        for t, tree in enumerate(nodes, before):
                            wanted = [i for i, stage in enumerate(stages) if stage[1] == d and stage[0] > t]
                            if wanted:
                                votes[:, wanted] += added_votes(x, tree, leaf[t - before])[:, None]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(stages) * classes), pa.array(votes.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, batch.column(3)], names=["y", "x", "votes", "n"])

        voted, done = voted.mapInArrow(run, "y double, x array<double>, votes array<double>, n double"), done + len(forest)
        if done < last:
            voted = materialise(voted, "votes")
    classes = F.size("votes") / len(stages)
    own = [F.slice("votes", (classes * i + 1).cast("int"), classes.cast("int")) for i in range(len(stages))]
    hit = [(F.array_position(v, F.array_max(v)) - 1 == F.col("y")).cast("double") for v in own]
    recalls = voted.groupBy("y").agg(*[(F.sum(h * F.col("n")) / F.sum("n")).alias(f"r{i}") for i, h in enumerate(hit)])
    row = recalls.agg(*[F.avg(f"r{i}") for i in range(len(stages))]).first()
    return [float(v) for v in row]


def folded_trees(held: FoldedRows, learner: RandomForestClassifier) -> DataFrame:
    """Trees as the learner would have them."""
    trees, strategy = learner.getNumTrees(), learner.getFeatureSubsetStrategy()
    each = features_per_node("all" if strategy == "auto" and trees == 1 else strategy, len(held.cuts))
    return held.trees(trees, learner.getMaxDepth(), learner.getMinInstancesPerNode(), each, learner.getSeed())


def folded_test(test: DataFrame, held: FoldedRows, size: int, label: str) -> DataFrame:
    """Cells of test rows in the bins of the training rows: features (numbers of
    bins), label and ``_n``. Trees see no more of a row than that."""
    rows, names = as_columns(test, size)
    labels = sorted(r[0] for r in rows.select(label).distinct().collect())
    cells = coded_cells(rows, names, held.cuts, kind_of([(v,) for v in labels], [label]), len(labels))
    sizes = held.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, kind = decoded(batch.column(0).to_numpy(), sizes, len(labels))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kind) + 1, dtype=np.int32) * size), pa.array(bins.T.astype(float).ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(np.asarray(labels, float)[kind]), batch.column(1)], names=["x", "y", "n"])

    spelled = cells.mapInArrow(run, "x array<double>, y double, n long")
    return spread(materialise(spelled.select(array_to_vector("x").alias("features"), F.col("y").alias(label), F.col("n").alias("_n")), "test-cells"))


def tune_forest(
    df: DataFrame, label: str, fold: str, grid: Mapping[str, Sequence] = FOREST_GRID, folds: int = 2, prepare: Callable[[DataFrame], PipelineModel] | None = None,
    weighted: bool = False, fold_rows: float = FOREST_FOLD_ROWS,
) -> tuple[GridSearch, float]:
    """Grid search by balanced accuracy over stratified folds.

    ``prepare`` is fitted on the training rows of each fold, and at last on all
    rows; without it ``df`` has a column features. ``weighted`` makes class
    weights from the same rows. For each fold, number of features per node and
    choice of the other parameters one forest is fitted, as large and deep as the grid
    goes. Its first trees, cut back, stand for the smaller grid points: a tree
    cut back equals the tree grown to that depth, as both draw the same features
    in the same order. Strategies that come to the same number of features per
    node are the same forest. A forest of many nodes is grown and scored in
    parts, so the driver holds a bounded number of nodes or one tree. The forest
    with the best point, which has to be held, is then fitted on
    all rows. Ties go to the first point of the grid. Above ``fold_rows`` rows
    both sides of a fold are folded to cells of the bins of its training rows.
    """
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    full = [{"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "auto", **p} for p in points]
    staged = ("numTrees", "maxDepth", "featureSubsetStrategy")
    if not all(set(p) <= {*staged, "minInstancesPerNode"} for p in full):
        fold_rows = math.inf  # folded rows are grown with these parameters only
    scores = np.zeros(len(points))

    def ready(rows: DataFrame) -> tuple[PipelineModel | None, DataFrame]:
        shaper = prepare(rows) if prepare else None
        shaped = shaper.transform(rows) if shaper else rows
        shaped = with_class_weight(shaped, label, WEIGHT) if weighted else shaped
        return shaper, spread(materialise(shaped.select("features", label, WEIGHT), "search-rows"))

    for turn in range(folds):
        shaper, train = ready(df.filter(F.col(fold) != turn))
        test = df.filter(F.col(fold) == turn)
        test = materialise((shaper.transform(test) if shaper else test).select("features", label), "search-test")
        n, count = len(train.first()["features"]), train.count()
        held = folded_columns(*as_columns(train, n), label) if count > fold_rows else None
        if held is not None:
            test = folded_test(test, held, n, label)
        alike: dict[tuple, list[int]] = {}
        for i, point in enumerate(full):
            rest = tuple(sorted((k, v) for k, v in point.items() if k not in staged))
            alike.setdefault((rest, features_per_node(point["featureSubsetStrategy"], n)), []).append(i)
        for (rest, each), members in alike.items():
            stages = [(full[i]["numTrees"], full[i]["maxDepth"]) for i in members]
            learner = _search_forest(label, max(t for t, _ in stages), max(d for _, d in stages), featureSubsetStrategy=str(each) if each < n else "all", **dict(rest))
            parts = grown_forests(learner, train, count, n) if held is None else held_trees(folded_trees(held, learner), held.classes)
            for i, value in zip(members, _stage_scores(parts, test, label, stages, None if held is None else "_n")):
                scores[i] += value / folds
    best = dict(full[int(scores.argmax())])
    shaper, rows = ready(df)
    learner, count = _search_forest(label, best.pop("numTrees"), best.pop("maxDepth"), **best), rows.count()
    held = folded_columns(*as_columns(rows, n), label) if count > fold_rows else None
    if held is not None:
        model = held.model(folded_trees(held, learner), label, maxDepth=learner.getMaxDepth(), minInstancesPerNode=learner.getMinInstancesPerNode(), weightCol=WEIGHT)
    else:
        parts = list(grown_forests(learner, rows, count, n))
        model = parts[0] if len(parts) == 1 else forest_of([t for p in parts for t in p.trees], n, parts[0].numClasses).setFeaturesCol("features")
    return GridSearch(points, scores.tolist(), PipelineModel(stages=[*shaper.stages, model]) if shaper else model), float(scores.max())


def search_table(search: GridSearch, spark) -> DataFrame:
    """One row per grid point with its parameters and mean score."""
    return spark.createDataFrame([(str(dict(sorted(p.items()))), s) for p, s in zip(search.points, search.scores)], "params string, score double")


def classified(df: DataFrame, model: PipelineModel, rows: int = LOOKUP_ROWS) -> DataFrame:
    """``model.transform(df)``. A forest says the same of all values between two
    neighbouring cuts, so for a large table it is asked once for each cell of
    cuts, and rows look up the answer of their cell."""
    forest = model.stages[-1]
    if df.isStreaming or not isinstance(forest, RandomForestClassificationModel) or df.count() <= rows:
        return model.transform(df)
    spark, names = df.sparkSession, model.stages[1].getInputCols()
    found: list[set] = [set() for _ in names]
    for tree in saved_nodes(forest, spark):
        inner = tree["left"] >= 0
        for f in np.unique(tree["feature"][inner]):
            found[f].update(tree["cut"][inner & (tree["feature"] == f)].tolist())
    cuts = [sorted(c) for c in found]
    sizes = [len(c) + 1 for c in cuts]
    if math.prod(sizes) > LOOKUP_CELLS:
        return model.transform(df)
    # A cell ends on its upper cut; the last one is open.
    ends = [np.array([*c, np.nextafter(c[-1], np.inf) if c else 0.0]) for c in cuts]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _ = decoded(batch.column(0).to_numpy(), sizes, 1)
            x = np.stack([e[b] for e, b in zip(ends, bins)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(ends)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_cell", "x"])

    cells = spark.range(math.prod(sizes)).repartition(spark.sparkContext.defaultParallelism).mapInArrow(spelled, "_cell long, x array<double>")
    said = [forest.getRawPredictionCol(), forest.getProbabilityCol(), forest.getPredictionCol()]
    asked = cells.select("_cell", array_to_vector("x").alias(forest.getFeaturesCol()))
    answers = materialise(forest.transform(asked).select("_cell", *said), "answers")  # ``LOOKUP_CELLS`` rows

    @F.pandas_udf("long")
    def cell(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            code = np.zeros(len(columns[0]), np.int64)
            for column, c in zip(columns, cuts):
                x = column.to_numpy(float)
                if np.isnan(x).any():
                    raise ValueError("features hold missing values")
                code = code * (len(c) + 1) + bins_of(x, c)
            yield pd.Series(code)

    shaped = model.stages[0].transform(df)
    for stage in model.stages[1:-1]:
        shaped = stage.transform(shaped)
    return shaped.withColumn("_cell", cell(*names)).join(F.broadcast(answers), "_cell").drop("_cell")


def score(df: DataFrame, model: PipelineModel, keep: Sequence[str] | None = None) -> DataFrame:
    """Apply a stored pipeline; absent features count as 0. Works on batches
    and on streams."""
    features = [c.removeprefix("x_") for c in model.stages[1].getInputCols()]
    names = list(keep or df.columns)
    out = classified(with_missing_as_zero(df, features), model)
    extra = [c for c in ("prediction", "probability") if c in out.columns]
    return out.select(*names, *extra)


def score_health(df: DataFrame, model: PipelineModel) -> DataFrame:
    out = score(df, model).withColumn("Health_State_Predicted", F.col("prediction").cast("int"))
    out = out.withColumn("Health_State_Label", map_codes(F.col("Health_State_Predicted"), HEALTH_LABELS))
    return out.drop("prediction", "probability")


def score_fault(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Class, label (0 is Normal) and confidence of the predicted class."""
    p = vector_to_array("probability")
    out = score(df, model).withColumn("_p", p).withColumn("predicted_class", argmax_code(F.col("_p")))
    return out.withColumns({
        "prediction_label": fault_label(F.col("predicted_class")),
        "confidence": confidence(F.col("_p"), F.col("predicted_class")),
    }).drop("_p", "prediction", "probability")


def score_voltage(df: DataFrame, model: PipelineModel, name: str = "Utot_Predicted") -> DataFrame:
    return score(df, model).withColumnRenamed("prediction", name)
