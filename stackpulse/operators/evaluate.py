"""Evaluation of classifiers and regressors from scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .ordered import running_totals, slices


def confusion_counts(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Long confusion table (label, predicted, n); at most classes^2 rows."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    """Rows are labels, columns ``pred_<class>`` hold counts."""
    wide = (
        df.groupBy(F.col(label).alias("label"))
        .agg(*[F.count_if(F.col(predicted) == F.lit(c)).alias(f"pred_{c}") for c in classes])
    )
    return wide


def class_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 on zero division."""
    counts = confusion_counts(df, label, predicted)
    cells = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"),
                 F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("c")).select("c.*")
    per = cells.groupBy("class").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    per = per.withColumns({
        "precision": F.coalesce(F.try_divide("hits", "claimed"), zero),
        "recall": F.coalesce(F.try_divide("hits", "support"), zero),
    })
    return per.withColumn("f1", F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def _weighted(name: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy and weighted precision, recall, F1.

    Balanced accuracy is the mean recall over classes that occur as labels.
    """
    return class_scores(df, label, predicted).agg(
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"),
        _weighted("f1").alias("f1"),
    )


def balanced_accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return classification_metrics(df, label, predicted).select("balanced_accuracy")


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per-class rows followed by the macro and the weighted mean."""
    per = class_scores(df, label, predicted)
    names = ["precision", "recall", "f1"]
    rows = per.select(F.col("class").cast("string").alias("class"), *names, "support")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), *[_weighted(n).alias(n) for n in names], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def _score_groups(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their positives and negatives."""
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def precision_recall_curve(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score, for rows that score
    at least the threshold, closed by the point precision 1, recall 0.

    Running counts go over range slices of the distinct scores, so no task
    sees all of them.
    """
    groups = _score_groups(df, score, positive, by).withColumn("_desc", -F.col("score"))
    totals = running_totals(slices(groups, ["_desc"], by), ["_desc"], {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    curve = totals.select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("_t_tp")), F.lit(1.0)).alias("recall"),
    )
    end = totals.select(*by).distinct() if by else df.sparkSession.range(1).select()
    end = end.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def one_vs_rest_curves(df: DataFrame, label: str, probabilities: str, classes: Sequence[int]) -> DataFrame:
    """Precision-recall curve of each class against the others."""
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.element_at(F.col(probabilities), i + 1).alias("p"),
                 (F.col(label) == c).alias("hit")) for i, c in enumerate(classes)
    ])).alias("r")).select("r.*")
    return precision_recall_curve(rows, "p", F.col("hit"), ["class"])


def roc_curve(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    groups = _score_groups(df, score, positive, by).withColumn("_desc", -F.col("score"))
    totals = running_totals(slices(groups, ["_desc"], by), ["_desc"], {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    return totals.select(
        *by, F.col("score").alias("threshold"),
        F.try_divide("tp", "_t_tp").alias("tpr"), F.try_divide("fp", "_t_fp").alias("fpr"))


def roc_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve as a rank sum; ties count one half."""
    groups = _score_groups(df, score, positive, by)
    below = running_totals(slices(groups, ["score"], by), ["score"], {"less": F.col("neg")}, by, inclusive=False)
    wins = F.sum(F.col("pos").cast("double") * (F.col("less") + F.col("neg") / 2.0))
    area = F.try_divide(wins, F.sum(F.col("pos").cast("double")) * F.sum("neg")).alias("roc_auc")
    return below.groupBy(*by).agg(area) if by else below.agg(area)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MAE and R2."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(a))).alias("r2"),
    )


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weight n / (classes * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(label, (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias(name))


# A table of classes up to this size may be broadcast.
MAX_CLASSES = 100_000


def join_classes(df: DataFrame, per_class: DataFrame, label: str) -> DataFrame:
    """Join a table of one row per class; it is broadcast once its size is
    checked, because a class may hold most rows. It is pinned, so that later
    passes do not count the classes anew."""
    per_class = materialise(per_class, "classes")
    few = per_class.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES
    return df.join(F.broadcast(per_class) if few else per_class, label)


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return join_classes(df, class_weights(df, label, name), label)


def feature_importance(names: Sequence[str], values: Sequence[float], spark) -> DataFrame:
    """(feature, importance), most important first."""
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
