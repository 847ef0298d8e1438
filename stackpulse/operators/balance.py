"""Splits, folds and synthetic minority oversampling (Chawla et al. 2002)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import id_hash, unit_hash
from ..session import materialise
from .evaluate import join_classes
from .neighbours import BLOCK_POINTS, nearest
from .ordered import ROW, TOTAL, index_rows


# Synthetic copies that one task makes of a row.
STRIP = 10_000


def hash_split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Random split that depends on the row's id alone."""
    bucket = F.pmod(id_hash(F.col(key), seed), F.lit(10_000))
    cut = int(round(fraction * 10_000))
    return df.filter(bucket < cut), df.filter(bucket >= cut)


def stratified_split(df: DataFrame, key: str, label: str, fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split that takes exactly floor(fraction * n) rows of each class.

    Rows are ordered by hash within the class over balanced slices, so a class
    that holds most rows is not ordered by one task.
    """
    ranked = index_rows(df.withColumn("_h", id_hash(F.col(key), seed)), ["_h", key], [label])
    cut = F.floor(F.col(TOTAL) * F.lit(fraction))
    strip = ["_h", ROW, TOTAL, "_slice"]
    return ranked.filter(F.col(ROW) < cut).drop(*strip), ranked.filter(F.col(ROW) >= cut).drop(*strip)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 2, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold numbers that deal each class out evenly."""
    ranked = index_rows(df.withColumn("_h", id_hash(F.col(key), seed)), ["_h", key], [label])
    return ranked.withColumn(name, F.pmod(F.col(ROW), F.lit(folds)).cast("int")).drop("_h", ROW, TOTAL, "_slice")


def hash_folds(df: DataFrame, key: str, folds: int = 2, seed: int = 42, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(id_hash(F.col(key), seed), F.lit(folds)).cast("int"))


def smote(
    df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42, block_points: int = BLOCK_POINTS
) -> DataFrame:
    """Original rows plus synthetic ones: (key, label, vector, synthetic).

    Every smaller class grows to the size of the largest. A synthetic point
    lies between a row and one of its k nearest rows of the same class; the
    needed copies are dealt out evenly over the rows. Classes of one row are
    left alone.
    """
    base = df.select(F.col(key), F.col(label), F.col(vector).cast("array<double>").alias(vector))
    # One row per class, numbered.
    sizes = base.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(F.lit(0))
    sizes = sizes.withColumns({
        "_need": F.max("_n").over(every) - F.col("_n"), "_no": F.row_number().over(every.orderBy(label)) - 1})
    small = join_classes(base, sizes.filter((F.col("_need") > 0) & (F.col("_n") > 1)), label)
    numbered = materialise(index_rows(small, [key], [label]).drop("_slice"), "minority")

    # One more coordinate puts the classes further apart than any two rows of
    # a class, so one search finds the neighbours within each class.
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    far = numbered.agg(F.coalesce(F.max(norm), F.lit(0.0)) * 2 + 1)
    apart = numbered.withColumn("_x", F.concat(vector, F.array(F.col("_no") * far.scalar())))
    lists = nearest(apart, key, "_x", k + 1, block_points).filter(F.col("neighbour") != F.col(key))
    classes = numbered.select(F.col(key).alias("neighbour"), F.col(label).alias("_theirs"))
    lists = lists.join(classes, "neighbour").join(numbered.select(key, label), key).filter(F.col(label) == F.col("_theirs"))
    lists = lists.groupBy(key).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), 1, k)["neighbour"].alias("_near"))

    copies = F.floor(F.col("_need") / F.col("_n")) + F.when(F.col(ROW) < F.col("_need") % F.col("_n"), 1).otherwise(0)
    # Copies are dealt out in strips first, so no task makes all of one row's.
    strips = numbered.withColumn("_all", copies).filter(F.col("_all") > 0).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_all") - 1, F.lit(STRIP).cast("bigint"))).alias("_first"))
    made = strips.repartition(key, "_first").withColumn(
        "_c", F.explode(F.sequence(F.col("_first") + 1, F.least(F.col("_all"), F.col("_first") + STRIP)))).join(lists, key)
    draw = F.pmod(F.xxhash64(key, "_c"), F.lit(2**40))
    made = made.withColumns({
        "_pick": F.element_at("_near", (F.pmod(id_hash(draw, seed), F.size("_near")) + 1).cast("int")),
        "_u": unit_hash(draw, seed + 1),
    })
    other = numbered.select(F.col(key).alias("_pick"), F.col(vector).alias("_y"))
    made = made.join(other, "_pick").withColumn(vector, F.zip_with(
        vector, "_y", lambda x, y: x + (y - x) * F.col("_u")))
    synthetic = made.select(key, label, vector, F.lit(True).alias("synthetic"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(synthetic)
