"""Column profiles, correlation and feature selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import numeric_columns
from .quantiles import quantiles


def _long(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def spread_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, min, max, std, variance, constant flag.

    ``min = max`` on the non-null values decides constancy, which needs no
    distinct count.
    """
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"),
            F.coalesce(F.min(v) == F.max(v), F.lit(False)).alias("is_constant"),
        ).alias(f"p{i}"))
    one = df.agg(*aggs)
    return _long(one, [F.col(f"p{i}") for i in range(len(columns))])


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [r["column"] for r in spread_profile(df, columns).filter("is_constant").collect()]


def low_spread_columns(df: DataFrame, columns: Sequence[str], min_std: float = 0.01) -> list[str]:
    return [r["column"] for r in spread_profile(df, columns).filter(F.col("std") < min_std).collect()]


def low_variance_columns(df: DataFrame, columns: Sequence[str], min_var: float = 0.01) -> list[str]:
    return [r["column"] for r in spread_profile(df, columns).filter(F.col("var") < min_var).collect()]


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long correlation table (a_pos, a, b_pos, b, r) of the upper triangle.

    One scan: each partition sums the outer products of its rows, and the sums of
    a pair meet in one place. A pair uses the rows that have both values; it is
    NaN where one of these is not finite, and null where a side is constant or
    fewer than two rows have both, as in an empty table.
    Values are taken from a typical one, the median of a few rows, so that large
    offsets cost no digits.
    """
    names = list(columns)
    d = len(names)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("v"))
    few = rows.limit(100).collect()
    if not few:
        rows = df.sparkSession.range(1).select(F.array(*[F.lit(None).cast("double")] * d).alias("v"))
    first = np.array([r["v"] for r in few], dtype=float).reshape(len(few), d)
    finite = np.where(np.isfinite(first), first, np.nan)
    typical = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in finite.T])
    left, right = np.triu_indices(d, 1)
    fields = ["n", "sa", "sb", "saa", "sbb", "sab", "bad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows known, sums and squares of a where b is known, products, rows not finite.
        known, sums, squares, products, bad = (np.zeros((d, d)) for _ in range(5))
        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column(0).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(len(batch), d) - typical
            mask = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(batch), d)
            odd = (mask & ~np.isfinite(x)).astype(float)
            x = np.where(mask & (odd == 0), x, 0.0)
            mask = mask.astype(float)
            known += mask.T @ mask
            sums += x.T @ mask
            squares += (x * x).T @ mask
            products += x.T @ x
            bad += odd.T @ mask
        upper = [m[left, right] for m in (known, sums, sums.T, squares, squares.T, products, bad + bad.T)]
        for at in range(0, len(left), 1 << 16):
            end = at + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(left[at:end], pa.int32()), pa.array(right[at:end], pa.int32()), *[pa.array(u[at:end]) for u in upper]], names=["a_pos", "b_pos", *fields])

    parts = rows.mapInArrow(run, "a_pos int, b_pos int, " + ", ".join(f"{f} double" for f in fields))
    pairs = parts.groupBy("a_pos", "b_pos").agg(*[F.sum(f).alias(f) for f in fields])

    def spread(total: str, square: str) -> Column:
        # What rounding leaves of a constant is no spread.
        var = F.col(square) - F.col(total) * F.col(total) / F.col("n")
        return F.when(var > F.lit(1e-13) * F.col(square), var)

    sound = F.when(F.col("n") > 1, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(spread("sa", "saa") * spread("sb", "sbb")))
    bounded = F.when(sound.isNotNull(), F.least(F.greatest(sound, F.lit(-1.0)), F.lit(1.0)))
    r = F.when(F.col("bad") > 0, F.lit(float("nan"))).otherwise(bounded)
    named = F.array(*[F.lit(c) for c in names])
    return pairs.select("a_pos", F.get(named, F.col("a_pos")).alias("a"), "b_pos", F.get(named, F.col("b_pos")).alias("b"), r.alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full matrix in long form (a, b, r), diagonal included."""
    upper = correlation_pairs(df, columns).select("a", "b", "r")
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    spread = spread_profile(df, columns)
    diagonal = spread.select(
        F.col("column").alias("a"), F.col("column").alias("b"),
        F.when(~F.col("is_constant") & (F.col("n") > 1), F.lit(1.0)).alias("r"),
    )
    return upper.unionByName(lower).unionByName(diagonal)


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> DataFrame:
    """Columns correlated above ``limit`` with any earlier column."""
    return (
        correlation_pairs(df, columns)
        .filter(F.abs("r") > limit)
        .groupBy("b").agg(F.min("b_pos").alias("position"))
        .select(F.col("b").alias("column"), "position")
    )


def prune_features(
    df: DataFrame, label: str, max_corr: float = 0.9, min_var: float = 0.01
) -> list[str]:
    """Surviving numeric features: not constant, not repeated, not flat."""
    features = numeric_columns(df, exclude=[label])
    constant = set(constant_columns(df, features))
    features = [c for c in features if c not in constant]
    if len(features) > 1:
        repeated = {r["column"] for r in correlated_columns(df, features, max_corr).collect()}
        features = [c for c in features if c not in repeated]
    flat = set(low_variance_columns(df, features, min_var)) if features else set()
    return [c for c in features if c not in flat]


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency.

    Values are counted per (column, value) first; that combines map-side, so a
    hot value costs one row per task, and the rest comes from the counts.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    counted = (
        _long(df, cells).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.max(F.struct("n", "value"))
    return counted.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        best["value"].alias("top"), best["n"].alias("freq"))


def describe_numbers(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row per column."""
    quart = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, **options)
    one = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), *[F.lit(q).cast("double").alias(n) for n, q in zip(("p25", "p50", "p75"), quart[c])],
            F.max(v).alias("max"),
        ).alias(f"p{i}")
        for i, c in enumerate(columns) for v in [F.col(c).cast("double")]
    ])
    return _long(one, [F.col(f"p{i}") for i in range(len(columns))])


def describe_all(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Profile of every column: numbers and text each with their own figures."""
    columns = list(columns or df.columns)
    numbers = [c for c in numeric_columns(df) if c in columns]
    text = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        parts.append(describe_numbers(df, numbers, **options))
    if text:
        parts.append(describe_text(df, text))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F per feature from per-class count, mean and variance."""
    per_class = df.groupBy(label).agg(*[
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.coalesce(F.var_samp(c), F.lit(0.0)).alias("var"),
        ).alias(f"s{i}") for i, c in enumerate(features)
    ])
    stats = per_class.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(features))])).alias("s")).select("s.*")
    feature = Window.partitionBy("feature")  # classes of one feature
    stats = stats.filter("n > 0").withColumn(
        "grand", F.sum(F.col("n") * F.col("mean")).over(feature) / F.sum("n").over(feature)
    )
    n, k = F.sum("n"), F.count(F.lit(1))
    between = F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand")))
    within = F.sum((F.col("n") - 1) * F.col("var"))
    return stats.groupBy("feature").agg(
        F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k)).alias("f_score")
    )


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int = 6) -> DataFrame:
    k = min(k, len(features))
    return anova_f(df, features, label).orderBy(F.desc_nulls_last("f_score"), "feature").limit(k)
