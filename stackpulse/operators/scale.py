"""Scaling with population formulas; a constant column scales to zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .quantiles import quantiles


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per column (offset, width)."""
    row = df.agg(*[e for i, c in enumerate(columns) for e in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"))]).first()
    return {c: (row[f"a{i}"], _width(row[f"b{i}"] - row[f"a{i}"])) for i, c in enumerate(columns) if row[f"a{i}"] is not None}


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[e for i, c in enumerate(columns) for e in (F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"b{i}"))]).first()
    return {c: (row[f"a{i}"], _width(row[f"b{i}"])) for i, c in enumerate(columns) if row[f"a{i}"] is not None}


def fit_robust(df: DataFrame, columns: Sequence[str], **options) -> dict[str, tuple[float, float]]:
    q = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, **options)
    return {c: (v[1], _width(v[2] - v[0])) for c, v in q.items() if v[1] is not None}


def _width(value: float) -> float:
    return float(value) if value else 1.0


def apply_scale(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(value - offset) / width, as literals inside one projection."""
    return df.withColumns({
        c: (F.col(c) - F.lit(float(offset))) / F.lit(float(width)) for c, (offset, width) in params.items()
    })


def scale_table(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The parameters as a small table, to be stored beside a model."""
    rows = [(c, float(o), float(w)) for c, (o, w) in params.items()]
    return df.sparkSession.createDataFrame(rows, "column string, offset double, width double")


def load_scale(table: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["column"]: (r["offset"], r["width"]) for r in table.collect()}
