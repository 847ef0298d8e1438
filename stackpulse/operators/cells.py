"""Statistics over the cells of a stack and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import array_std, cell_argmin, cell_label, cell_min
from ..functions.scalars import label_number
from ..schema import REPORT_COLUMNS
from .clean import existing


def pack_cells(df: DataFrame, columns: Sequence[str], name: str = "cells") -> DataFrame:
    """Fold parallel cell columns into one array column."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns])).drop(*columns)


def cell_features(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Add the spread, the minimum and its position and label."""
    c = F.col(cells)
    return df.withColumns({
        "Cell_Voltage_Std": array_std(c),
        "Min_Cell_Voltage": cell_min(c),
        "min_cell": cell_argmin(c),
        "Min_Cell_Index": cell_label(cell_argmin(c)),
    })


def report_rows(df: DataFrame, columns: Sequence[str] = tuple(REPORT_COLUMNS)) -> DataFrame:
    """Report projection over those of its columns that exist."""
    return df.select(*existing(df, columns))


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value; the smallest one on ties."""
    counts = value_counts(df.filter(F.col(column).isNotNull()), column)
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(1)


def counts_per_cell(df: DataFrame, n_cells: int, cell: str = "min_cell") -> DataFrame:
    """Count of rows for every cell 1..n, zero where there are none."""
    domain = df.sparkSession.range(1, n_cells + 1).select(F.col("id").cast("int").alias(cell))
    # At most one row per cell of the domain.
    counts = value_counts(df.filter(F.col(cell).between(1, n_cells)), cell, name="Count")
    return (
        domain.join(F.broadcast(counts), cell, "left")
        .select(cell, cell_label(F.col(cell)).alias("Min_Cell_Index"), F.coalesce("Count", F.lit(0)).alias("Count"))
    )


def sort_by_cell(df: DataFrame, label: str = "Min_Cell_Index") -> DataFrame:
    return df.withColumn("Cell_Number", label_number(F.col(label))).orderBy("Cell_Number")


def anomaly_summary(
    df: DataFrame, flag: str, voltage: str = "Min_Cell_Voltage", label: str = "Min_Cell_Index",
    means: Sequence[str] = (),
) -> DataFrame:
    """One row: totals, share, most affected cell, range and means at anomalies.

    An empty table, or one without anomalies, gives zeros and the cell "None".
    """
    hit = F.col(flag)
    per_label = df.groupBy(F.when(hit, F.col(label)).alias("_label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("hits"),
        F.min(F.when(hit, F.col(voltage))).alias("lo"),
        F.max(F.when(hit, F.col(voltage))).alias("hi"),
        *[F.sum(F.when(hit, F.col(m))).alias(f"s{i}") for i, m in enumerate(means)],
        *[F.count(F.when(hit, F.col(m))).alias(f"c{i}") for i, m in enumerate(means)],
    )
    # One row per cell label is left here; ties go to the smallest label.
    order = F.struct(F.col("hits"), -label_number(F.col("_label")), F.col("_label"))
    best = F.max(F.when(F.col("_label").isNotNull(), order))
    zero = F.lit(0.0)
    return per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.try_divide(F.sum("hits") * 100.0, F.sum("n")), zero).alias("anomaly_percentage"),
        F.coalesce(best[f"_label"], F.lit("None")).alias("most_affected_cell"),
        F.coalesce(F.min("lo"), zero).alias("min_voltage"),
        F.coalesce(F.max("hi"), zero).alias("max_voltage"),
        *[F.coalesce(F.try_divide(F.sum(f"s{i}"), F.sum(f"c{i}")), zero).alias(f"avg_{m}") for i, m in enumerate(means)],
    )


def prediction_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.avg(column).alias("mean_predicted"),
        F.min(column).alias("min_predicted"), F.max(column).alias("max_predicted"),
    )


def health_summary(df: DataFrame, label: str, critical: float, degraded: float) -> DataFrame:
    """Rows per health label with the threshold text of the label."""
    text = {
        "Critical": f"< {critical:.3f} V",
        "Degraded": f"{critical:.3f}–{degraded:.3f} V",
        "Healthy": f"≥ {degraded:.3f} V",
    }
    expr = F.lit(None).cast("string")
    for key, value in text.items():
        expr = F.when(F.col(label) == key, F.lit(value)).otherwise(expr)
    return value_counts(df, label).withColumn("threshold", expr)


def overlay(readings: DataFrame, marks: DataFrame, time: str = "Date_Time", name: str = "is_anomaly") -> DataFrame:
    """All readings of a cell with a flag where an anomaly has the same time."""
    times = marks.select(time).distinct().withColumn(name, F.lit(True))
    return readings.join(times, time, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
