"""Stack anomaly report: from raw cell readings to reports and summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clean_time_text
from ..operators import cells as cell_ops, clean, density, reduce, scale
from ..operators.quantiles import array_quantiles
from ..schema import N_CELLS, STACK_CONDITIONS, require_columns
from ..session import materialise
from ..sources import sinks, tables


@dataclass
class StackReport:
    rows: DataFrame
    report: DataFrame
    summary: DataFrame
    eps: float
    min_samples: int


def repair_cells(df: DataFrame, cells: str, n_cells: int, nonzero: bool = True) -> DataFrame:
    """Zero or missing cells become the median of their position."""
    mids = array_quantiles(df, cells, n_cells, 0.5, (lambda v: v != 0) if nonzero else None)
    fill = F.array(*[F.lit(float(m or 0.0)) for m in mids])
    return df.withColumn(cells, F.zip_with(
        cells, fill, lambda v, m: F.when(v.isNull() | (v == 0), m).otherwise(v)))


def stack_report(
    df: DataFrame, key: str, cells: str = "cells", conditions: Sequence[str] = tuple(STACK_CONDITIONS),
    n_cells: int = N_CELLS, eps: float | None = None, min_samples: int | None = None, nonzero: bool = True,
) -> StackReport:
    """Deduplicate, repair, scale, cluster and report a batch of readings.

    ``df`` holds a key, an optional ``Date_Time`` text, the operating
    conditions and an array of cells. Clustering runs on the batch itself.
    """
    require_columns(df, [key, cells, *conditions])
    rows = clean.drop_duplicate_rows(df)
    if "Date_Time" in rows.columns:
        rows = rows.withColumn("Date_Time", clean_time_text(F.col("Date_Time")))
    rows = materialise(cell_ops.cell_features(rows, cells), "stack_rows")

    numbers = [*conditions, "Cell_Voltage_Std"]
    inputs = rows.select(key, cells, *[F.col(c).cast("double") for c in numbers])
    inputs = clean.zero_to_mean(inputs, numbers, nonzero)
    inputs = clean.fill_means(repair_cells(inputs, cells, n_cells, nonzero), numbers)
    wide = inputs.select(key, *numbers, *tables.cell_columns(F.col(cells), n_cells))
    names = [c for c in wide.columns if c != key]
    scaled = scale.apply_scale(wide, scale.fit_minmax(wide, names))
    vectors = materialise(scaled.select(key, F.array(*names).alias("x")), "stack_vectors")

    labels, eps, min_samples = density.elbow_dbscan(vectors, key, "x", eps, min_samples)
    axes = reduce.fit_pca(vectors, "x", 2)
    placed = reduce.with_pca_columns(vectors, axes, "x").select(key, "PCA1", "PCA2")
    out = materialise(rows.join(labels, key).join(placed, key), "stack_labelled")

    noise = clean.split_noise(out)[1]
    flagged = out.withColumn("_hit", F.col("Cluster") == -1)
    means = clean.existing(out, ["Load", "H2Flow", "TstackIn"])
    return StackReport(out, cell_ops.report_rows(noise), cell_ops.anomaly_summary(flagged, "_hit", means=means), eps, min_samples)


def write_stack_report(result: StackReport, folder: str, run_id: str) -> None:
    """Main report as one run, reports per cell in one pass, summary as JSON."""
    noise = clean.split_noise(result.rows)[1]
    sinks.write_run(result.report, f"{folder}/anomalies", run_id)
    names = clean.existing(noise, ["Date_Time", "Min_Cell_Voltage", "Min_Cell_Index", "min_cell"])
    sinks.write_by_cell(noise.select(*names), f"{folder}/cells/{run_id}", mode="overwrite")
    sinks.write_records(result.summary, f"{folder}/summary/{run_id}", "overwrite")
