"""Report, record, metrics and checkpoint writers, with their readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Thresholds used when no metrics table is there.
DEFAULT_THRESHOLDS = {"critical_threshold": 3.1, "degraded_threshold": 3.25}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_by_cell(df: DataFrame, path: str, cell: str = "min_cell", mode: str = "errorifexists") -> None:
    """One folder per cell in one pass.

    Rebalancing gathers small cells and splits a cell that holds most of the
    rows, so no single task writes it.
    """
    df.hint("rebalance", cell).write.mode(mode).option("header", True).partitionBy(cell).csv(path)


def read_cell(spark: SparkSession, path: str, schema: T.StructType, number: int, n_cells: int = 96, cell: str = "min_cell") -> DataFrame:
    """Rows of one cell; the filter prunes to that cell's folder."""
    if not 1 <= number <= n_cells:
        raise ValueError(f"invalid cell number {number}; must be between 1 and {n_cells}")
    return spark.read.schema(schema).option("header", True).csv(path).filter(F.col(cell) == number)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write a report as one run; writing the same run again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_latest_run(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """The base report when there is one, else the newest run."""
    if base is not None and path_exists(spark, base):
        return spark.read.parquet(base)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no report under {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    latest = max((n for n in names if n.startswith("run_id=")), default=None)
    if latest is None:
        raise FileNotFoundError(f"no report under {path}")
    return spark.read.option("basePath", path).parquet(f"{path}/{latest}")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def as_records(df: DataFrame, name: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_metrics(metrics: dict[str, float], spark: SparkSession, path: str) -> None:
    schema = T.StructType([T.StructField(k, T.DoubleType()) for k in metrics])
    row = tuple(float(v) for v in metrics.values())
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    """Typed read of the two health thresholds, with defaults when absent."""
    if not path_exists(spark, path):
        return dict(DEFAULT_THRESHOLDS)
    schema = T.StructType([T.StructField(k, T.DoubleType()) for k in DEFAULT_THRESHOLDS])
    row = spark.read.schema(schema).json(path).first()
    return {k: (DEFAULT_THRESHOLDS[k] if row is None or row[k] is None else row[k]) for k in DEFAULT_THRESHOLDS}
