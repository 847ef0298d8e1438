"""Table and record readers."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import STACK_RECORD

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def format_of(path: str) -> str:
    """Format by suffix; other suffixes are refused."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format {suffix or path!r}; use one of {sorted(FORMATS)}")
    return FORMATS[suffix]


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None
) -> DataFrame:
    """Read CSV, JSON or parquet; text formats need a declared schema."""
    fmt = fmt or format_of(path)
    if fmt not in set(FORMATS.values()):
        raise ValueError(f"unsupported file format {fmt!r}")
    if fmt == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if schema is None:
        raise ValueError(f"{fmt} input needs a schema")
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).json(path)


def cell_columns(cells: Column, n: int) -> list[Column]:
    """``Cell1..CellN`` from an array column; absent positions give null."""
    return [F.get(cells, i).alias(f"Cell{i + 1}") for i in range(n)]


def parse_stack_records(
    df: DataFrame, body: str, n_cells: int = 96, schema: T.StructType = STACK_RECORD, cells: str = "Cell_Voltages"
) -> tuple[DataFrame, DataFrame]:
    """Parse JSON records with a cell array: (flat rows, refused rows).

    A record with a wrong number of cells, or that is not JSON, is refused.
    """
    parsed = df.withColumn("_r", F.from_json(F.col(body), schema))
    ok = F.coalesce(F.size(F.col(f"_r.{cells}")) == n_cells, F.lit(False))
    rest = [f.name for f in schema.fields if f.name != cells]
    keep = [c for c in df.columns if c != body]
    flat = parsed.filter(ok).select(
        *keep, *[F.col(f"_r.`{c}`").alias(c) for c in rest], *cell_columns(F.col(f"_r.{cells}"), n_cells)
    )
    return flat, parsed.filter(~ok).select(*keep, body)


def map_features(
    df: DataFrame, column: str, features: Sequence[str], fill: float | None = 0.0
) -> DataFrame:
    """Fixed feature columns from a map; extra keys are dropped.

    With ``fill=None`` (strict) missing features stay null and are listed in
    ``missing_features``.
    """
    m = F.col(column)
    keep = [c for c in df.columns if c != column]
    if fill is not None:
        return df.select(*keep, *[F.coalesce(m.getItem(f), F.lit(fill)).alias(f) for f in features])
    missing = F.array_compact(F.array(*[F.when(m.getItem(f).isNull(), F.lit(f)) for f in features]))
    return df.select(*keep, *[m.getItem(f).alias(f) for f in features], missing.alias("missing_features"))


def parse_map(df: DataFrame, body: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, F.from_json(F.col(body), T.MapType(T.StringType(), T.DoubleType())))


def parse_record(df: DataFrame, body: str, schema: T.StructType, renames: Mapping[str, str]) -> DataFrame:
    """Parse a flat JSON record and rename its fields."""
    keep = [c for c in df.columns if c != body]
    parsed = df.withColumn("_r", F.from_json(F.col(body), schema)).select(*keep, "_r.*")
    return parsed.withColumnsRenamed(dict(renames))
