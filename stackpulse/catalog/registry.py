"""Registry of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def cells_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a stack of 64 cells."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("cells")
    )


CELLS_SQL = "cells AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS c FROM embeddings)"
N_CELLS = 64


def series_table(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Events as one series per user: current from value, voltage from props.

    With ``gaps`` every event whose id divides by 7 loses its current.
    """
    current = F.col("value")
    if gaps:
        current = F.when(F.col("event_id") % 7 != 0, current)
    voltage = F.from_json("props", "k double").getField("k")
    return table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", current.alias("current"), voltage.alias("voltage")
    )


SERIES_SQL = """series AS (
  SELECT user_id, ts, event_id, value AS current,
         CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS voltage,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_no,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""
ORDER = ["ts", "event_id"]
SERIES = ["user_id"]
