"""Scoring of records and files as they land.

Both jobs use the ``availableNow`` trigger, so a run handles what is there and
ends; the checkpoint makes the next run go on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path


def score_records(
    spark: SparkSession, source: str, schema: T.StructType, score: Callable[[DataFrame], DataFrame], sink: str,
    checkpoint: str | None = None, max_files: int | None = None,
) -> StreamingQuery:
    """Read JSON records, score them row by row and append parquet.

    ``score`` must use stored statistics only; the statistics of one small
    batch of records mean nothing.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        score(reader.json(source)).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True).start(sink)
    )


def score_files(
    spark: SparkSession, source: str, schema: T.StructType, report: Callable[[DataFrame, str], None],
    checkpoint: str | None = None, fmt: str = "csv", max_files: int | None = None,
) -> StreamingQuery:
    """Run a batch report over the files of each trigger.

    ``report`` gets the rows and a run id that depends on the batch alone, so a
    batch that is repeated after a failure writes the same run again.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.option("header", True).csv(source) if fmt == "csv" else reader.format(fmt).load(source)
    return (
        rows.writeStream.foreachBatch(lambda df, batch: report(df, f"batch_{batch:012d}"))
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True).start()
    )
