"""Session settings and the shared scratch folder."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Arrow batches that carry blocks of vectors are wide, so they are bounded by
# bytes as well as by rows.
_RUNTIME_DEFAULTS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.session.timeZone": "UTC",
}

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "stackpulse", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        **_RUNTIME_DEFAULTS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers start from another folder, and on a cluster from another host, so
    they cannot rely on the driver's import path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="stackpulse-code-")) / "stackpulse.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Fill in the runtime settings that the caller's session leaves unset and
    make the package known to the workers."""
    ship_package(spark)
    for key, value in _RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local master may fall back on a temporary folder, because on a
    cluster the executors do not see the driver's disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="stackpulse-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/stackpulse/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    This cuts lineage with a table that survives the loss of executors, and it
    pins everything that may differ between two evaluations of one plan, such
    as range-partition boundaries.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table that came in fewer pieces than there are cores;
    iterative training reads it many times. Meant for pinned tables."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of the scratch folder that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    drop(spark, [f"{scratch_root(spark)}/stackpulse/{spark.sparkContext.applicationId}"])
