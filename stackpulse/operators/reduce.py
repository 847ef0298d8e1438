"""Principal axes, truncated SVD and reconstruction error.

Axes of tables up to ``WIDE`` columns are exact: every partition reduces its
rows to the triangle of a QR decomposition, and since the rows of a triangle are
again rows, the same step reduces the triangles until one is left. Wider tables
are multiplied by a narrow random matrix and back a few times, so a task and the
driver hold width x (k + ``EXTRA``) numbers; a last pass takes the triangle of
the rows' coordinates in the range found. No covariance matrix is ever made.
Missing values must be filled before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Widest table whose d x d triangle is made.
WIDE = 2048
# Of wider tables: columns beyond k in the random matrix, and turns to and fro.
EXTRA, TURNS = 10, 6
# Partitions between the first triangles and the last.
MIDDLE = 32


@dataclass
class Axes:
    """Fitted axes: the Spark model, and small numbers per axis.

    ``sign`` makes the largest loading of each axis positive, ``offset`` is the
    projection of the mean (zero without centring), ``singular`` are the
    singular values of the (centred) table.
    """

    model: PCAModel
    sign: list[float]
    offset: list[float]
    mean: list[float]
    singular: list[float] = field(default_factory=list)

    def project(self, df: DataFrame, vector: str, name: str = "axes") -> DataFrame:
        """Add the centred coordinates as array<double>; all inside the JVM."""
        wide = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
        out = self.model.transform(wide)
        p = vector_to_array("_p")
        coords = [(p[i] - F.lit(o)) * F.lit(s) for i, (s, o) in enumerate(zip(self.sign, self.offset))]
        return out.withColumn(name, F.array(*coords)).drop("_v", "_p")

    def components(self) -> np.ndarray:
        """Axes as rows."""
        return self.model.pc.toArray().T * np.asarray(self.sign)[:, None]

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        row = [(self.sign, self.offset, self.mean, self.singular)]
        schema = "sign array<double>, offset array<double>, mean array<double>, singular array<double>"
        spark.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Axes":
        r = spark.read.parquet(f"{path}/numbers").first()
        return cls(PCAModel.load(f"{path}/model"), list(r["sign"]), list(r["offset"]), list(r["mean"]), list(r["singular"]))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The rows of array batches as matrices of the given width."""
    for batch in batches:
        if len(batch):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(x) != len(batch) * dim:
                raise ValueError("vectors differ in length")
            yield x.reshape(len(batch), dim)


def _listed(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _triangles(rows: DataFrame, dim: int) -> DataFrame:
    """Rows with the same singular values and right vectors, at most ``dim`` in
    each partition: the triangle of its QR decomposition, fed batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, count = np.zeros((0, dim)), [], 0
        for x in _matrices(batches, dim):
            waiting.append(x)
            count += len(x)
            if count >= 2 * dim:
                held, waiting, count = np.linalg.qr(np.vstack([held, *waiting]), mode="r"), [], 0
        held = np.linalg.qr(np.vstack([held, *waiting]), mode="r") if count else held
        step = max(1, (1 << 20) // dim)
        for at in range(0, len(held), step):
            yield pa.RecordBatch.from_arrays([_listed(held[at:at + step])], names=["vec"])

    return rows.select("vec").mapInArrow(run, "vec array<double>")


def _triangle(rows: DataFrame, dim: int) -> np.ndarray:
    """One triangle of the whole table, by a tree of three levels."""
    few = _triangles(_triangles(rows, dim).repartition(MIDDLE), dim)
    found = _triangles(few.coalesce(1), dim).collect()  # ``dim`` rows at most
    return np.array([r["vec"] for r in found], dtype=float).reshape(-1, dim)


def _centred(rows: DataFrame, mean: np.ndarray, basis: np.ndarray | None = None) -> DataFrame:
    """Rows less the mean, or their coordinates in ``basis``."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))  # width x (k + EXTRA) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, axes = shared.value
        for x in _matrices(batches, len(middle)):
            yield pa.RecordBatch.from_arrays([_listed(np.ascontiguousarray(x - middle if axes is None else (x - middle) @ axes))], names=["vec"])

    return rows.mapInArrow(run, "vec array<double>")


def _to_and_fro(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The table's transpose times the table times ``basis``, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))
    width = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, axes = shared.value
        total = np.zeros(axes.shape)
        for x in _matrices(batches, len(middle)):
            total += (x - middle).T @ ((x - middle) @ axes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), _listed(total)], names=["place", "part"])

    parts = rows.mapInArrow(run, "place long, part array<double>")
    sums = parts.groupBy("place").agg(*[F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(width)]).orderBy("place").collect()
    return np.array([r[1:] for r in sums], dtype=float)


def _fit(df: DataFrame, vector: str, k: int, centre: bool, wide: int, seed: int) -> Axes:
    rows = df.select(F.col(vector).cast("array<double>").alias("vec")).filter("vec is not null")
    if rows.isEmpty():
        raise ValueError("no vectors to fit axes on")
    moments = rows.select(Summarizer.metrics("mean", "count", "normL2").summary(array_to_vector("vec")).alias("m")).select("m.*").first()
    average, n = moments["mean"].toArray(), moments["count"]
    dim = len(average)
    if not 1 <= k <= dim:
        raise ValueError(f"k must be between 1 and {dim}")
    mean = average if centre else np.zeros(dim)
    if dim <= wide:
        triangle = _triangle(_centred(rows, mean) if centre else rows, dim)
        _, singular, vectors = np.linalg.svd(triangle, full_matrices=True)
    else:
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, min(dim, k + EXTRA))))[0]
        for _ in range(TURNS):
            basis = np.linalg.qr(_to_and_fro(rows, mean, basis))[0]
        _, singular, turned = np.linalg.svd(_triangle(_centred(rows, mean, basis), basis.shape[1]), full_matrices=True)
        vectors = turned @ basis.T
    singular = np.pad(singular, (0, max(0, k - len(singular))))[:k]
    total = float((moments["normL2"].toArray() ** 2).sum() - n * (mean @ mean))
    pc = vectors[:k].T
    explained = singular ** 2 / total if total > 0 else np.zeros(k)
    model = PCAModel(JavaWrapper._new_java_obj(
        "org.apache.spark.ml.feature.PCAModel", "principal_axes", DenseMatrix(dim, k, pc.ravel(order="F")), DenseVector(explained)))._set(k=k, inputCol="_v", outputCol="_p")
    top = pc[np.abs(pc).argmax(axis=0), np.arange(k)]
    return Axes(model, np.where(top < 0, -1.0, 1.0).tolist(), (mean @ pc).tolist(), mean.tolist(), singular.tolist())


def fit_pca(df: DataFrame, vector: str, k: int = 2, wide: int = WIDE, seed: int = 42) -> Axes:
    """Leading principal axes: right singular vectors of the centred table.
    Null vectors take no part; an empty table raises."""
    return _fit(df, vector, k, True, wide, seed)


def fit_svd(df: DataFrame, vector: str, k: int = 2, wide: int = WIDE, seed: int = 42) -> Axes:
    """Leading right singular vectors, without centring."""
    return _fit(df, vector, k, False, wide, seed)


def with_pca_columns(df: DataFrame, axes: Axes, vector: str, prefix: str = "PCA") -> DataFrame:
    out = axes.project(df, vector, "_axes")
    return out.withColumns({f"{prefix}{i + 1}": F.col("_axes")[i] for i in range(len(axes.sign))}).drop("_axes")


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)


def reconstruction_error(df: DataFrame, axes: Axes, vector: str, name: str = "recon_error") -> DataFrame:
    """Mean squared error of projecting on the axes and back.

    The axes are orthonormal, so the squared error is the squared length of the
    centred vector less that of its coordinates; nothing is rebuilt.
    """
    mean = F.array(*[F.lit(float(m)) for m in axes.mean])
    out = axes.project(df, vector, "_axes")
    centred = F.zip_with(F.col(vector).cast("array<double>"), mean, lambda a, b: a - b)
    error = F.greatest(_squares(centred) - _squares(F.col("_axes")), F.lit(0.0)) / F.size(vector)
    return out.withColumn(name, error).drop("_axes")
