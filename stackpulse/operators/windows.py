"""Work on sliding windows in Arrow batches, without a table of windows.

Rows of a block (with its halo) lie together and in order; a batch holds many
such runs, of many series. Windows are views into the batch, so a row travels
about once, however long the windows are and however short the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordered import BLOCK, BLOCK_ROWS, ROW, with_halo

_RUN = "_run"


@dataclass
class Batch:
    """Rows of whole runs; ``targets`` are the rows that end a full window and
    belong to the block, ``run`` numbers the run of each row."""

    table: pa.Table
    x: np.ndarray
    run: np.ndarray
    targets: np.ndarray
    length: int

    def windows(self, part: slice = slice(None)) -> np.ndarray:
        """(targets, length, features): the rows before each target."""
        return self.x[self.targets[part, None] + np.arange(-self.length, 0)]


def _batch(table: pa.Table, starts: np.ndarray, features: Sequence[str], length: int) -> Batch:
    x = np.stack([table[f].to_numpy().astype(float) for f in features], axis=1)
    run = np.cumsum(starts) - 1
    since = np.arange(len(x)) - np.flatnonzero(starts)[run]
    own = table["_own"].to_numpy().astype(bool)
    return Batch(table, x, run, np.flatnonzero(own & (since >= length)), length)


def run_starts(table: pa.Table) -> np.ndarray:
    run, row = table[_RUN].to_numpy(), table[ROW].to_numpy()
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1] + 1)
    return new


def map_windows(
    indexed: DataFrame, features: Sequence[str], length: int, fn: Callable[[Batch], Iterator[pa.RecordBatch]], schema: str,
    series: Sequence[str] = (), block_rows: int = BLOCK_ROWS, extra: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run ``fn`` on batches of whole runs. ``extra`` may add columns to the
    rows of the blocks. A run that a batch cuts waits for its rest; it is no
    longer than a block and its halo."""
    rows = with_halo(indexed.select(*series, ROW, *[F.col(f).cast("double").alias(f) for f in features]), length, block_rows)
    rows = rows if extra is None else extra(rows)
    rows = rows.withColumn(_RUN, F.xxhash64(*series, BLOCK))
    dealt = rows.repartition(*series, BLOCK).sortWithinPartitions(_RUN, *series, BLOCK, ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            starts = run_starts(held)
            last = int(np.flatnonzero(starts)[-1])
            if last:
                yield from fn(_batch(held.slice(0, last).combine_chunks(), starts[:last], features, length))
                held = held.slice(last)
        if held is not None:
            held = held.combine_chunks()
            yield from fn(_batch(held, run_starts(held), features, length))

    return dealt.mapInArrow(run, schema)


def key_schema(indexed: DataFrame, series: Sequence[str]) -> str:
    return ", ".join([*[f"`{s}` {indexed.schema[s].dataType.simpleString()}" for s in series], f"{ROW} long"])


def keyed(batch: Batch, series: Sequence[str], part: slice, **columns: np.ndarray) -> pa.RecordBatch:
    """Series and row number of targets, with columns beside them."""
    kept = batch.table.select([*series, ROW]).take(pa.array(batch.targets[part])).combine_chunks()
    arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in kept.columns]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(v) for v in columns.values())], names=[*series, ROW, *columns])


def _strips(n: int, width: int) -> Iterator[slice]:
    step = max(1, (1 << 21) // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


@dataclass
class WindowAxes:
    """Mean window and leading principal axes (rows) of flat windows."""

    mean: np.ndarray
    components: np.ndarray
    covariance: np.ndarray


def window_covariance(indexed: DataFrame, features: Sequence[str], length: int, series: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> tuple[int, np.ndarray, np.ndarray]:
    """(windows, mean, covariance) of the flat windows.

    Products of the elements are summed per batch, around the mean of each
    feature, and the sums of (length x features) squared numbers are added up by
    Spark. Windows with a missing value do not count.
    """
    centre = np.array([v or 0.0 for v in indexed.agg(*[F.avg(F.col(f).cast("double")) for f in features]).first()])
    size = length * len(features)

    def sums(batch: Batch) -> Iterator[pa.RecordBatch]:
        total, product, n = np.zeros(size), np.zeros((size, size)), 0
        for part in _strips(len(batch.targets), size):
            w = (batch.windows(part) - centre).reshape(-1, size)
            w = w[np.isfinite(w).all(axis=1)]
            n += len(w)
            total += w.sum(axis=0)
            product += w.T @ w
        if n:
            rows = np.concatenate([product, total[None], np.full((1, size), float(n))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2, dtype=np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "v"])

    partial = map_windows(indexed, features, length, sums, "i int, v array<double>", series, block_rows)
    added = partial.groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(size)]).alias("v"))
    rows = {r["i"]: np.array(r["v"]) for r in added.collect()}  # size + 2 rows
    if not rows:
        return 0, np.zeros(size), np.zeros((size, size))
    n = int(rows[size + 1][0])
    mean = rows[size] / n
    product = np.stack([rows[i] for i in range(size)])
    return n, mean + np.tile(centre, length), (product - n * np.outer(mean, mean)) / max(1, n - 1)


def fit_window_axes(indexed: DataFrame, features: Sequence[str], length: int, k: int, series: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> WindowAxes:
    _, mean, covariance = window_covariance(indexed, features, length, series, block_rows)
    vectors = np.linalg.eigh(covariance)[1][:, ::-1][:, :k].T
    return WindowAxes(mean, np.ascontiguousarray(vectors), covariance)


def window_scores(flat: np.ndarray, axes: WindowAxes) -> np.ndarray:
    """Mean squared error of flat windows after projection and back."""
    w = flat - axes.mean
    rest = (w * w).sum(axis=1) - ((w @ axes.components.T) ** 2).sum(axis=1)
    return np.maximum(rest, 0.0) / len(axes.mean)


def window_errors(indexed: DataFrame, features: Sequence[str], length: int, axes: WindowAxes, series: Sequence[str] = (), block_rows: int = BLOCK_ROWS, name: str = "recon_error") -> DataFrame:
    """(series, row_no, name): mean squared error of each window after it is
    projected on the axes and back."""
    def errors(batch: Batch) -> Iterator[pa.RecordBatch]:
        for part in _strips(len(batch.targets), len(axes.mean)):
            yield keyed(batch, series, part, **{name: window_scores(batch.windows(part).reshape(-1, len(axes.mean)), axes)})

    return map_windows(indexed, features, length, errors, f"{key_schema(indexed, series)}, {name} double", series, block_rows)
