"""Dynamic time warping of sliding windows against a reference window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordered import BLOCK_ROWS, ROW, join_keys
from .windows import Batch, key_schema, keyed, map_windows

# Windows whose costs fit a core's cache.
_CHUNK = 128


def warp(windows: np.ndarray, reference: np.ndarray, band: int | None = None) -> np.ndarray:
    """Exact warping distance of many windows (m, a, f) to one reference (b, f),
    or to one each (m, b, f).

    The recurrence runs over anti-diagonals: all cells of one, for all windows,
    only need the two before.
    """
    reference = reference if reference.ndim == 3 else reference[None]
    m, a, b = len(windows), windows.shape[1], reference.shape[1]
    squares = np.zeros((a, b, m))
    for f in range(windows.shape[2]):
        gap = np.ascontiguousarray(windows[:, :, f].T)[:, None, :] - np.ascontiguousarray(reference[:, :, f].T)[None]
        squares += np.multiply(gap, gap, out=gap)
    step = np.sqrt(squares, out=squares)
    if band is not None:
        i, j = np.indices((a, b))
        step[np.abs(i * (b - 1) - j * (a - 1)) > band * max(a - 1, b - 1, 1)] = np.inf
    cost = np.full((a + 1, b + 1, m), np.inf)
    cost[0, 0] = 0.0
    flat_cost, flat_step = cost.reshape(-1, m), step.reshape(-1, m)

    def diagonal(flat: np.ndarray, width: int, i: int, j: int, n: int) -> np.ndarray:
        """A view of n cells from (i, j) on, each a row lower and a column before."""
        start, stride = i * width + j, max(1, width - 1)
        return flat[start:start + (n - 1) * stride + 1:stride]

    for s in range(a + b - 1):
        i = max(0, s - b + 1)
        j, n = s - i, min(a - 1, s) + 1 - i
        best = np.minimum(diagonal(flat_cost, b + 1, i, j + 1, n), diagonal(flat_cost, b + 1, i + 1, j, n))
        np.minimum(best, diagonal(flat_cost, b + 1, i, j, n), out=best)
        np.add(diagonal(flat_step, b, i, j, n), best, out=diagonal(flat_cost, b + 1, i + 1, j + 1, n))
    return cost[a, b]


def warp_distances(
    indexed: DataFrame, features: Sequence[str], reference: DataFrame, length: int = 30, series: Sequence[str] = (),
    band: int | None = None, block_rows: int = BLOCK_ROWS, name: str = "dtw_distance",
) -> DataFrame:
    """(series, row_no, distance) per target row with a full history.

    Blocks with a halo go to the workers, so a row travels about once; windows
    of many series are warped in one call. The reference of a series rides on
    the first row of each block only.
    """
    n_features = len(features)

    def with_reference(rows: DataFrame) -> DataFrame:
        head = F.col("_own") & (F.pmod(F.col(ROW), F.lit(block_rows)) == 0)
        first = rows.filter(head)
        if series:
            first = join_keys(first, reference.select(*series, F.flatten("reference").alias("reference")), series)
        else:
            first = first.withColumn("reference", reference.select(F.flatten("reference")).scalar())
        return first.unionByName(rows.filter(~head).withColumn("reference", F.lit(None).cast("array<double>")))

    def measure(batch: Batch) -> Iterator[pa.RecordBatch]:
        given = batch.table["reference"].combine_chunks()
        has = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
        sent = given.take(pa.array(has)).to_pylist()
        place = np.full(batch.run[-1] + 1, -1)
        place[batch.run[has]] = np.arange(len(has))
        # Series without any window have no reference.
        batch.targets = batch.targets[place[batch.run[batch.targets]] >= 0]
        if not len(batch.targets):
            return
        references = np.array([np.asarray(r, dtype=float).reshape(-1, n_features) for r in sent])
        for at in range(0, len(batch.targets), _CHUNK):
            part = slice(at, at + _CHUNK)
            own = place[batch.run[batch.targets[part]]]
            yield keyed(batch, series, part, **{name: warp(batch.windows(part), references[own], band)})

    return map_windows(indexed, features, length, measure, f"{key_schema(indexed, series)}, {name} double", series, block_rows, with_reference)
