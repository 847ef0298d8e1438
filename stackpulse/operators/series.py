"""Feature table of a current / voltage series and work on its windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import euclidean, mean_squared_error
from ..session import materialise
from .ordered import (
    BLOCK_ROWS, ROW, SLICE, TOTAL, fill_gaps, header_window, in_blocks, index_rows, join_keys, rolling_columns, with_headers,
)
from .quantiles import quantile
from .wavelet import wavelet_smooth

FEATURES = [
    "voltage", "current_lag1", "current_lag2", "voltage_lag1",
    "current_rolling_mean", "current_rolling_std", "wavelet_current",
]
LENGTH = 30
_RUN = "_run"


def series_features(
    df: DataFrame, order: Sequence[str], series: Sequence[str] = (), size: int = 10, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Gap filling, lags, rolling statistics and wavelet; incomplete rows are
    dropped and the rest renumbered.

    Keeps ``row_no`` and ``series_rows`` of the kept rows; ``source_row`` is the
    position in the input. ``power`` is dropped when it is there.
    """
    indexed = index_rows(df.drop("power"), order, series)
    # Read twice: by the frames here and by the wavelet.
    filled = materialise(fill_gaps(indexed, ["current", "voltage"], series), "filled")

    def build(w: Window) -> dict[str, Column]:
        return {
            "current_lag1": F.lag("current", 1).over(w),
            "current_lag2": F.lag("current", 2).over(w),
            "voltage_lag1": F.lag("voltage", 1).over(w),
            **rolling_columns("current", w, size),
        }

    table = in_blocks(filled, None, size - 1, series, block_rows, build)
    wave = wavelet_smooth(filled, "current", series, name="wavelet_current")
    table = join_keys(table, wave, [*series, ROW])
    table = table.na.drop(subset=["current", *FEATURES])
    return renumber(table, series)


def renumber(kept: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """New positions after rows were dropped, without another global sort.

    Slices keep their order, so a count per (series, slice) gives the offset of
    each slice.
    """
    keys = [*series, SLICE]
    counts = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*(series or [F.lit(0)]))
    prior = every.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"), F.sum("_n").over(every).alias("_len"))
    w = header_window(keys, [ROW]).rowsBetween(Window.unboundedPreceding, 0)
    # The header counts as the first row of its slice.
    out = with_headers(kept.drop(TOTAL), offsets).withColumns({
        "_new": F.count(F.lit(1)).over(w) - 2 + F.first("_off").over(w), TOTAL: F.first("_len").over(w),
    }).filter(~F.col("_head"))
    return out.withColumnRenamed(ROW, "source_row").withColumn(ROW, F.col("_new").cast("bigint")).drop(
        "_head", "_off", "_len", "_new")


def reference_window(
    indexed: DataFrame, features: Sequence[str], length: int = LENGTH, windows: int | None = None,
    series: Sequence[str] = (), first: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Elementwise median of the windows of each series: of all of them, of the
    first ``windows`` if given, or of window 0 with ``first``. One row per
    series with ``reference`` as array<array<double>>; missing values do not
    count.

    The values at one element are those of all rows under the windows but for
    ``length`` rows at the ends. So every wanted median lies among the few
    middle ranks, and only these rows and those at the ends meet in one group.
    Series of up to ``block_rows`` such rows are ordered in Arrow batches of many
    series; ranks of longer ones come from range-partitioned slices, however long
    a series is.
    """
    windows = 1 if first else windows
    rows = F.col(TOTAL) if windows is None else F.least(F.col(TOTAL), F.lit(windows + length))
    base = indexed.filter((F.col(TOTAL) > length) & (F.col(ROW) < rows)).withColumn("rows", rows)
    run, values = F.xxhash64(*series, F.lit(0)).alias(_RUN), [F.col(f).cast("double") for f in features]
    short = base.filter(F.col("rows") <= block_rows).select(run, *series, F.col(ROW).alias("at"), "rows", *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    long = base.filter(F.col("rows") > block_rows).select(*series, F.col(ROW).alias("at"), "rows", F.posexplode(F.array(*values)).alias("feature", "value"))
    ranked = index_rows(long.filter("value is not null"), ["value", "at"], [*series, "feature"])
    few = ranked.select(run, *series, "at", "rows", "feature", "value", F.col(ROW).alias("rank"), F.col(TOTAL).alias("known")).filter(
        _wanted(F.col("at"), F.col("rows"), F.col("rank"), F.col("known"), length))
    schema = ", ".join([*[f"`{s}` {indexed.schema[s].dataType.simpleString()}" for s in series], "reference array<array<double>>"])
    width = len(features)

    def listed(table: pa.Table, heads: np.ndarray, middles: np.ndarray) -> pa.RecordBatch:
        n = len(heads)
        inner = pa.ListArray.from_arrays(pa.array(np.arange(n * length + 1, dtype=np.int32) * width), pa.array(middles.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * length), inner)
        keys = table.select(list(series)).take(pa.array(heads)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.chunk(0) if n else pa.array([], c.type) for c in keys.columns), lists], names=[*series, "reference"])

    def from_ranks(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(starts)
        middles = np.full((len(heads), length, width), np.nan)
        owner, feature = np.cumsum(starts) - 1, table["feature"].to_numpy()
        first = np.flatnonzero(starts | np.concatenate([[True], feature[1:] != feature[:-1]]))
        middles[owner[first], :, feature[first]] = _medians(first, *(table[c].to_numpy() for c in ("at", "rank", "value", "rows", "known")), length)
        return listed(table, heads, middles)

    def from_rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(starts)
        middles, seen = np.full((len(heads), length, width), np.nan), np.zeros(len(heads), bool)
        owner, at, n_rows = np.cumsum(starts) - 1, table["at"].to_numpy(), table["rows"].to_numpy()
        for f in range(width):
            column = table[f"_v{f}"].combine_chunks()
            given = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            value = column.to_numpy(zero_copy_only=False)
            order = given[np.lexsort((at[given], value[given], owner[given]))]
            known = np.bincount(owner[given], minlength=len(heads))
            rank = np.arange(len(order)) - (np.cumsum(known) - known)[owner[order]]
            wanted = _wanted(at[order], n_rows[order], rank, known[owner[order]], length)
            order, rank = order[wanted], rank[wanted]
            if len(order):
                first = np.flatnonzero(np.diff(owner[order], prepend=-1))
                group = owner[order[first]]
                middles[group, :, f] = _medians(first, at[order], rank, value[order], n_rows[order], known[owner[order]], length)
                seen[group] = True
        return listed(table, heads[seen], middles[seen])

    def by_series(table: DataFrame, order: Sequence[str], build) -> DataFrame:
        dealt = table.repartition(*series) if series else table.repartition(1)
        return dealt.sortWithinPartitions(_RUN, *series, *order).mapInArrow(_whole_series(build, order), schema)

    return by_series(short, ["at"], from_rows).unionByName(by_series(few, ["feature", "rank"], from_ranks))


def _wanted(at, rows, rank, known, length: int):
    """Whether a value is near the middle rank or its row near an end: of columns
    and of arrays."""
    off, most = 2 * rank - known, 2 * (length + 2)
    return ((off <= most) & (off >= -most)) | (at < length) | (at >= rows - length)


def _whole_series(build: Callable[[pa.Table, np.ndarray], pa.RecordBatch], order: Sequence[str]):
    """Run ``build`` on batches of whole series, with the first rows marked."""
    def starts_of(table: pa.Table) -> np.ndarray:
        run, keys = table[_RUN].to_numpy(), [table[c].to_numpy() for c in order]
        # Two series of one hash still begin anew in the order.
        same, later = run[1:] == run[:-1], np.zeros(len(run) - 1, bool)
        for key in reversed(keys):
            later = (key[1:] > key[:-1]) | ((key[1:] == key[:-1]) & later)
        return np.concatenate([[True], ~(same & later)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            starts = starts_of(held)
            last = int(np.flatnonzero(starts)[-1])
            if last:
                yield build(held.slice(0, last).combine_chunks(), starts[:last])
                held = held.slice(last)
        if held is not None:
            held = held.combine_chunks()
            yield build(held, starts_of(held))

    return run


def _medians(first: np.ndarray, at: np.ndarray, rank: np.ndarray, value: np.ndarray, rows: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """(group, element): medians of the values at each element of the windows, for
    groups of rows in order of rank that begin at ``first``."""
    size = np.diff(np.concatenate([first, [len(at)]]))
    out = np.full((len(first), length), np.nan)
    for e in range(length):
        gone = (at < e) | (at >= rows - length + e)
        before = np.cumsum(gone) - gone
        place = rank - (before - np.repeat(before[first], size))
        n = known[first] - np.add.reduceat(gone.astype(np.int64), first)
        low, high = (np.repeat(np.where(n > 0, x, -1), size) for x in ((n - 1) // 2, n // 2))
        sides = []
        for wanted in (low, high):
            hit = np.flatnonzero(~gone & (place == wanted))
            side = np.full(len(first), np.nan)
            side[np.searchsorted(first, hit, "right") - 1] = value[hit]
            sides.append(side)
        out[:, e] = (sides[0] + sides[1]) / 2
    return out


def attach_reference(windows: DataFrame, reference: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Put the reference beside every window: a join per series, or a scalar
    subquery when there is one series."""
    if series:
        return join_keys(windows, reference, series, "inner")
    return windows.withColumn("reference", reference.select("reference").scalar())


def window_distance(windows: DataFrame, window: str = "window", reference: str = "reference", name: str = "distance") -> DataFrame:
    """Plain Euclidean distance of a window to its reference."""
    return windows.withColumn(name, euclidean(F.flatten(window), F.flatten(reference)))


def window_mse(windows: DataFrame, left: str, right: str, name: str = "mse") -> DataFrame:
    """Mean squared error over all elements of two windows."""
    return windows.withColumn(name, mean_squared_error(F.flatten(left), F.flatten(right)))


def percentile_flag(df: DataFrame, column: str, name: str, p: float = 0.9, **options) -> DataFrame:
    """True where the value exceeds the p-quantile of the whole column."""
    cut = quantile(df, column, p, **options)
    return df.withColumn(name, F.coalesce(F.col(column) > F.lit(cut).cast("double"), F.lit(False)))


def vote(df: DataFrame, flags: Sequence[str], name: str = "anomaly") -> DataFrame:
    """True where every detector says so."""
    all_of = F.lit(True)
    for flag in flags:
        all_of = all_of & F.coalesce(F.col(flag), F.lit(False))
    return df.withColumn(name, all_of)


def vote_summary(df: DataFrame, flag: str = "anomaly") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(flag)).alias("anomalies"),
        F.coalesce(F.try_divide(F.count_if(F.col(flag)) * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("anomaly_percentage"),
    )


def flag_rows(indexed: DataFrame, flagged: DataFrame, series: Sequence[str] = (), flag: str = "anomaly") -> DataFrame:
    """Write window verdicts back to their target rows as 0 / 1."""
    hits = flagged.filter(F.col(flag)).select(*series, ROW, F.lit(1).alias(flag))
    out = join_keys(indexed.drop(flag), hits, [*series, ROW])
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))
