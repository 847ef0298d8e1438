"""Features and scores of series that arrive in pieces.

One keyed state a series carries what the next piece needs: the rows that the
lags, rolling sums and wavelet filters still reach, open gaps, the last window
of kept rows and the first one. A row comes out once, as soon as no later row
can change it, so the output over all pieces equals the batch job on the whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import series as ops, wavelet
from ..operators.forest import IsolationForest, forest_scores, packed
from ..operators.ordered import ROW
from ..operators.quantiles import quantile
from ..operators.warping import warp
from ..operators.windows import WindowAxes, window_scores
from ..session import scratch_path

CLOSED = "closed"
VALUES = ["current", "voltage"]
LEVEL = 3
# Stands for the unknown length of a series that goes on.
OPEN_END = 1 << 40
_WINDOWS_AT_ONCE = 512
_STATE = "taken long, given long, kept long, held binary, tail binary, reference binary"


@dataclass
class SeriesScorer:
    """What scoring needs besides the history of a series. The cuts are those of
    the training windows, because no quantile of a stream is known in time."""

    scale: dict[str, tuple[float, float]]
    axes: WindowAxes
    forest: IsolationForest
    length: int
    recon_cut: float
    dtw_cut: float


def stored_scorer(model, windows: DataFrame, p: float = 0.9) -> SeriesScorer:
    """Scorer of a fitted ``SeriesModel`` with the p-quantiles of the errors and
    distances of its training ``windows``."""
    cuts = [quantile(windows, c, p) for c in ("recon_error", "dtw_distance")]
    if None in cuts:
        raise ValueError("no training window")
    return SeriesScorer(model.scale, model.axes, model.forest, model.length, *map(float, cuts))


@dataclass
class History:
    """State of one series. ``held`` are the columns of rows from position
    ``taken - len(held)`` on, gaps open at their end; ``given`` rows have come
    out, ``kept`` of them with all features. Columns are plain arrays, because
    most pieces are small and a table costs more than what is done with it."""

    taken: int
    given: int
    kept: int
    held: dict[str, np.ndarray]
    tail: np.ndarray
    reference: np.ndarray

    @classmethod
    def read(cls, state: GroupState, empty: dict[str, np.ndarray]) -> "History":
        if not state.exists:
            none = np.zeros((0, len(ops.FEATURES)))
            return cls(0, 0, 0, empty, none, none)
        taken, given, kept, held, tail, reference = state.get
        rows = {name: _plain(column) for name, column in zip(empty, pa.ipc.open_stream(held).read_all().select(list(empty)).columns)}
        tail, reference = (np.frombuffer(b, float).reshape(-1, len(ops.FEATURES)) for b in (tail, reference))
        return cls(taken, given, kept, rows, tail, reference)

    def write(self, state: GroupState) -> None:
        table = pa.table({c: pa.array(v, from_pandas=v.dtype == object) for c, v in self.held.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((self.taken, self.given, self.kept, sink.getvalue().to_pybytes(), self.tail.tobytes(), self.reference.tobytes()))


def _plain(column: pa.ChunkedArray) -> np.ndarray:
    kind = column.type
    if pa.types.is_timestamp(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy()
    return column.to_pandas().to_numpy()


def in_order(rows: dict[str, np.ndarray], order: Sequence[str]) -> np.ndarray:
    """Places of the rows sorted, equal ones as they came, missing values last."""
    values = [rows[c] for c in order]
    if any(v.dtype == object for v in values):
        return pd.DataFrame({c: rows[c] for c in order}).sort_values(list(order), kind="stable").index.to_numpy()
    return np.lexsort(values[::-1])


def not_after(rows: dict[str, np.ndarray], held: dict[str, np.ndarray], order: Sequence[str]) -> np.ndarray:
    """Rows whose order is not behind that of the last of ``held``."""
    n = len(rows[order[0]])
    before, equal = np.zeros(n, bool), np.ones(n, bool)
    for c in order:
        value, last = rows[c], held[c][-1]
        if value.dtype == object or held[c].dtype == object:
            value = pd.Series(value)
        before |= equal & np.asarray(value < last)
        equal &= np.asarray(value == last)
    return before | equal


def fill_known(values: np.ndarray, closed: bool) -> tuple[np.ndarray, int]:
    """(values with gaps on the line between their neighbours, how many of them
    are final). Missing values at the head stay; those at the end wait for the
    next value, or take the last one when the series is closed."""
    known = np.flatnonzero(~np.isnan(values))
    if not len(known):
        return values, len(values)
    at = np.arange(known[0], known[-1] + 1)
    out = values.copy()
    right = known[np.searchsorted(known, at)]
    left = known[np.searchsorted(known, at, side="right") - 1]
    share = (values[right] - values[left]) * (at - left) / np.maximum(right - left, 1)
    out[at] = np.where(left == right, values[at], values[left] + share)
    if closed:
        out[known[-1]:] = values[known[-1]]
        return out, len(values)
    return out, int(known[-1]) + 1


def features_of(filled: dict[str, np.ndarray], start: int, low: int, high: int, total: int, size: int) -> dict[str, np.ndarray]:
    """Features of positions ``low`` to ``high``; ``filled`` begins at position
    ``start``, far enough before ``low`` or at the head of the series."""
    current, voltage = filled["current"], filled["voltage"]
    at = np.arange(low, high) - start

    def back(x: np.ndarray, n: int) -> np.ndarray:
        return np.where(at >= n, x[np.maximum(at - n, 0)], np.nan)

    frames = np.stack([back(current, n) for n in range(size - 1, -1, -1)])
    span = wavelet.Span(np.array([start]), current[None])
    wave = wavelet.smooth_span(span, np.array([total]), np.array([low]), np.array([high]), LEVEL).values[0]
    return {
        "current": current[at], "voltage": voltage[at], "current_lag1": back(current, 1), "current_lag2": back(current, 2),
        "voltage_lag1": back(voltage, 1), "current_rolling_mean": frames.mean(axis=0),
        "current_rolling_std": frames.std(axis=0, ddof=1), "wavelet_current": wave,
    }


def scaled_features(rows: dict[str, np.ndarray], scale: dict[str, tuple[float, float]]) -> np.ndarray:
    """Features as the detectors see them: not finite ones as zero, then scaled."""
    x = np.stack([rows[c] for c in ops.FEATURES], axis=1)
    x = np.where(np.isfinite(x), x, 0.0)
    for j, c in enumerate(ops.FEATURES):
        if c in scale:
            x[:, j] = (x[:, j] - scale[c][0]) / scale[c][1]
    return x


def score_windows(history: History, x: np.ndarray, length: int, axes: WindowAxes) -> tuple[np.ndarray, np.ndarray]:
    """Reconstruction error and warping distance to the first window of the
    series, of the ``length`` kept rows before each row of ``x``; missing
    without a full window. The history moves on."""
    rows = np.concatenate([history.tail, x])
    first = history.kept - len(history.tail)
    if len(history.reference) < length:
        history.reference = np.concatenate([history.reference, x])[:length]
    recon, dtw = np.full(len(x), np.nan), np.full(len(x), np.nan)
    targets = np.flatnonzero(history.kept + np.arange(len(x)) >= length)
    for part in (targets[a:a + _WINDOWS_AT_ONCE] for a in range(0, len(targets), _WINDOWS_AT_ONCE)):
        ends = history.kept + part - first
        windows = rows[ends[:, None] + np.arange(-length, 0)]
        recon[part] = window_scores(windows.reshape(len(part), -1), axes)
        dtw[part] = warp(windows, history.reference)
    history.tail = rows[-length:]
    return recon, dtw


def stream_series(
    rows: DataFrame, order: Sequence[str], series: Sequence[str], size: int = 10, scorer: SeriesScorer | None = None
) -> DataFrame:
    """Features of a stream of rows (series, order, current, voltage, closed).

    Gives series, order, ``late``, ``source_row``, ``row_no``, current and
    FEATURES of the rows that have them all, as ``series_features`` does for a
    whole table, and with a scorer the scores and their vote. The rows of one
    series in one trigger are put in order; a row that comes in a later trigger
    but is not behind what the series had by then is ``late`` and comes out at
    once without features. A row whose ``closed`` is true has no values; it ends
    its series, which lets the last rows out and drops the state. Rows after
    that begin the series anew. NaN counts as missing.

    The state of a series holds the rows within reach of the wavelet filters on
    both sides, and the rows of a gap that is still open. One call holds what
    came of one series in one trigger, which the limits of the source bound.
    """
    reach = max(wavelet.halo(LEVEL), size - 1, 2)
    keys = [rows.schema[c] for c in series]
    numbers = ["source_row", ROW]
    doubles = ["current", *ops.FEATURES] + (["recon_error", "dtw_distance"] if scorer else [])
    schema = T.StructType([
        *keys, *[rows.schema[c] for c in order], T.StructField("late", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in numbers],
        *[T.StructField(c, T.DoubleType()) for c in doubles], *([T.StructField("iso_anomaly", T.BooleanType())] if scorer else [])])
    # What the tasks need; the nodes of a forest are bounded by its sample.
    scale, axes, length = (scorer.scale, scorer.axes, scorer.length) if scorer else ({}, None, 0)
    trees, psi, iso_cut = (packed(scorer.forest.tables()), scorer.forest.psi, scorer.forest.threshold) if scorer else ([], 0, None)
    if scorer and iso_cut is None:
        raise ValueError("fit a threshold first")

    def run(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        came = list(pieces)
        table = came[0] if len(came) == 1 else pd.concat(came, ignore_index=True)
        ends = table[CLOSED].to_numpy()
        if ends.dtype == object:
            ends = table[CLOSED].fillna(False).astype(bool).to_numpy()
        closed = bool(ends.any())
        new = {c: table[c].to_numpy() for c in (*order, *VALUES)}
        if closed:
            new = {c: v[~ends] for c, v in new.items()}
        at = in_order(new, order)
        new = {c: v[at] for c, v in new.items()}
        history = History.read(state, {c: v[:0] for c, v in new.items()})

        def keyed(n: int) -> dict[str, pd.Series]:
            return {name: pd.Series([value] * n, dtype=object if value is None else None) for name, value in zip(series, key)}

        if len(history.held[VALUES[0]]):
            late = not_after(new, history.held, order)
            if late.any():
                gone = pd.DataFrame({**keyed(int(late.sum())), **{c: new[c][late] for c in order}}).assign(late=True)
                gone = gone.assign(**{c: pd.array([None] * len(gone), dtype="Int64") for c in numbers})
                yield gone.reindex(columns=schema.names)
                new = {c: v[~late] for c, v in new.items()}
            held = {c: np.concatenate([v, new[c]]) for c, v in history.held.items()}
        else:
            held = new
        start = history.taken - len(history.held[VALUES[0]])
        history.taken += len(new[VALUES[0]])
        filled, final = {}, len(held[VALUES[0]])
        for c in VALUES:
            filled[c], upto = fill_known(np.asarray(held[c], float), closed)
            final = min(final, upto)
        end = start + final
        high = end if closed else max(history.given, end - reach)
        if high > history.given:
            total = end if closed else OPEN_END
            columns = features_of({c: v[:final] for c, v in filled.items()}, start, history.given, high, total, size)
            whole = ~np.isnan(np.stack([columns[c] for c in ("current", *ops.FEATURES)])).any(axis=0)
            out = {**{c: held[c][history.given - start:high - start][whole] for c in order}, **{c: v[whole] for c, v in columns.items()}}
            n = int(whole.sum())
            out |= {"late": np.zeros(n, bool), "source_row": np.arange(history.given, high)[whole], ROW: history.kept + np.arange(n)}
            if axes is not None and n:
                x = scaled_features(out, scale)
                out["recon_error"], out["dtw_distance"] = score_windows(history, x, length, axes)
                out["iso_anomaly"] = forest_scores(x, trees, psi) > iso_cut
            history.kept += n
            history.given = high
            if n:
                yield pd.DataFrame({**keyed(n), **out}, columns=schema.names)
        if closed:
            if state.exists:
                state.remove()
        else:
            # Filled values of a closed gap are kept, so that its far end may go.
            history.held = {c: filled.get(c, v)[max(history.given - reach, start) - start:] for c, v in held.items()}
            history.write(state)

    table = rows.select(*series, *order, *[F.col(c).cast("double").alias(c) for c in VALUES], CLOSED)
    out = table.groupBy(*series).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
    if scorer is None:
        return out
    out = out.withColumns({"recon_anomaly": F.col("recon_error") > scorer.recon_cut, "dtw_anomaly": F.col("dtw_distance") > scorer.dtw_cut})
    return ops.vote(out, ["recon_anomaly", "dtw_anomaly", "iso_anomaly"])


def score_series(
    spark: SparkSession, source: str, schema: T.StructType, order: Sequence[str], series: Sequence[str], sink: str, checkpoint: str | None = None,
    scorer: SeriesScorer | None = None, size: int = 10, fmt: str = "parquet", max_files: int | None = None,
) -> StreamingQuery:
    """Run ``stream_series`` over the files that are new in ``source`` and append
    its rows to ``sink``. With the same ``checkpoint`` the next run goes on with
    the history that this one leaves."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    out = stream_series(reader.load(source), order, series, size, scorer)
    return (
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint or scratch_path(spark, "stream"))
        .trigger(availableNow=True).start(sink)
    )
