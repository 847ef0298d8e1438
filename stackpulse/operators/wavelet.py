"""Wavelet decomposition and rebuild of ordered series.

Rows travel once: each block of a series comes with the rows around it that the
filters of all levels reach, down and up again, so every level and the rebuild
run inside the block. Blocks of a batch, of many short series or of one long
one, are worked out together. Level steps mirror the signal at the ends of the
whole series, not of the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordered import BLOCK, BLOCK_ROWS, ROW, TOTAL
from .windows import run_starts

# Low-pass decomposition filter of the Daubechies wavelet with
# four vanishing moments (Daubechies 1988).
DB4 = [
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
]
TAPS = len(DB4)


def high_pass(low: Sequence[float]) -> list[float]:
    """Quadrature mirror of a low-pass filter."""
    return [(-1) ** (k + 1) * v for k, v in enumerate(reversed(low))]


def level_size(rows, level: int):
    """Number of coefficients after ``level`` halvings of a series of ``rows``."""
    for _ in range(level):
        rows = (rows + TAPS - 1) // 2
    return rows


def mirrored(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Row that a signal of ``n`` rows, mirrored at its ends, shows at ``at``.
    The image repeats every 2n positions, which matters to signals shorter than
    the filter."""
    place = at % (2 * n)
    return np.where(place < n, place, 2 * n - 1 - place)


@dataclass
class Span:
    """Values of positions ``low`` to ``low + len`` of each of several signals,
    one signal a row; what lies beyond a row's known part is not looked at."""

    low: np.ndarray   # first position, one for each signal
    values: np.ndarray  # (signals, positions)

    def take(self, at: np.ndarray) -> np.ndarray:
        return np.take_along_axis(self.values, np.clip(at - self.low[:, None], 0, self.values.shape[1] - 1), axis=1)


def step_down(span: Span, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[Span, Span]:
    """Coefficients ``low`` to ``high`` (for each signal) of the next level:
    output k is the sum over taps j of filter[j] * x[2k + 1 - j]."""
    width = int(np.max(high - low, initial=0))
    k = low[:, None] + np.arange(width)
    approx, detail = np.zeros((len(low), width)), np.zeros((len(low), width))
    for j, (a, d) in enumerate(zip(DB4, high_pass(DB4))):
        x = span.take(mirrored(2 * k + 1 - j, n[:, None]))
        approx += a * x
        detail += d * x
    return Span(low, approx), Span(low, detail)


def step_up(approx: Span, detail: Span, low: np.ndarray, high: np.ndarray) -> Span:
    """Samples ``low`` to ``high``: the sum over k of coefficient[k] * reversed
    filter[i - 2k + taps - 2], over both kinds of coefficients."""
    width = int(np.max(high - low, initial=0))
    i = low[:, None] + np.arange(width)
    out = np.zeros((len(low), width))
    back_a, back_d = np.array(DB4[::-1]), np.array(high_pass(DB4)[::-1])
    for m in range(TAPS // 2):
        k = (i + TAPS - 2) // 2 - m
        tap = i - 2 * k + TAPS - 2
        out += back_a[tap] * approx.take(k) + back_d[tap] * detail.take(k)
    return Span(low, out)


def needed(low: np.ndarray, high: np.ndarray, n: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, from the samples up: the range of coefficients that samples
    ``low`` to ``high`` depend on through decomposition and rebuild."""
    out = [(low, high)]
    for depth in range(1, level + 1):
        low, high = np.maximum((low - 1) // 2, 0), np.minimum((high + TAPS - 2) // 2 + 1, level_size(n, depth))
        out.append((low, high))
    return out


def halo(level: int) -> int:
    """Rows on either side of a block that its coefficients reach: the filter
    spans TAPS positions of each level, so 2 * TAPS * 2^level are ample."""
    return 2 * TAPS << level


def _in_spans(
    indexed: DataFrame, column: str, series: Sequence[str], level: int, block_rows: int, fn: Callable[[Span, np.ndarray, np.ndarray, np.ndarray], tuple], schema: str, zero_below: int = 0
) -> DataFrame:
    """Run ``fn`` on the spans of blocks. Each block gets the rows around it, in
    one shuffle; blocks of a batch go to one call, many short series at once."""
    reach = halo(level)
    block_rows = max(block_rows, reach)
    own = F.floor(F.col(ROW) / block_rows).cast("bigint")
    last = F.floor((F.col(TOTAL) - 1) / block_rows).cast("bigint")
    place = F.pmod(F.col(ROW), F.lit(block_rows))
    targets = F.array_compact(F.array(
        own, F.when((place < reach) & (own > 0), own - 1), F.when((place >= block_rows - reach) & (own < last), own + 1)))
    rows = indexed.filter(F.col(TOTAL) >= zero_below).select(*series, ROW, TOTAL, F.col(column).cast("double").alias("_v"), F.explode(targets).alias(BLOCK))
    rows = rows.withColumn("_run", F.xxhash64(*series, BLOCK))
    dealt = rows.repartition(*series, BLOCK).sortWithinPartitions("_run", *series, BLOCK, ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solved(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            heads = np.flatnonzero(starts)
            sizes = np.diff(np.append(heads, len(starts)))
            value, row, total, block = (table[c].to_numpy() for c in ("_v", ROW, TOTAL, BLOCK))
            # Blocks of like size are one array, padded to the longest of them.
            order = np.argsort(sizes, kind="stable")
            at = 0
            while at < len(order):
                stop = at + 1
                while stop < len(order) and sizes[order[stop]] <= 1.5 * sizes[order[at]] + 8 and (stop - at) * sizes[order[stop]] < 1 << 20:
                    stop += 1
                pick = order[at:stop]
                width = int(sizes[pick].max())
                cells = np.arange(width)[None]
                values = np.where(cells < sizes[pick, None], value[np.minimum(heads[pick, None] + cells, len(value) - 1)], np.nan)
                n = total[heads[pick]].astype(np.int64)
                low = block[heads[pick]] * block_rows
                high = np.minimum(low + block_rows, n)
                which, columns = fn(Span(row[heads[pick]].astype(np.int64), values), n, low, high)
                rows_of = pa.array(heads[pick][which])
                arrays = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (table[s].take(rows_of) for s in series)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v) for v in columns.values())], names=[*series, *columns])
                at = stop

        for batch in batches:
            if not len(batch):
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            starts = run_starts(held)
            tail = int(np.flatnonzero(starts)[-1])
            if tail:
                yield from solved(held.slice(0, tail).combine_chunks(), starts[:tail])
                held = held.slice(tail)
        if held is not None:
            held = held.combine_chunks()
            yield from solved(held, run_starts(held))

    return dealt.mapInArrow(run, schema)


def _keys(indexed: DataFrame, series: Sequence[str]) -> str:
    return "".join(f"`{s}` {indexed.schema[s].dataType.simpleString()}, " for s in series)


def _flat(low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signal and column of every position in the ranges, and the position."""
    which, col = np.nonzero(np.arange(width)[None] < (high - low)[:, None])
    return which, col, low[which] + col


def coefficients(indexed: DataFrame, column: str, series: Sequence[str] = (), level: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(series, level, row_no, approx, detail) of levels 1 to ``level``; null
    where a missing value is within reach of the filters."""
    def solve(span: Span, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        found = []
        # Coefficient k of level d belongs to the block that holds row k * 2^d,
        # or to the last block if there is none.
        owned = []
        for depth in range(1, level + 1):
            first = -(-low // (1 << depth))
            end = np.where(high >= n, level_size(n, depth), -(-high // (1 << depth)))
            owned.append((first, np.maximum(end, first)))
        # What a level asks of the one below it, from the deepest up.
        ranges: list[tuple[np.ndarray, np.ndarray]] = [owned[-1]]
        for depth in range(level - 1, 0, -1):
            below = level_size(n, depth)
            wanted = (np.maximum(2 * ranges[0][0] + 2 - TAPS, 0), np.minimum(2 * ranges[0][1] + TAPS, below))
            ranges.insert(0, (np.minimum(wanted[0], owned[depth - 1][0]), np.maximum(wanted[1], owned[depth - 1][1])))
        current = span
        for depth in range(1, level + 1):
            start, end = ranges[depth - 1]
            current, detail = step_down(current, level_size(n, depth - 1), start, end)
            first, stop = owned[depth - 1]
            which, col, at = _flat(first, stop, int(np.max(stop - first, initial=0)))
            inner = at - start[which]
            found.append((which, np.full(len(at), depth, np.int32), at, current.values[which, inner], detail.values[which, inner]))
        which, depths, at, approx, detail = (np.concatenate(x) for x in zip(*found))
        return which, {"level": depths, ROW: at, "approx": _nullable(approx), "detail": _nullable(detail)}

    return _in_spans(indexed, column, series, level, block_rows, solve, f"{_keys(indexed, series)}level int, {ROW} long, approx double, detail double")


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def smooth_span(span: Span, n: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> Span:
    """Positions ``low`` to ``high`` after all levels down and up again."""
    ranges = needed(low, high, n, level)
    # The way down needs more of each level than the way up asks for.
    wide = [ranges[level]]
    for depth in range(level - 1, 0, -1):
        wanted = np.maximum(2 * wide[0][0] + 2 - TAPS, 0), np.minimum(2 * wide[0][1] + TAPS, level_size(n, depth))
        wide.insert(0, (np.minimum(wanted[0], ranges[depth][0]), np.maximum(wanted[1], ranges[depth][1])))
    current, details = span, []
    for depth in range(1, level + 1):
        current, detail = step_down(current, level_size(n, depth - 1), *wide[depth - 1])
        details.append(detail)
    for depth in range(level, 0, -1):
        current = step_up(current, details[depth - 1], *ranges[depth - 1])
    return current


def wavelet_smooth(
    indexed: DataFrame, column: str, series: Sequence[str] = (), level: int = 3, name: str = "wavelet", zero_below: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Decompose to ``level`` and rebuild; rows (series, row_no, name).

    The coefficients are left as they are, so the output equals the input up to
    rounding. Positions within reach of a missing value give null. Series with
    fewer than ``zero_below`` rows give 0; none do by default. All levels and the
    rebuild run inside a block, whose halo holds all that they reach.
    """
    def solve(span: Span, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        out = smooth_span(span, n, low, high, level)
        which, col, at = _flat(low, high, out.values.shape[1])
        return which, {ROW: at, name: _nullable(out.values[which, col])}

    waves = _in_spans(indexed, column, series, level, block_rows, solve, f"{_keys(indexed, series)}{ROW} long, {name} double", zero_below)
    if not zero_below:
        return waves
    return waves.unionByName(indexed.filter(F.col(TOTAL) < zero_below).select(*series, ROW, F.lit(0.0).alias(name)))
