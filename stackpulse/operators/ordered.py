"""Ordered series: running index, blocks with halo, lags, rolling, gap filling.

A series may hold a third of all rows, so no step puts a whole series into one
task. Rows are range-partitioned on (series, order key), which cuts a long
series into balanced slices; the slices are pinned in a table; running totals
within a slice plus the totals of the slices before it give positions. Frames
of a fixed length then run in blocks of ``block_rows`` rows that also receive
the last few rows of the block before (the halo).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

BLOCK_ROWS = 4096
SLICE, ROW, TOTAL, BLOCK = "_slice", "row_no", "series_rows", "_block"


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that also matches null keys; ``right`` keeps no key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_headers(rows: DataFrame, per_slice: DataFrame) -> DataFrame:
    """Put one header row per (series, slice) in front of its rows.

    A window over the slice then reads the header's columns as its first
    values, so figures per slice arrive in the shuffle that the window needs
    anyway and no join moves the rows again. ``_head`` marks headers.
    """
    return rows.withColumn("_head", F.lit(False)).unionByName(
        per_slice.withColumn("_head", F.lit(True)), allowMissingColumns=True)


def header_window(keys: Sequence[str], order: Sequence[str]):
    """Window over a slice, header first."""
    return Window.partitionBy(*keys).orderBy(F.desc("_head"), *order)


def slices(df: DataFrame, order: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Range-partition on (series, order) and pin the slice number of each row."""
    ranged = df.repartitionByRange(*series, *order).withColumn(SLICE, F.spark_partition_id())
    return materialise(ranged, "slices")


def running_totals(
    sliced: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, Column],
    series: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Running sums over whole series of a sliced table.

    The second step handles one row per (series, slice).
    """
    keys = [*series, SLICE]
    sums = sliced.groupBy(*keys).agg(*[F.sum(e).alias(f"_s_{n}") for n, e in totals.items()])
    before = Window.partitionBy(*(series or [F.lit(0)])).orderBy(SLICE)
    prior = before.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(series or [F.lit(0)]))
    offsets = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in totals],
        *[F.sum(f"_s_{n}").over(whole).alias(f"_t_{n}") for n in totals],
    )
    w = header_window(keys, order)
    head = w.rowsBetween(Window.unboundedPreceding, 0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    added = {}
    for n, e in totals.items():
        own = F.sum(F.when(~F.col("_head"), e)).over(upto)
        added[n] = F.coalesce(own, F.lit(0)) + F.first(f"_o_{n}").over(head)
        added[f"_t_{n}"] = F.first(f"_t_{n}").over(head)
    out = with_headers(sliced, offsets).withColumns(added)
    return out.filter(~F.col("_head")).drop("_head", *[f"_o_{n}" for n in totals])


def index_rows(df: DataFrame, order: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Add ``row_no`` (0-based, by ``order`` within ``series``), ``series_rows``
    (the length of the series) and the slice number.

    ``order`` must be unique within a series.
    """
    sliced = slices(df, order, series)
    out = running_totals(sliced, order, {ROW: F.lit(1).cast("bigint")}, series, inclusive=False)
    return out.withColumnRenamed(f"_t_{ROW}", TOTAL)


def with_halo(indexed: DataFrame, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Copy the last ``halo`` rows of each block into the next one."""
    if block_rows < halo:
        raise ValueError("a block must be at least as long as the halo")
    block = F.floor(F.col(ROW) / block_rows).cast("bigint")
    near_end = F.pmod(F.col(ROW), F.lit(block_rows)) >= block_rows - halo
    targets = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    return indexed.withColumn(BLOCK, F.explode(targets)).withColumn("_own", F.col(BLOCK) == block)


def in_blocks(
    indexed: DataFrame,
    columns: Mapping[str, Column] | None,
    halo: int,
    series: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    build=None,
) -> DataFrame:
    """Add window columns computed per block.

    ``build(window)`` gets the window ordered by position and returns the
    columns; frames may look back at most ``halo`` rows.
    """
    w = Window.partitionBy(*series, BLOCK).orderBy(ROW)
    exprs = dict(columns or {})
    if build is not None:
        exprs.update(build(w))
    return with_halo(indexed, halo, block_rows).withColumns(exprs).filter("_own").drop("_own", BLOCK)


def lags(indexed: DataFrame, column: str, steps: Sequence[int], series: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    return in_blocks(
        indexed, None, max(steps), series, block_rows,
        lambda w: {f"{column}_lag{n}": F.lag(column, n).over(w) for n in steps},
    )


def rolling_columns(column: str, w, size: int = 10) -> dict[str, Column]:
    """Rolling mean and sample deviation, null until ``size`` values are there."""
    frame = w.rowsBetween(-(size - 1), 0)
    full = F.count(column).over(frame) == size
    return {
        f"{column}_rolling_mean": F.when(full, F.avg(column).over(frame)),
        f"{column}_rolling_std": F.when(full, F.stddev_samp(column).over(frame)),
    }


def rolling(indexed: DataFrame, column: str, size: int = 10, series: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    return in_blocks(indexed, None, size - 1, series, block_rows, lambda w: rolling_columns(column, w, size))


def fill_gaps(indexed: DataFrame, columns: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation by row position.

    Leading nulls stay; trailing nulls take the last value. Each slice looks
    inside itself; the nearest values beyond its ends come from a table of one
    row per (series, slice).
    """
    keys = [*series, SLICE]
    point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(ROW).alias("at"), F.col(c).cast("double").alias("v"))) for c in columns}
    ends = indexed.groupBy(*keys).agg(
        *[F.max(point[c]).alias(f"_last_{c}") for c in columns],
        *[F.min(point[c]).alias(f"_first_{c}") for c in columns],
    )
    order = Window.partitionBy(*(series or [F.lit(0)])).orderBy(SLICE)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*(series or [F.lit(0)])).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys,
        *[F.max(f"_last_{c}").over(earlier).alias(f"_in_{c}") for c in columns],
        *[F.min(f"_first_{c}").over(later).alias(f"_out_{c}") for c in columns],
    )
    w = header_window(keys, [ROW])
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, because a frame that only grows takes one pass.
    ahead = Window.partitionBy(*keys).orderBy("_head", F.desc(ROW)).rowsBetween(Window.unboundedPreceding, 0)
    out = with_headers(indexed, carry).withColumns({
        **{f"_b_{c}": F.last(point[c], ignorenulls=True).over(back) for c in columns},
        **{f"_a_{c}": F.last(point[c], ignorenulls=True).over(ahead) for c in columns},
        **{f"_in_{c}": F.first(f"_in_{c}").over(back) for c in columns},
        **{f"_out_{c}": F.first(f"_out_{c}").over(back) for c in columns},
    }).filter(~F.col("_head"))
    filled = {}
    for c in columns:
        left = F.coalesce(F.col(f"_b_{c}"), F.col(f"_in_{c}"))
        right = F.coalesce(F.col(f"_a_{c}"), F.col(f"_out_{c}"))
        step = (right["v"] - left["v"]) * (F.col(ROW) - left["at"]) / (right["at"] - left["at"])
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(left.isNull(), F.lit(None).cast("double"))
            .when(right.isNull(), left["v"])
            .otherwise(left["v"] + step)
        )
    helpers = [f"{p}{c}" for c in columns for p in ("_b_", "_a_", "_in_", "_out_")]
    return out.withColumns(filled).drop("_head", *helpers)


def chronological_split(indexed: DataFrame, fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First int(fraction * n) rows of each series against the rest."""
    cut = F.floor(F.col(TOTAL) * F.lit(fraction))
    return indexed.filter(F.col(ROW) < cut), indexed.filter(F.col(ROW) >= cut)


def sequences(
    indexed: DataFrame,
    features: Sequence[str],
    length: int = 30,
    series: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    name: str = "window",
) -> DataFrame:
    """Sliding sequences of the ``length`` rows before each target row.

    ``window`` is array<array<double>> (positions x features); target rows
    without a full history are left out.
    """
    row = F.array(*[F.col(f).cast("double") for f in features])
    out = in_blocks(
        indexed, None, length, series, block_rows,
        lambda w: {name: F.collect_list(row).over(w.rowsBetween(-length, -1))},
    )
    return out.filter(F.size(name) == length)
