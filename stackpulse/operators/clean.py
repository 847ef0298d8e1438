"""Repair, clipping, filtering and row guards.

Statistics are one-row aggregates that are attached as scalar subqueries, so a
repair is one extra pruned scan and a projection, without any join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip, id_hash
from .quantiles import quantiles

_STATS = "_stats"


def attach_stats(df: DataFrame, stats: Mapping[str, Column], over: DataFrame | None = None) -> DataFrame:
    """Add one struct column ``_stats`` holding aggregates of ``over``."""
    source = df if over is None else over
    one = source.agg(F.struct(*[e.alias(k) for k, e in stats.items()]).alias("s"))
    return df.withColumn(_STATS, one.scalar())


def _stat(name: str) -> Column:
    return F.col(f"{_STATS}.`{name}`")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns else None)


def fill_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = attach_stats(df, {c: F.avg(c) for c in columns})
    return out.withColumns({c: F.coalesce(F.col(c), _stat(c)) for c in columns}).drop(_STATS)


def fill_stored(df: DataFrame, means: Mapping[str, float]) -> DataFrame:
    """Fill nulls from statistics kept with a model."""
    return df.na.fill({c: float(v) for c, v in means.items()})


def stored_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One-row table of training means, to be written beside the model."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def zero_to_mean(df: DataFrame, columns: Sequence[str], nonzero: bool = False) -> DataFrame:
    """Replace 0 by the column mean.

    With ``nonzero`` the mean is over non-zero rows, nulls are filled too, and
    a column without such rows gives 0. Otherwise the mean includes the zeros.
    """
    return _replace_zero(df, columns, F.avg, nonzero)


def zero_to_median(df: DataFrame, columns: Sequence[str], nonzero: bool = False) -> DataFrame:
    """Replace 0 by the exact column median, in the same two modes."""
    base = df.select(*[
        (F.when(F.col(c) != 0, F.col(c)) if nonzero else F.col(c)).alias(c) for c in columns
    ])
    medians = {c: v[0] for c, v in quantiles(base, {c: [0.5] for c in columns}).items()}
    return df.withColumns({
        c: _zero_replaced(c, F.lit(medians[c]).cast("double"), nonzero) for c in columns
    })


def _zero_replaced(c: str, value: Column, nonzero: bool) -> Column:
    if nonzero:
        value = F.coalesce(value, F.lit(0.0))
        return F.when(F.col(c).isNull() | (F.col(c) == 0), value).otherwise(F.col(c))
    return F.when(F.col(c) == 0, value).otherwise(F.col(c))


def _replace_zero(df: DataFrame, columns: Sequence[str], stat, nonzero: bool) -> DataFrame:
    pick = (lambda c: F.when(F.col(c) != 0, F.col(c))) if nonzero else F.col
    out = attach_stats(df, {c: stat(pick(c)) for c in columns})
    return out.withColumns({c: _zero_replaced(c, _stat(c), nonzero) for c in columns}).drop(_STATS)


def quantile_bounds(
    df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, **options
) -> dict[str, tuple[float, float]]:
    return {c: (q[0], q[1]) for c, q in quantiles(df, {c: [low, high] for c in columns}, **options).items()}


def iqr_bounds(df: DataFrame, columns: Sequence[str], width: float = 1.5, **options) -> dict[str, tuple[float, float]]:
    out = {}
    for c, (q1, q3) in quantiles(df, {c: [0.25, 0.75] for c in columns}, **options).items():
        out[c] = (None, None) if q1 is None else (q1 - width * (q3 - q1), q3 + width * (q3 - q1))
    return out


def apply_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: clip(F.col(c), float(lo), float(hi)) for c, (lo, hi) in bounds.items() if lo is not None
    })


def winsorise_quantile(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, **options) -> DataFrame:
    return apply_bounds(df, quantile_bounds(df, columns, low, high, **options))


def winsorise_iqr(df: DataFrame, columns: Sequence[str], width: float = 1.5, **options) -> DataFrame:
    return apply_bounds(df, iqr_bounds(df, columns, width, **options))


def zscore_filter(df: DataFrame, columns: Sequence[str], limit: float = 3.0, over: DataFrame | None = None) -> DataFrame:
    """Keep rows whose every |z| is below ``limit`` (population deviation), by
    the mean and deviation of ``over`` if it is given.

    Columns without spread say nothing about outliers and are skipped.
    """
    stats = {}
    for c in columns:
        stats[f"{c}_m"], stats[f"{c}_s"] = F.avg(c), F.stddev_pop(c)
    keep = F.lit(True)
    for c in columns:
        m, s = _stat(f"{c}_m"), _stat(f"{c}_s")
        keep = keep & ((s == 0) | F.coalesce(F.abs(F.try_divide(F.col(c) - m, s)) < limit, F.lit(False)))
    return attach_stats(df, stats, over).filter(keep).drop(_STATS)


def split_noise(df: DataFrame, label: str = "Cluster") -> tuple[DataFrame, DataFrame]:
    """(normal rows, noise rows)."""
    return df.filter(F.col(label) != -1), df.filter(F.col(label) == -1)


def membership_flag(df: DataFrame, marked: DataFrame, keys: Sequence[str], name: str = "is_anomaly") -> DataFrame:
    marks = marked.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def sample_rows(df: DataFrame, fraction: float, seed: int, key: str | None = None) -> DataFrame:
    """Seeded row sample; with ``key`` it depends on the row's id alone."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.filter(F.pmod(id_hash(F.col(key), seed), F.lit(10_000)) < int(round(fraction * 10_000)))


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row per rule: field, low, high, number of values outside."""
    flags = df.agg(*[
        F.count_if(~F.col(c).between(lo, hi)).alias(c) for c, (lo, hi) in ranges.items()
    ])
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("field"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"),
            F.col(c).alias("violations"),
        )
        for c, (lo, hi) in ranges.items()
    ]))
    return flags.select(rows.alias("r")).select("r.*")


def flag_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]], name: str = "in_range") -> DataFrame:
    ok = F.lit(True)
    for c, (lo, hi) in ranges.items():
        ok = ok & F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    return df.withColumn(name, ok)


def require_trainable(df: DataFrame, label: str, min_rows: int = 2, min_classes: int = 2) -> DataFrame:
    """Raise when a table cannot be trained on; one aggregate pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(label).alias("k"),
                 F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if row["n"] < min_rows:
        raise ValueError(f"{row['n']} rows left, at least {min_rows} needed")
    classes = 1 if row["lo"] == row["hi"] else max(2, row["k"])
    if classes < min_classes:
        raise ValueError(f"only one class ({row['lo']}) left, at least {min_classes} needed")
    return df


def require_valid_times(df: DataFrame, text: str, name: str = "time") -> DataFrame:
    """Parse times; raise when one cannot be parsed."""
    parsed = df.withColumn(name, F.try_to_timestamp(F.col(text)))
    bad = parsed.filter(F.col(name).isNull()).limit(1).count()
    if bad:
        raise ValueError("invalid time values")
    return parsed


def quarantine_times(df: DataFrame, text: str, name: str = "time") -> tuple[DataFrame, DataFrame]:
    """(rows with a valid time, rows without)."""
    parsed = df.withColumn(name, F.try_to_timestamp(F.col(text)))
    return parsed.filter(F.col(name).isNotNull()), parsed.filter(F.col(name).isNull())


def residuals(df: DataFrame, actual: str, predicted: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, F.col(actual) - F.col(predicted))


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]
