"""Scalar column functions. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

EPOCH_TEXT = "1970-01-01 00:00:00"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
HEALTH_LABELS = {0: "Critical", 1: "Degraded", 2: "Healthy"}


def clean_time_text(text: Column) -> Column:
    """Normalised time text; unparsable or missing input gives the epoch."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), TIME_FORMAT), F.lit(EPOCH_TEXT))


def epoch_to_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def run_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def label_number(label: Column) -> Column:
    """First run of digits of a label such as ``Cell35`` as an integer."""
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")


def map_codes(code: Column, labels: Mapping[int, str]) -> Column:
    expr = F.lit(None).cast("string")
    for key, label in labels.items():
        expr = F.when(code == key, F.lit(label)).otherwise(expr)
    return expr


def binary_fault(code: Column) -> Column:
    return F.when(code == 0, F.lit(0)).otherwise(F.lit(1))


def fault_label(code: Column) -> Column:
    return F.when(code == 0, F.lit("Normal")).otherwise(F.lit("Faulty"))


def left_closed_bins(value: Column, edges: Sequence[float]) -> Column:
    """Code of the half-open bin [edge i, edge i+1); null gives -1.

    ``edges`` are the inner edges; the outer bins are unbounded.
    """
    expr = F.lit(len(edges))
    for code in range(len(edges) - 1, -1, -1):
        expr = F.when(value < F.lit(edges[code]), F.lit(code)).otherwise(expr)
    return F.when(value.isNull() | F.isnan(value), F.lit(-1)).otherwise(expr)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Bound a value, keeping null as null (``least`` alone would skip it)."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def finite_or_zero(value: Column) -> Column:
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(value.isNull() | bad, F.lit(0.0)).otherwise(value)


def uniform(low: float, high: float, seed: int) -> Column:
    return F.lit(low) + F.lit(high - low) * F.rand(seed)


_PRIME = 2147483647
_FACTOR = 48271


def id_hash(key: Column, seed: int = 0) -> Column:
    """Repeatable arithmetic hash of an integer key in [0, 2^31 - 1).

    Two multiplicative steps modulo a Mersenne prime; products stay below 2^63,
    so ANSI mode never raises, and any SQL engine can repeat it.
    """
    key = key.cast("bigint")
    step = F.pmod(F.pmod(key, F.lit(_PRIME)) * F.lit(_FACTOR) + F.lit(seed * 7919 + 12345), F.lit(_PRIME))
    return F.pmod(step * F.lit(69621) + F.floor(step / F.lit(1000)), F.lit(_PRIME))


def id_hash_sql(key: str, seed: int = 0) -> str:
    """The same hash as SQL text, for non-negative keys."""
    step = f"((({key}) % {_PRIME}) * {_FACTOR} + {seed * 7919 + 12345}) % {_PRIME}"
    return f"((({step}) * 69621 + CAST(floor(({step}) / 1000.0) AS BIGINT)) % {_PRIME})"


def unit_hash(key: Column, seed: int = 0) -> Column:
    """Hash scaled to [0, 1)."""
    return id_hash(key, seed) / F.lit(float(_PRIME))


def argmax_code(probabilities: Column) -> Column:
    """Index of the largest probability, first wins; a 0.5 cut for two classes."""
    many = F.array_position(probabilities, F.array_max(probabilities)) - 1
    two = F.when(F.element_at(probabilities, 2) >= 0.5, F.lit(1)).otherwise(F.lit(0))
    return F.when(F.size(probabilities) == 2, two).otherwise(many).cast("int")


def confidence(probabilities: Column, prediction: Column) -> Column:
    return F.element_at(probabilities, prediction.cast("int") + 1)


def dynamic_neighbours(n: Column | int) -> Column:
    """max(5, int(ln n)); 5 for an empty table."""
    n = n if isinstance(n, Column) else F.lit(n)
    log = F.when(n > 0, F.floor(F.log(n.cast("double")))).otherwise(F.lit(0))
    return F.greatest(F.lit(5), log).cast("int")
