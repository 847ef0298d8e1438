"""Row-wise functions over array columns (cells, windows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside ``body``.

    An expression that is referenced from a lambda is evaluated again for each
    element; going through a one-element array fixes its value first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    present = F.array_compact(values)
    return F.try_divide(array_sum(present), F.size(present))


def array_std(values: Column) -> Column:
    """Sample standard deviation, nulls skipped, null for fewer than two values."""
    present = F.array_compact(values)
    n = F.size(present)

    def spread(mean: Column) -> Column:
        squares = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        return F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))

    return bind(array_mean(values), spread)


def cell_min(cells: Column) -> Column:
    return F.array_min(cells)


def cell_argmin(cells: Column) -> Column:
    """1-based position of the smallest cell, first wins; null when all are null."""
    return F.array_position(cells, F.array_min(cells)).cast("int")


def cell_label(position: Column) -> Column:
    return F.concat(F.lit("Cell"), position.cast("string"))


def euclidean(left: Column, right: Column) -> Column:
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.sqrt(array_sum(squares))


def mean_squared_error(left: Column, right: Column) -> Column:
    """Elements that are missing on either side do not count."""
    return array_mean(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)))
