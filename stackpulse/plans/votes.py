"""Three-way anomaly vote over the windows of a series table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import finite_or_zero
from ..operators import forest, scale, series as ops
from ..operators.ordered import ROW, chronological_split, join_keys
from ..operators.warping import warp_distances
from ..operators.windows import WindowAxes, fit_window_axes, window_errors
from ..session import materialise


@dataclass
class SeriesModel:
    scale: dict[str, tuple[float, float]]
    forest: forest.IsolationForest
    axes: WindowAxes
    series: list[str]
    length: int


@dataclass
class VoteResult:
    windows: DataFrame
    rows: DataFrame
    summary: DataFrame


def _scaled(table: DataFrame, params) -> DataFrame:
    return scale.apply_scale(table.withColumns({c: finite_or_zero(F.col(c)) for c in ops.FEATURES}), params)


def _key(series: Sequence[str]):
    return F.xxhash64(*series, ROW).alias("_key")


def fit_series_model(
    table: DataFrame, series: Sequence[str] = (), fraction: float = 0.8, length: int = ops.LENGTH, axes: int = 8,
    trees: int = forest.TREES, contamination: float = 0.05,
) -> SeriesModel:
    """Fit scale, isolation forest and principal axes on the head of each
    series; ``table`` comes from ``series_features``."""
    train, _ = chronological_split(table, fraction)
    params = scale.fit_robust(train, ops.FEATURES)
    scaled = materialise(_scaled(train, params), "train")
    points = scaled.select(_key(series), F.array(*ops.FEATURES).alias("x"))
    iso = forest.fit_forest(points, "_key", "x", trees).with_threshold(points, "x", contamination)
    return SeriesModel(params, iso, fit_window_axes(scaled, ops.FEATURES, length, axes, series), list(series), length)


def vote_series(table: DataFrame, model: SeriesModel, p: float = 0.9, first_reference: bool = False) -> VoteResult:
    """Score every window of ``table`` with the three detectors and their vote.

    All three are keyed by the target row: the reconstruction and warping
    scores cover the rows before it, the forest the row itself.
    """
    series, length = model.series, model.length
    scaled = materialise(_scaled(table, model.scale), "scaled")
    keys = [*series, ROW]
    recon = window_errors(scaled, ops.FEATURES, length, model.axes, series)
    ref = ops.reference_window(scaled, ops.FEATURES, length, series=series, first=first_reference)
    warped = warp_distances(scaled, ops.FEATURES, ref, length, series)
    iso = model.forest.flag(scaled.filter(F.col(ROW) >= length).select(*keys, F.array(*ops.FEATURES).alias("x")), "x").drop("x")
    scores = join_keys(join_keys(recon, warped, keys, "inner"), iso, keys, "inner")
    scores = materialise(scores, "window_scores")
    flagged = ops.percentile_flag(scores, "recon_error", "recon_anomaly", p)
    flagged = ops.percentile_flag(flagged, "dtw_distance", "dtw_anomaly", p)
    flagged = ops.vote(flagged, ["recon_anomaly", "dtw_anomaly", "iso_anomaly"])
    return VoteResult(flagged, ops.flag_rows(table, flagged, series), ops.vote_summary(flagged))
