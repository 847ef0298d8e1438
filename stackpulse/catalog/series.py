"""Ordered series: lags, rolling, gaps, windows, wavelet and votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import array_sum
from ..operators import ordered, series as ops
from ..operators.wavelet import DB4, coefficients, high_pass, wavelet_smooth
from ..plans import votes
from ..session import materialise, scratch_path
from ..streaming import series as streamed
from .registry import ORDER, SERIES, SERIES_SQL, query, r6, series_table

W = "OVER (PARTITION BY user_id ORDER BY row_no)"


def _indexed(spark, sf, gaps=False):
    return ordered.index_rows(series_table(spark, sf, gaps), ORDER, SERIES)


@query("e01_lags", f"WITH {SERIES_SQL} SELECT event_id, lag(current, 1) {W} AS current_lag1, lag(current, 2) {W} AS current_lag2 FROM series")
def e01(spark, sf):
    return ordered.lags(_indexed(spark, sf), "current", [1, 2], SERIES).select("event_id", "current_lag1", "current_lag2")


ROLL = """CASE WHEN count(current) OVER w = 10 THEN {f}(current) OVER w END"""
ROLL_W = "WINDOW w AS (PARTITION BY user_id ORDER BY row_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("e02_rolling_mean", f"WITH {SERIES_SQL} SELECT event_id, round({ROLL.format(f='avg')}, 6) AS m FROM series {ROLL_W}")
def e02(spark, sf):
    return ordered.rolling(_indexed(spark, sf), "current", 10, SERIES).select("event_id", r6("current_rolling_mean").alias("m"))


@query("e03_rolling_std", f"WITH {SERIES_SQL} SELECT event_id, round({ROLL.format(f='stddev_samp')}, 6) AS s FROM series {ROLL_W}")
def e03(spark, sf):
    return ordered.rolling(_indexed(spark, sf), "current", 10, SERIES).select("event_id", r6("current_rolling_std").alias("s"))


# Nulls where the id divides by 7, then the line between the neighbours.
FILLED = f"""{SERIES_SQL},
g AS (SELECT * EXCLUDE (current), CASE WHEN event_id % 7 <> 0 THEN current END AS current FROM series),
f0 AS (SELECT *,
  last_value(current IGNORE NULLS) OVER b AS lv, last_value(CASE WHEN current IS NOT NULL THEN row_no END IGNORE NULLS) OVER b AS lr,
  first_value(current IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN current IS NOT NULL THEN row_no END IGNORE NULLS) OVER a AS nr
  FROM g WINDOW b AS (PARTITION BY user_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                a AS (PARTITION BY user_id ORDER BY row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT user_id, event_id, row_no, n, voltage, CASE WHEN current IS NOT NULL THEN current WHEN lv IS NULL THEN NULL WHEN nv IS NULL THEN lv
  ELSE lv + (nv - lv) * (row_no - lr) / (nr - lr) END AS current FROM f0)"""


@query("e04_fill_gaps", f"WITH {FILLED} SELECT event_id, round(current, 6) AS current FROM filled")
def e04(spark, sf):
    return ordered.fill_gaps(_indexed(spark, sf, True), ["current"], SERIES).select("event_id", r6("current").alias("current"))


@query("e05_sequences", f"""
WITH {SERIES_SQL} SELECT event_id, length, total, first_value, last_value FROM (
SELECT event_id, row_no, 30 AS length, round(sum(current) OVER w, 4) AS total, first_value(current) OVER w AS first_value,
  last_value(current) OVER w AS last_value FROM series WINDOW w AS (PARTITION BY user_id ORDER BY row_no ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE row_no >= 30""")
def e05(spark, sf):
    rows = ordered.sequences(_indexed(spark, sf), ["current"], 30, SERIES)
    flat = F.flatten("window")
    return rows.select("event_id", F.size(flat).alias("length"), F.round(array_sum(flat), 4).alias("total"),
                       F.element_at(flat, 1).alias("first_value"), F.element_at(flat, -1).alias("last_value"))


@query("e06_chronological_split", f"""
WITH {SERIES_SQL} SELECT event_id, CASE WHEN row_no < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM series""")
def e06(spark, sf):
    train, test = ordered.chronological_split(_indexed(spark, sf), 0.8)
    return train.select("event_id", F.lit("train").alias("part")).unionByName(test.select("event_id", F.lit("test").alias("part")))


@query("e07_row_index", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS time_index,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS series_index FROM events""")
def e07(spark, sf):
    rows = series_table(spark, sf).select("user_id", "ts", "event_id")
    whole = ordered.index_rows(rows, ORDER).select("event_id", (F.col("row_no") + 1).alias("time_index"))
    keyed = ordered.index_rows(rows, ORDER, SERIES).select("event_id", (F.col("row_no") + 1).alias("series_index"))
    return whole.join(keyed, "event_id")


@query("e09_wavelet", f"WITH {SERIES_SQL} SELECT event_id, round(current, 6) AS wavelet FROM series")
def e09(spark, sf):
    rows = _indexed(spark, sf)
    wave = wavelet_smooth(rows, "current", SERIES)
    return rows.select("user_id", "row_no", "event_id").join(wave, ["user_id", "row_no"]).select("event_id", r6("wavelet").alias("wavelet"))


# Every coefficient from its filter taps over the mirrored series.
COEFFICIENTS_SQL = f"""{SERIES_SQL},
taps AS (SELECT unnest({DB4}::DOUBLE[]) AS low, unnest({high_pass(DB4)}::DOUBLE[]) AS high, unnest(range({len(DB4)})) AS j),
k AS (SELECT user_id, n, unnest(range((n + {len(DB4) - 1}) // 2)) AS k FROM (SELECT DISTINCT user_id, n FROM series)),
reached AS (SELECT user_id, k, n, low, high, (2 * k + 1 - j + 8 * n) % (2 * n) AS m FROM k, taps),
placed AS (SELECT *, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS row_no FROM reached)"""


@query("e09_wavelet_coefficients", f"""
WITH {COEFFICIENTS_SQL} SELECT user_id, k AS row_no, round(sum(low * current), 6) AS approx, round(sum(high * current), 6) AS detail
FROM placed JOIN series USING (user_id, row_no) GROUP BY 1, 2""")
def e09_coefficients(spark, sf):
    return coefficients(_indexed(spark, sf), "current", SERIES, 1).select("user_id", "row_no", r6("approx").alias("approx"), r6("detail").alias("detail"))


# A run of p missing values at the head reaches that many coefficients and
# then samples: the same reach arithmetic as the filters.
FEATURES_SQL = f"""{FILLED},
p AS (SELECT user_id, coalesce(min(row_no) FILTER (current IS NOT NULL), max(n)) AS p FROM filled GROUP BY 1),
p1 AS (SELECT *, CASE WHEN p > 0 THEN (p + 5) // 2 + 1 ELSE 0 END AS p1 FROM p),
p2 AS (SELECT *, CASE WHEN p > 0 THEN (p1 + 5) // 2 + 1 ELSE 0 END AS p2 FROM p1),
p3 AS (SELECT *, CASE WHEN p > 0 THEN (p2 + 5) // 2 + 1 ELSE 0 END AS p3 FROM p2),
reach AS (SELECT user_id, 2 * greatest(p1, 2 * greatest(p2, 2 * p3)) AS reach FROM p3),
feat AS (SELECT filled.*, lag(current, 1) {W} AS current_lag1, lag(current, 2) {W} AS current_lag2, lag(voltage, 1) {W} AS voltage_lag1,
  {ROLL.format(f='avg')} AS current_rolling_mean, {ROLL.format(f='stddev_samp')} AS current_rolling_std,
  CASE WHEN row_no >= reach THEN current END AS wavelet_current
  FROM filled JOIN reach USING (user_id) {ROLL_W}),
kept AS (SELECT *, row_number() {W} - 1 AS new_no, count(*) OVER (PARTITION BY user_id) AS new_n FROM feat WHERE current IS NOT NULL AND current_lag1 IS NOT NULL AND current_lag2 IS NOT NULL
  AND voltage_lag1 IS NOT NULL AND current_rolling_mean IS NOT NULL AND current_rolling_std IS NOT NULL AND wavelet_current IS NOT NULL)"""


KEPT_SQL = f"""
WITH {FEATURES_SQL} SELECT event_id, new_no AS row_no, round(current, 5) AS current, voltage, round(current_lag1, 5) AS current_lag1,
 round(current_lag2, 5) AS current_lag2, voltage_lag1, round(current_rolling_mean, 5) AS current_rolling_mean,
 round(current_rolling_std, 5) AS current_rolling_std, round(wavelet_current, 5) AS wavelet_current FROM kept"""


def _rounded(rows):
    return rows.select("event_id", "row_no", "voltage", "voltage_lag1", *[
        F.round(c, 5).alias(c) for c in ["current", *ops.FEATURES] if not c.startswith("voltage")])


@query("i26_series_features", KEPT_SQL)
def i26(spark, sf):
    return _rounded(ops.series_features(series_table(spark, sf, True), ORDER, SERIES))


def _in_pieces(spark, rows, scorer=None, pieces=3):
    """Let ``rows`` land piece by piece in order of time, with a run of the job
    after each; the last piece also ends every series."""
    source, sink, checkpoint = (scratch_path(spark, f"series-{name}") for name in ("in", "out", "run"))
    rows = rows.withColumn("closed", F.lit(False))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        return streamed.stream_series(rows, ORDER, SERIES, scorer=scorer)
    piece = F.least(F.floor((at - low) * pieces / (high - low + 1)), F.lit(pieces - 1))
    for i in range(pieces):
        part = rows.filter(piece == i)
        if i == pieces - 1:
            part = part.unionByName(rows.select(*SERIES).distinct().withColumn("closed", F.lit(True)), allowMissingColumns=True)
        part.write.mode("append").parquet(source)
        streamed.score_series(spark, source, rows.schema, ORDER, SERIES, sink, checkpoint, scorer).awaitTermination()
    return spark.read.parquet(sink)


@query("s01_series_stream", KEPT_SQL)
def s01_series_stream(spark, sf):
    return _rounded(_in_pieces(spark, series_table(spark, sf, True)).filter("NOT late"))


@query("s02_series_stream_vote")
def s02_series_stream_vote(spark, sf):
    rows = series_table(spark, sf)
    features = materialise(ops.series_features(rows, ORDER, SERIES), "features")
    model = votes.fit_series_model(features, SERIES)
    training = votes.vote_series(features, model, first_reference=True).windows
    out = _in_pieces(spark, rows, streamed.stored_scorer(model, training))
    return out.filter("row_no >= 30").select(
        "event_id", "row_no", r6("recon_error").alias("recon_error"), r6("dtw_distance").alias("dtw_distance"),
        "recon_anomaly", "dtw_anomaly", "iso_anomaly", "anomaly")


REF = f"""{SERIES_SQL}, w AS (SELECT s.user_id, s.row_no AS target, h.row_no - (s.row_no - 30) AS e, h.current AS x
  FROM series s JOIN series h ON s.user_id = h.user_id AND h.row_no BETWEEN s.row_no - 30 AND s.row_no - 1 WHERE s.row_no >= 30),
ref AS (SELECT user_id, e, median(x) AS m FROM w GROUP BY 1, 2)"""


@query("d32_reference_window", f"WITH {REF} SELECT user_id, e AS element, round(m, 6) AS value FROM ref")
def d32(spark, sf):
    ref = ops.reference_window(_indexed(spark, sf), ["current"], series=SERIES)
    return ref.select("user_id", F.posexplode(F.flatten("reference")).alias("element", "value")).select(
        "user_id", F.col("element").cast("bigint").alias("element"), r6("value").alias("value"))


def _windows(spark, sf):
    rows = _indexed(spark, sf)
    wins = ordered.sequences(rows, ["current"], 30, SERIES).select("user_id", "row_no", "event_id", "window")
    return ops.attach_reference(wins, ops.reference_window(rows, ["current"], series=SERIES), SERIES)


@query("c05_window_to_reference", f"""
WITH {REF} SELECT user_id, target AS row_no, round(sqrt(sum((x - m) ** 2)), 5) AS distance FROM w JOIN ref USING (user_id, e) GROUP BY 1, 2""")
def c05(spark, sf):
    return ops.window_distance(_windows(spark, sf)).select("user_id", "row_no", F.round("distance", 5).alias("distance"))


@query("d33_window_mse", f"""
WITH {REF} SELECT user_id, target AS row_no, round(avg((x - m) ** 2), 9) AS mse FROM w JOIN ref USING (user_id, e) GROUP BY 1, 2""")
def d33(spark, sf):
    return ops.window_mse(_windows(spark, sf), "window", "reference").select("user_id", "row_no", F.round("mse", 9).alias("mse"))


@query("d34_percentile_flag", "SELECT event_id, value > (SELECT quantile_cont(value, 0.9) FROM events) AS high FROM events")
def d34(spark, sf):
    rows = series_table(spark, sf)
    return ops.percentile_flag(rows, "current", "high").select("event_id", "high")


VOTE = """flags AS (SELECT *, current > 60 AS a, voltage > 50 AS b, event_id % 2 = 0 AS c FROM series WHERE row_no >= 30)"""


def _flags(spark, sf):
    rows = _indexed(spark, sf)
    flags = rows.filter("row_no >= 30").select(
        "user_id", "row_no", (F.col("current") > 60).alias("a"), (F.col("voltage") > 50).alias("b"),
        (F.col("event_id") % 2 == 0).alias("c"))
    return rows, ops.vote(flags, ["a", "b", "c"])


@query("i25_vote_summary", f"""
WITH {SERIES_SQL}, {VOTE} SELECT count(*) AS total_rows, count(*) FILTER (a AND b AND c) AS anomalies,
 round(count(*) FILTER (a AND b AND c) * 100.0 / count(*), 6) AS anomaly_percentage FROM flags""")
def i25(spark, sf):
    return ops.vote_summary(_flags(spark, sf)[1]).withColumn("anomaly_percentage", r6("anomaly_percentage"))


@query("i29_flag_rows", f"""
WITH {SERIES_SQL}, {VOTE} SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM flags WHERE a AND b AND c) THEN 1 ELSE 0 END AS anomaly FROM series""")
def i29(spark, sf):
    rows, flags = _flags(spark, sf)
    return ops.flag_rows(rows, flags, SERIES).select("event_id", "anomaly")
