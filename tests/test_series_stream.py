import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackpulse.operators import series as ops
from stackpulse.plans import votes
from stackpulse.session import scratch_path
from stackpulse.streaming import series as streamed

ORDER = ["t", "id"]
SCHEMA = "s string, t long, id long, current double, voltage double"


def made_rows():
    """Series with gaps inside, at the head, at the end and over piece ends; one
    without a key, one too short for features, one without any current."""
    rng = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 700), ("b", 311), (None, 150), ("d", 5), ("e", 40)):
        for i in range(n):
            gone = rng.random() < 0.1 or s == "b" and (i < 7 or i > 300) or s == "a" and 170 < i < 360 or s == "e"
            rows.append((s, i // 2, i, None if gone else float(rng.normal()), None if rng.random() < 0.05 else float(rng.normal())))
    return rows


def land(spark, pieces, scorer=None):
    """A run after each piece, each from the checkpoint of the one before."""
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "run"))
    for piece in pieces:
        piece.write.mode("append").parquet(source)
        streamed.score_series(spark, source, piece.schema, ORDER, ["s"], sink, checkpoint, scorer).awaitTermination()
    return spark.read.parquet(sink)


def with_ends(spark, rows):
    ends = rows.select("s").distinct().withColumn("closed", F.lit(True))
    return rows.withColumn("closed", F.lit(False)), ends


def frame(df, columns):
    return df.select("s", "id", *columns).toPandas().sort_values(["s", "id"], na_position="first").reset_index(drop=True)


def test_pieces_equal_the_whole(spark):
    rows = spark.createDataFrame(made_rows(), SCHEMA)
    open_rows, ends = with_ends(spark, rows)
    cuts = [0, 3, 60, 180, 181, 400]
    pieces = [open_rows.filter(F.col("t").between(a, b - 1)) for a, b in zip(cuts, cuts[1:])]
    got = land(spark, [*pieces, ends.selectExpr("s", "cast(null as long) t", "cast(null as long) id", "cast(null as double) current", "cast(null as double) voltage", "closed")])
    assert got.filter("late").count() == 0
    columns = ["source_row", "row_no", "current", *ops.FEATURES]
    want = frame(ops.series_features(rows, ORDER, ["s"]), columns)
    have = frame(got, columns)
    assert len(want) > 900 and have[["s", "id"]].equals(want[["s", "id"]])
    assert np.allclose(have[columns], want[columns], rtol=0, atol=1e-9)


def test_rows_come_out_before_the_end(spark):
    rows = spark.createDataFrame([("a", i, i, float(i), 1.0) for i in range(600)], SCHEMA)
    first, _ = with_ends(spark, rows.filter("t < 500"))
    again, _ = with_ends(spark, rows.filter("t >= 490"))  # ten of them for the second time
    out = land(spark, [first, again])
    kept = frame(out.filter("NOT late"), ["source_row", "current"])
    reach = 128
    assert list(kept["id"]) == list(range(9, 600 - reach)) and list(kept["source_row"]) == list(kept["id"])
    late = frame(out.filter("late"), ["current", "row_no"])
    assert list(late["id"]) == list(range(490, 500)) and late["current"].isna().all() and late["row_no"].isna().all()


def test_a_closed_series_begins_anew(spark):
    rows = spark.createDataFrame([("a", i, i, float(i), 1.0) for i in range(40)], SCHEMA)
    open_rows, ends = with_ends(spark, rows)
    whole = open_rows.unionByName(ends, allowMissingColumns=True)
    out = frame(land(spark, [whole, whole]), ["row_no"])
    assert list(out["id"]) == [i for i in range(9, 40) for _ in range(2)] and list(out["row_no"]) == [i for i in range(31) for _ in range(2)]
    empty = land(spark, [open_rows.limit(0), ends.selectExpr("s", "cast(null as long) t", "cast(null as long) id", "cast(null as double) current", "cast(null as double) voltage", "closed")])
    assert empty.count() == 0


def test_scores_equal_the_batch_vote(spark):
    rows = spark.createDataFrame(made_rows(), SCHEMA)
    features = ops.series_features(rows, ORDER, ["s"])
    model = votes.fit_series_model(features, ["s"], trees=20)
    want = votes.vote_series(features, model, first_reference=True).windows
    scorer = streamed.stored_scorer(model, want)
    open_rows, ends = with_ends(spark, rows)
    last = open_rows.filter("t >= 170").unionByName(ends, allowMissingColumns=True)
    got = land(spark, [open_rows.filter("t < 100"), open_rows.filter("t >= 100 and t < 170"), last], scorer).filter("row_no >= 30")
    flags = ["recon_anomaly", "dtw_anomaly", "iso_anomaly", "anomaly"]
    a, b = (d.select("s", "row_no", "recon_error", "dtw_distance", *flags).toPandas().sort_values(["s", "row_no"]).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b) > 700
    assert np.allclose(a[["recon_error", "dtw_distance"]], b[["recon_error", "dtw_distance"]], rtol=0, atol=1e-9)
    assert a[flags].astype(bool).equals(b[flags].astype(bool))


@pytest.mark.parametrize("closed", [False, True])
def test_fill_known(closed):
    nan = np.nan
    got, final = streamed.fill_known(np.array([nan, 1.0, nan, nan, 4.0, nan]), closed)
    assert final == (6 if closed else 5)
    assert np.array_equal(got, [nan, 1, 2, 3, 4, 4 if closed else nan], equal_nan=True)
    got, final = streamed.fill_known(np.full(3, nan), closed)
    assert final == 3 and np.isnan(got).all()


def test_rows_are_ordered_and_late_as_pandas_has_it():
    """Arrays give the order and the late rows that pandas gives, gaps included."""
    rng = np.random.default_rng(4)
    n = 60
    base = pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 6, n), unit="s"), "event_id": rng.integers(0, 4, n), "at": np.arange(n)})
    gaps = base.assign(ts=base["ts"].where(base["event_id"] > 0), event_id=base["event_id"].where(base["at"] % 5 > 0))
    words = base.assign(event_id=base["event_id"].map("abcd".__getitem__).astype(object))
    for rows in (base, gaps, words):
        want = rows.sort_values(["ts", "event_id"], kind="stable", ignore_index=True)
        plain = {c: rows[c].to_numpy() for c in rows}
        assert streamed.in_order(plain, ["ts", "event_id"]).tolist() == want["at"].tolist()
        held = want.dropna().iloc[:20]
        ts, event = held["ts"].iloc[-1], held["event_id"].iloc[-1]
        late = (rows["ts"] < ts) | (rows["ts"] == ts) & ((rows["event_id"] < event) | (rows["event_id"] == event))
        assert (streamed.not_after(plain, {c: held[c].to_numpy() for c in held}, ["ts", "event_id"]) == late.to_numpy()).all()


class _State:
    """A state as a call sees it."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_history_comes_back_as_it_was():
    held = {"ts": np.array(["2024-01-01T00:00:01.5", "NaT"], "datetime64[us]"), "n": np.array([1, 2]), "gap": np.array([1.5, np.nan]), "word": np.array(["a", None], object)}
    none, state = np.zeros((0, len(ops.FEATURES))), _State()
    streamed.History(7, 5, 4, held, none + 1, none).write(state)
    back = streamed.History.read(state, {c: v[:0] for c, v in held.items()})
    assert (back.taken, back.given, back.kept) == (7, 5, 4) and list(back.held) == list(held)
    for c, v in held.items():
        assert back.held[c].dtype.kind == v.dtype.kind
        pd.testing.assert_series_equal(pd.Series(back.held[c]), pd.Series(v), check_dtype=False)
    assert list(streamed.History.read(_State(), {"ts": held["ts"][:0]}).held) == ["ts"]
