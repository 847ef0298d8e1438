import warnings

import numpy as np
import pandas as pd
import pytest

from stackpulse.operators import ordered, series as ops
from stackpulse.operators.wavelet import DB4, coefficients, high_pass, level_size, wavelet_smooth


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    rows = []
    # One series holds most rows, and many of its rows share a time.
    for s, n in (("hot", 400), ("a", 50), ("b", 12), ("c", 1)):
        t = np.sort(rng.integers(0, max(2, n // 4), size=n))
        v = rng.normal(size=n)
        gap = rng.uniform(size=n) < 0.2
        for i in range(n):
            rows.append((s, int(t[i]), len(rows), None if gap[i] else float(v[i]), float(rng.normal())))
    return pd.DataFrame(rows, columns=["s", "t", "id", "current", "voltage"])


@pytest.fixture(scope="module")
def indexed(spark, data):
    df = spark.createDataFrame(data.astype({"current": object}).where(data.notna(), None).values.tolist(), "s string, t long, id long, current double, voltage double")
    return ordered.index_rows(df, ["t", "id"], ["s"])


def pandas_sorted(data):
    out = data.sort_values(["s", "t", "id"]).copy()
    out["row_no"] = out.groupby("s").cumcount()
    return out


def test_index(indexed, data):
    got = indexed.toPandas().set_index("id")
    want = pandas_sorted(data).set_index("id")
    assert (got["row_no"].sort_index() == want["row_no"].sort_index()).all()
    assert (got["series_rows"].sort_index() == want.groupby("s")["row_no"].transform("count").sort_index()).all()


def test_whole_table_index(spark, data):
    df = spark.createDataFrame(data[["t", "id"]])
    got = ordered.index_rows(df, ["t", "id"]).toPandas().sort_values(["t", "id"])
    assert got["row_no"].tolist() == list(range(len(data)))


def test_null_series_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)], "s string, id long")
    assert sorted(r["row_no"] for r in ordered.index_rows(df, ["id"], ["s"]).collect()) == list(range(20))


@pytest.mark.parametrize("block", [10, 33, 4096])
def test_blocks_equal_pandas(indexed, data, block):
    want = pandas_sorted(data)
    g = want.groupby("s")["current"]
    want["lag1"], want["lag2"] = g.shift(1), g.shift(2)
    want["mean"] = g.transform(lambda x: x.rolling(10).mean())
    want["std"] = g.transform(lambda x: x.rolling(10).std())
    want = want.set_index("id").sort_index()
    got = ordered.lags(indexed, "current", [1, 2], ["s"], block).toPandas().set_index("id").sort_index()
    assert np.allclose(got["current_lag1"], want["lag1"], equal_nan=True)
    assert np.allclose(got["current_lag2"], want["lag2"], equal_nan=True)
    got = ordered.rolling(indexed, "current", 10, ["s"], block).toPandas().set_index("id").sort_index()
    assert np.allclose(got["current_rolling_mean"], want["mean"], equal_nan=True)
    assert np.allclose(got["current_rolling_std"], want["std"], equal_nan=True)


def test_gap_filling_equals_pandas(indexed, data):
    want = pandas_sorted(data)
    want["f"] = want.groupby("s")["current"].transform(lambda x: x.interpolate("linear"))
    got = ordered.fill_gaps(indexed, ["current"], ["s"]).toPandas().set_index("id").sort_index()
    assert np.allclose(got["current"], want.set_index("id").sort_index()["f"], equal_nan=True)


def test_all_null_series_stays_null(spark):
    df = spark.createDataFrame([(i, None) for i in range(5)], "id long, current double")
    got = ordered.fill_gaps(ordered.index_rows(df, ["id"]), ["current"]).collect()
    assert [r["current"] for r in got] == [None] * 5


@pytest.mark.parametrize("block", [30, 64])
def test_sequences(indexed, data, block):
    want = pandas_sorted(data)
    got = ordered.sequences(indexed, ["voltage"], 30, ["s"], block).toPandas()
    sizes = data.groupby("s").size()
    assert len(got) == sum(max(0, n - 30) for n in sizes)
    hot = want[want["s"] == "hot"]["voltage"].to_numpy()
    for _, r in got[got["s"] == "hot"].iterrows():
        assert np.allclose(np.concatenate(r["window"]), hot[r["row_no"] - 30:r["row_no"]])


def test_reference_window(indexed, data):
    hot = pandas_sorted(data).query("s == 'hot'")["voltage"].to_numpy()
    wins = np.lib.stride_tricks.sliding_window_view(hot, 30)[:-1]
    for limit in (1000, 100):
        ref = ops.reference_window(indexed, ["voltage"], 30, limit, ["s"]).filter("s = 'hot'").first()["reference"]
        assert np.allclose(np.array(ref)[:, 0], np.median(wins[:limit], axis=0))
    every = ops.reference_window(indexed, ["voltage"], 30, series=["s"]).filter("s = 'hot'").first()["reference"]
    assert np.allclose(np.array(every)[:, 0], np.median(wins, axis=0))
    zero = ops.reference_window(indexed, ["voltage"], 30, series=["s"], first=True).filter("s = 'hot'").first()["reference"]
    assert np.allclose(np.array(zero)[:, 0], wins[0])


def test_reference_windows_of_many_series(spark):
    """Short series are ordered together and long ones by ranks, with the same
    medians; nulls do not count, and a series without any value has no reference."""
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("a", 40), ("b", 31), (None, 70), ("c", 30), ("d", 33)):
        for i in range(n):
            u = None if name == "d" or rng.random() < 0.2 else float(rng.integers(0, 9))
            rows.append((name, i, n, u, None if name == "d" or name == "b" else rng.normal()))
    df = spark.createDataFrame(rows, "s string, row_no long, series_rows long, u double, v double").repartition(5)
    for options in ({}, {"first": True}, {"windows": 4}):
        last = 1 if "first" in options else options.get("windows")
        want = {}
        for name in ("a", "b", None):
            x = np.array([[np.nan if y is None else y for y in r[3:]] for r in rows if r[0] == name])
            wins = np.stack([x[i:i + 30] for i in range(len(x) - 30)][:last])
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                want[name] = np.nanmedian(wins, axis=0)
        for block in (4096, 50, 1):
            got = {r["s"]: np.array(r["reference"]) for r in ops.reference_window(df, ["u", "v"], 30, series=["s"], block_rows=block, **options).collect()}
            assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], equal_nan=True) for k in want)
    alone = df.filter("s = 'a'").drop("s")
    for block in (4096, 1):
        assert np.allclose(ops.reference_window(alone, ["v"], 30, block_rows=block).first()["reference"], ops.reference_window(df, ["v"], 30, series=["s"]).filter("s = 'a'").first()["reference"])


def numpy_analysis(x):
    twice = np.concatenate([x, x[::-1]])  # mirrored again and again
    ext = lambda i: twice[i % len(twice)]
    size = (len(x) + 7) // 2
    low = [sum(DB4[j] * ext(2 * k + 1 - j) for j in range(8)) for k in range(size)]
    high = [sum(high_pass(DB4)[j] * ext(2 * k + 1 - j) for j in range(8)) for k in range(size)]
    return np.array(low), np.array(high)


@pytest.mark.parametrize("n", [1, 2, 5, 37, 300, 1000])
@pytest.mark.parametrize("block", [128, 4096])
def test_wavelet_levels(spark, n, block):
    """All levels of short and long series, whole or in blocks, against numpy."""
    x = np.random.default_rng(n).normal(size=n)
    rows = [(s, i, float(v) + s) for s in (0, 1) for i, v in enumerate(x)]
    df = ordered.index_rows(spark.createDataFrame(rows, "s int, id long, v double"), ["id"], ["s"])
    got = coefficients(df, "v", ["s"], 3, block).toPandas().sort_values(["s", "level", "row_no"])
    for s in (0, 1):
        low = x + s
        for level in (1, 2, 3):
            low, high = numpy_analysis(low)
            part = got[(got["s"] == s) & (got["level"] == level)]
            assert part["row_no"].tolist() == list(range(len(low))) and len(low) == level_size(n, level)
            assert np.allclose(part["approx"], low) and np.allclose(part["detail"], high)


def test_wavelet_in_blocks(spark):
    x = np.random.default_rng(2).normal(size=700)
    df = ordered.index_rows(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double"), ["id"])
    got = wavelet_smooth(df, "v", block_rows=128).orderBy("row_no").toPandas()
    assert got["row_no"].tolist() == list(range(700)) and np.allclose(got["wavelet"], x)


def test_wavelet_rebuild(indexed):
    filled = indexed.withColumn("x", indexed["voltage"])
    every = wavelet_smooth(filled, "x", ["s"]).toPandas().set_index(["s", "row_no"]).sort_index()
    got = wavelet_smooth(filled, "x", ["s"], zero_below=16).toPandas().set_index(["s", "row_no"]).sort_index()
    want = filled.toPandas().set_index(["s", "row_no"]).sort_index()
    long = want["series_rows"] >= 16
    assert np.allclose(got["wavelet"][long], want["x"][long])
    assert (got["wavelet"][~long] == 0).all()
    assert np.allclose(every["wavelet"], want["x"])


def test_wavelet_of_short_series(spark):
    rows = [(n, i, float((i * 7 + n) % 5) - 1.5) for n in range(1, 12) for i in range(n)]
    df = ordered.index_rows(spark.createDataFrame(rows, "s int, id int, v double"), ["id"], ["s"])
    got = wavelet_smooth(df, "v", ["s"]).join(df.select("s", "row_no", "v"), ["s", "row_no"]).toPandas()
    assert len(got) == len(rows) and np.allclose(got["wavelet"], got["v"])


def test_wavelet_gap_spoils_its_reach(spark):
    df = spark.createDataFrame([(i, None if i == 0 else float(i)) for i in range(200)], "id long, v double")
    got = wavelet_smooth(ordered.index_rows(df, ["id"]), "v").orderBy("row_no").toPandas()["wavelet"]
    assert got[:48].isna().all() and np.allclose(got[48:], np.arange(48, 200))


def test_feature_table_of_one_series(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(rng.normal()), float(rng.normal()), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, current double, voltage double, power double")
    out = ops.series_features(df, ["id"], block_rows=16).toPandas().sort_values("row_no")
    assert "power" not in out and out["row_no"].tolist() == list(range(51)) and out["source_row"].min() == 9
    assert (out["series_rows"] == 51).all()
