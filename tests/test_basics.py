import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from stackpulse import schema, session
from stackpulse.functions import arrays, scalars
from stackpulse.operators import clean, profile, scale
from stackpulse.sources import sinks, tables


def test_names():
    assert schema.snake("TinH2 (°C)") == "tinh2_c" and schema.snake("J (A/cmÂ²)") == schema.snake("J (A/cm²)") == "j_a_cm2"
    names = schema.AGEING_FIELDS + schema.AGEING_TARGETS
    assert len({schema.snake(n) for n in names}) == len(names)


def test_require_columns(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="Load"):
        schema.require_columns(df, ["id", "Load"])


def test_dispatch():
    assert tables.format_of("a/b.CSV") == "csv"
    with pytest.raises(ValueError):
        tables.format_of("a/b.xlsx")


def test_records_with_wrong_cells_are_refused(spark):
    good = '{"Date_Time": "2024-01-01", "Load": 1.5, "Cell_Voltages": [0.1, 0.2]}'
    df = spark.createDataFrame([(good,), ('{"Cell_Voltages": [1.0]}',), ("no json",)], "body string")
    flat, refused = tables.parse_stack_records(df, "body", 2)
    assert flat.first()["Cell2"] == 0.2 and flat.first()["Load"] == 1.5 and refused.count() == 2


def test_strict_map(spark):
    df = spark.createDataFrame([({"a": 1.0, "x": 9.0},)], "m map<string,double>")
    r = tables.map_features(df, "m", ["a", "b"], fill=None).first()
    assert r["a"] == 1.0 and r["b"] is None and r["missing_features"] == ["b"] and "x" not in r.asDict()


def test_row_statistics_with_nulls(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],), ([None, None, None],), ([2.0, None, None],), ([],)], "c array<double>")
    got = [r["s"] for r in df.select(arrays.array_std(F.col("c")).alias("s")).collect()]
    assert np.isclose(got[0], np.sqrt(2)) and got[1:] == [None, None, None]


def test_bins_and_hash(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (9.0,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(scalars.left_closed_bins(F.col("v"), [2.0, 9.0])).collect()] == [0, 1, -1, 2, -1]
    h = [r[0] for r in spark.range(20000).select(scalars.unit_hash(F.col("id"), 3)).collect()]
    assert abs(np.mean(h) - .5) < .01 and abs(np.var(h) - 1 / 12) < .005 and len(set(h)) > 19900
    assert spark.range(1).select(scalars.id_hash(F.lit(2**62))).first()[0] >= 0


def test_zero_modes_on_empty_columns(spark):
    df = spark.createDataFrame([(0.0, None), (0.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in clean.zero_to_mean(df, ["a", "b"], nonzero=True).collect()] == [(0.0, 0.0)] * 2
    assert [tuple(r) for r in clean.zero_to_median(df, ["a", "b"], nonzero=True).collect()] == [(0.0, 0.0)] * 2


def test_zscore_skips_flat_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)] + [(1000.0, 1.0)], "a double, b double")
    assert clean.zscore_filter(df, ["a", "b"]).count() == 20


def test_constant_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    for fit in (scale.fit_minmax, scale.fit_standard, scale.fit_robust):
        assert [r["a"] for r in scale.apply_scale(df, fit(df, ["a"])).collect()] == [0.0, 0.0]


def test_empty_input(spark):
    df = spark.createDataFrame([], "a double, g string")
    assert clean.winsorise_quantile(df, ["a"]).count() == 0
    assert clean.fill_means(df, ["a"]).count() == 0
    assert profile.spread_profile(df, ["a"]).first()["n"] == 0


def test_times(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("x",)], "t string")
    with pytest.raises(ValueError):
        clean.require_valid_times(df, "t")
    good, bad = clean.quarantine_times(df, "t")
    assert good.count() == bad.count() == 1


def test_cell_number_is_checked(spark):
    with pytest.raises(ValueError):
        sinks.read_cell(spark, "/nowhere", T.StructType(), 97)


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            applicationId = "x"

    with pytest.raises(RuntimeError):
        session.scratch_root(Fake())


def test_marks_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = clean.zero_to_mean(df.select("l_orderkey", "l_tax"), ["l_tax"]).filter("l_orderkey < 10")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), LessThan(l_orderkey,10)]" in text and "l_comment" not in text
