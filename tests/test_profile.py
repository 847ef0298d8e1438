import numpy as np
import pandas as pd

from stackpulse.operators import profile

SCHEMA = "a double, b double, c double, d double, e double, f double"


def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x[:, 1] = 2 * x[:, 0] + 0.1 * x[:, 1]
    x[:, 2] = 1e9 + 1e-3 * (x[:, 0] + x[:, 2])
    x[:, 3] = 7.1
    df = pd.DataFrame(x, columns=list("abcdef"))
    df.loc[df.index % 3 == 0, "e"] = None
    df.loc[df.index % 5 == 1, "a"] = None
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in df.itertuples(index=False)]
    return df, spark.createDataFrame(rows, SCHEMA).repartition(5)


def pairs(df):
    return {(r["a"], r["b"]): r["r"] for r in profile.correlation_pairs(df, list("abcdef")).collect()}


def test_correlation_over_rows_that_have_both(spark):
    plain, df = table(spark)
    got, want = pairs(df), plain.assign(c=plain["c"] - 1e9).corr()
    assert len(got) == 15
    for (a, b), r in got.items():
        if "d" in (a, b):
            assert r is None
        else:
            assert abs(r - want.loc[a, b]) < 1e-12


def test_correlation_of_odd_tables(spark):
    _, df = table(spark)
    assert set(pairs(df.limit(0)).values()) == {None}
    assert set(pairs(df.limit(1)).values()) == {None}
    odd = df.unionByName(spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, float("nan"), float("inf"))], SCHEMA))
    got = pairs(odd)
    assert all(np.isnan(r) for k, r in got.items() if {"e", "f"} & set(k) and r is not None)
    assert got["a", "b"] > 0.9 and np.isnan(got["a", "f"]) and np.isnan(got["e", "f"])


def test_correlation_of_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 700))
    x[:, 699] = -x[:, 0]
    wide = spark.createDataFrame(pd.DataFrame({"v": list(x)})).repartition(3)
    names = [f"c{i}" for i in range(700)]
    df = wide.select(*[wide["v"][i].alias(n) for i, n in enumerate(names)])
    found = profile.correlated_columns(df, names, 0.9).collect()
    assert [(r["column"], r["position"]) for r in found] == [("c699", 699)]
