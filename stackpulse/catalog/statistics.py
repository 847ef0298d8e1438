"""Aggregates, profiles, evaluation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as cell_ops, clean, evaluate, profile, scale
from ..operators.quantiles import quantile, quantiles
from ..session import scratch_path
from ..sources import models
from .registry import CELLS_SQL, cells_table, query, r6, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


def _line(spark, sf, *cols):
    return table(spark, sf, "lineitem").select(*LINE_KEY, *cols)


@query("d01_fill_means", """
SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN (SELECT avg(value) FROM events WHERE event_id % 7 <> 0) ELSE value END, 6) AS value FROM events""")
def d01(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return clean.fill_means(rows, ["value"]).select("event_id", r6("value").alias("value"))


@query("d02_zero_to_mean", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN (SELECT avg(l_discount) FROM lineitem) ELSE l_discount END, 6) AS l_discount FROM lineitem""")
def d02(spark, sf):
    return clean.zero_to_mean(_line(spark, sf, "l_discount"), ["l_discount"]).withColumn("l_discount", r6("l_discount"))


@query("d03_zero_to_median", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN (SELECT median(l_tax) FROM lineitem) ELSE l_tax END, 6) AS l_tax FROM lineitem""")
def d03(spark, sf):
    return clean.zero_to_median(_line(spark, sf, "l_tax"), ["l_tax"]).withColumn("l_tax", r6("l_tax"))


@query("d04_zero_to_nonzero_stats", """
SELECT l_orderkey, l_linenumber,
 round(CASE WHEN l_discount = 0 THEN (SELECT avg(l_discount) FROM lineitem WHERE l_discount <> 0) ELSE l_discount END, 6) AS l_discount,
 round(CASE WHEN l_tax = 0 THEN (SELECT median(l_tax) FROM lineitem WHERE l_tax <> 0) ELSE l_tax END, 6) AS l_tax FROM lineitem""")
def d04(spark, sf):
    rows = clean.zero_to_mean(_line(spark, sf, "l_discount", "l_tax"), ["l_discount"], nonzero=True)
    rows = clean.zero_to_median(rows, ["l_tax"], nonzero=True)
    return rows.withColumns({"l_discount": r6("l_discount"), "l_tax": r6("l_tax")})


@query("d05_fill_stored_means", """
SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN (SELECT avg(value) FROM events WHERE event_id % 2 = 0) ELSE value END, 6) AS value FROM events""")
def d05(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    means = clean.stored_means(ev.filter("event_id % 2 = 0"), ["value"]).first().asDict()
    rows = ev.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return clean.fill_stored(rows, means).withColumn("value", r6("value"))


@query("d06_row_std", f"WITH {CELLS_SQL} SELECT vec_id, round(list_aggregate(c, 'stddev_samp'), 6) AS Cell_Voltage_Std FROM cells")
def d06(spark, sf):
    return cell_ops.cell_features(cells_table(spark, sf)).select("vec_id", r6("Cell_Voltage_Std").alias("Cell_Voltage_Std"))


@query("d07_row_min", f"WITH {CELLS_SQL} SELECT vec_id, round(list_min(c), 6) AS Min_Cell_Voltage FROM cells")
def d07(spark, sf):
    return cell_ops.cell_features(cells_table(spark, sf)).select("vec_id", r6("Min_Cell_Voltage").alias("Min_Cell_Voltage"))


@query("d08_row_argmin", f"WITH {CELLS_SQL} SELECT vec_id, 'Cell' || list_position(c, list_min(c)) AS Min_Cell_Index FROM cells")
def d08(spark, sf):
    return cell_ops.cell_features(cells_table(spark, sf)).select("vec_id", "Min_Cell_Index")


PROBS = [0.01, 0.25, 0.5, 0.9, 0.99]


@query("d09_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem" for c in LINE for p in PROBS))
def d09(spark, sf):
    got = quantiles(table(spark, sf, "lineitem"), {c: PROBS for c in LINE})
    rows = [(c, p, v) for c, values in got.items() for p, v in zip(PROBS, values)]
    return spark.createDataFrame(rows, "column string, p double, value double").withColumn("value", r6("value"))


def _clip_sql(lo: str, hi: str) -> str:
    picks = ", ".join(f"round(least(greatest({c}, {c}_lo), {c}_hi), 6) AS {c}" for c in LINE)
    bounds = ", ".join(f"{lo.format(c=c)} AS {c}_lo, {hi.format(c=c)} AS {c}_hi" for c in LINE)
    return f"SELECT l_orderkey, l_linenumber, {picks} FROM lineitem, (SELECT {bounds} FROM lineitem)"


@query("d10_quantile_clip", _clip_sql("quantile_cont({c}, 0.01)", "quantile_cont({c}, 0.99)"))
def d10(spark, sf):
    return clean.winsorise_quantile(_line(spark, sf, *LINE), LINE).withColumns({c: r6(c) for c in LINE})


@query("d11_iqr_clip", _clip_sql(
    "quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
    "quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def d11(spark, sf):
    return clean.winsorise_iqr(_line(spark, sf, *LINE), LINE).withColumns({c: r6(c) for c in LINE})


@query("d12_zscore_filter", "SELECT l_orderkey, l_linenumber FROM lineitem, (SELECT "
       + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in LINE)
       + " FROM lineitem) WHERE " + " AND ".join(f"abs({c} - {c}_m) / {c}_s < 1.6" for c in LINE))
def d12(spark, sf):
    # A tighter limit than 3 so that uniform columns lose rows at all.
    rows = _line(spark, sf, *LINE).withColumn("flat", F.lit(4.0))
    return clean.zscore_filter(rows, [*LINE, "flat"], 1.6).select(*LINE_KEY)


def _profile_sql(cols: list[str], pick: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c.split()[-1]}' AS \"column\", {pick.format(c=c.split()[0])} FROM (SELECT *, 4.0::DOUBLE AS flat FROM lineitem)" for c in cols)


def _with_flat(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE, F.lit(4.0).alias("flat"))


@query("d13_constant_columns", _profile_sql([*LINE, "flat"], "count(DISTINCT {c}) = 1 AS is_constant"))
def d13(spark, sf):
    return profile.spread_profile(_with_flat(spark, sf), [*LINE, "flat"]).select("column", "is_constant")


@query("d14_low_spread", _profile_sql([*LINE, "flat"], "round(stddev_samp({c}), 4) AS std, stddev_samp({c}) < 0.03 AS is_low"))
def d14(spark, sf):
    rows = _with_flat(spark, sf)
    low = profile.low_spread_columns(rows, [*LINE, "flat"], 0.03)
    return profile.spread_profile(rows, [*LINE, "flat"]).select(
        "column", F.round("std", 4).alias("std"), F.col("column").isin(low).alias("is_low"))


@query("d15_low_variance", _profile_sql([*LINE, "flat"], "round(var_samp({c}), 4) AS var, var_samp({c}) < 0.01 AS is_low"))
def d15(spark, sf):
    rows = _with_flat(spark, sf)
    low = profile.low_variance_columns(rows, [*LINE, "flat"], 0.01)
    return profile.spread_profile(rows, [*LINE, "flat"]).select(
        "column", F.round("var", 4).alias("var"), F.col("column").isin(low).alias("is_low"))


@query("d16_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM "
    + ("(SELECT 1)" if a == b else "lineitem") for a in LINE for b in LINE))
def d16(spark, sf):
    return profile.correlation_matrix(table(spark, sf, "lineitem"), LINE).withColumn("r", r6("r"))


@query("d17_correlation_prune", """
SELECT * FROM (SELECT 'net' AS "column", abs(corr(l_extendedprice, l_extendedprice * (1 - l_discount))) > 0.9 AS k FROM lineitem
UNION ALL SELECT 'l_extendedprice', abs(corr(l_quantity, l_extendedprice)) > 0.9 FROM lineitem
UNION ALL SELECT 'l_discount', abs(corr(l_quantity, l_discount)) > 0.9 OR abs(corr(l_extendedprice, l_discount)) > 0.9 FROM lineitem)
WHERE k""".replace("SELECT * FROM", 'SELECT "column" FROM', 1))
def d17(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return profile.correlated_columns(rows, ["l_quantity", "l_extendedprice", "l_discount", "net"]).select("column")


@query("d18_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def d18(spark, sf):
    return cell_ops.value_counts(table(spark, sf, "events"), "event_type")


@query("d19_mode", f"""
WITH {CELLS_SQL} SELECT min_cell, n FROM (SELECT CAST(list_position(c, list_min(c)) AS INTEGER) AS min_cell, count(*) AS n FROM cells GROUP BY 1)
ORDER BY n DESC, min_cell LIMIT 1""")
def d19(spark, sf):
    return cell_ops.mode(cell_ops.cell_features(cells_table(spark, sf)), "min_cell")


@query("d20_anomaly_summary", f"""
WITH {CELLS_SQL}, s AS (
  SELECT DISTINCT vec_id, label, list_min(c) AS v, list_position(c, list_min(c)) AS cell, list_aggregate(c, 'stddev_samp') AS sd FROM cells),
 f AS (SELECT *, sd > (SELECT quantile_cont(sd, 0.9) FROM s) AS flag FROM s),
 a AS (SELECT * FROM f WHERE flag)
SELECT (SELECT count(*) FROM f) AS total_rows, (SELECT count(*) FROM a) AS total_anomalies,
  round((SELECT count(*) FROM a) * 100.0 / (SELECT count(*) FROM f), 6) AS anomaly_percentage,
  (SELECT 'Cell' || cell FROM a GROUP BY cell ORDER BY count(*) DESC, cell LIMIT 1) AS most_affected_cell,
  round((SELECT min(v) FROM a), 6) AS min_voltage, round((SELECT max(v) FROM a), 6) AS max_voltage,
  round((SELECT avg(label) FROM a), 6) AS avg_Load""")
def d20(spark, sf):
    rows = cell_ops.cell_features(clean.drop_duplicate_rows(cells_table(spark, sf))).withColumnRenamed("label", "Load")
    cut = quantile(rows, "Cell_Voltage_Std", 0.9)
    flagged = rows.withColumn("flag", F.col("Cell_Voltage_Std") > F.lit(cut))
    out = cell_ops.anomaly_summary(flagged, "flag", means=["Load"])
    return out.withColumns({c: r6(c) for c in ("anomaly_percentage", "min_voltage", "max_voltage", "avg_Load")})


@query("d21_prediction_summary", """
SELECT count(*) AS total_rows, round(avg(c_acctbal), 4) AS mean_predicted, min(c_acctbal) AS min_predicted, max(c_acctbal) AS max_predicted FROM customer""")
def d21(spark, sf):
    return cell_ops.prediction_summary(table(spark, sf, "customer"), "c_acctbal").withColumn("mean_predicted", F.round("mean_predicted", 4))


@query("d22_health_summary", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.5) AS mid FROM customer)
SELECT CASE WHEN c_acctbal < lo THEN 'Critical' WHEN c_acctbal < mid THEN 'Degraded' ELSE 'Healthy' END AS state, count(*) AS n,
 CASE WHEN c_acctbal < lo THEN '< ' || format('{:.3f}', lo) || ' V' WHEN c_acctbal < mid THEN format('{:.3f}', lo) || '–' || format('{:.3f}', mid) || ' V'
      ELSE '≥ ' || format('{:.3f}', mid) || ' V' END AS threshold
FROM customer, q GROUP BY ALL""")
def d22(spark, sf):
    from ..functions.scalars import HEALTH_LABELS, left_closed_bins, map_codes
    rows = table(spark, sf, "customer")
    lo, mid = quantiles(rows, {"c_acctbal": [0.05, 0.5]})["c_acctbal"]
    rows = rows.withColumn("state", map_codes(left_closed_bins(F.col("c_acctbal"), [lo, mid]), HEALTH_LABELS))
    return cell_ops.health_summary(rows, "state", lo, mid)


def _describe_sql(c: str, numeric: bool) -> str:
    if numeric:
        return (f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq, "
                f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, "
                f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM lineitem")
    return (f"SELECT '{c}', sum(n)::BIGINT, count(*), max_by(v, (n, v)), max(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL "
            f"FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1)")


@query("d23_describe", " UNION ALL ".join(_describe_sql(c, True) for c in LINE) + " UNION ALL "
       + " UNION ALL ".join(_describe_sql(c, False) for c in ("l_returnflag", "l_linestatus")))
def d23(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINE, "l_returnflag", "l_linestatus")
    out = profile.describe_all(rows)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query("d24_class_histogram", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def d24(spark, sf):
    return cell_ops.value_counts(table(spark, sf, "orders"), "o_orderstatus")


SCORED = "SELECT quality AS y, CASE WHEN toxic = 1 THEN 0 ELSE CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END END AS p FROM labels"


def _scored(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("quality").alias("y"),
        F.when(F.col("toxic") == 1, 0).when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("p"))


@query("d25_confusion_matrix", f"""
SELECT y AS label, count(*) FILTER (p = 0) AS pred_0, count(*) FILTER (p = 1) AS pred_1, count(*) FILTER (p = 2) AS pred_2 FROM ({SCORED}) GROUP BY 1""")
def d25(spark, sf):
    return evaluate.confusion_matrix(_scored(spark, sf), "y", "p", [0, 1, 2])


PER_CLASS = f"""s AS ({SCORED}), k AS (SELECT y AS c FROM s UNION SELECT p FROM s),
t AS (SELECT c, (SELECT count(*) FROM s WHERE y = c) AS support, (SELECT count(*) FROM s WHERE p = c) AS claimed,
        (SELECT count(*) FROM s WHERE y = c AND p = c) AS hits FROM k),
u AS (SELECT *, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS pr, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS rc FROM t),
v AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM u)"""


@query("d26_weighted_metrics", f"""
WITH {PER_CLASS} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS "precision",
 round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM v""")
def d26(spark, sf):
    out = evaluate.classification_metrics(_scored(spark, sf), "y", "p")
    return out.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("d27_balanced_accuracy", f"WITH {PER_CLASS} SELECT round(avg(rc) FILTER (support > 0), 6) AS balanced_accuracy FROM v")
def d27(spark, sf):
    return evaluate.balanced_accuracy(_scored(spark, sf), "y", "p").withColumn("balanced_accuracy", r6("balanced_accuracy"))


@query("d28_classification_report", f"""
WITH {PER_CLASS} SELECT CAST(c AS VARCHAR) AS "class", round(pr, 6) AS "precision", round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM v
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), sum(support)::BIGINT FROM v
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM v""")
def d28(spark, sf):
    out = evaluate.classification_report(_scored(spark, sf), "y", "p")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


SCORES = "g AS (SELECT CAST(n_chars AS DOUBLE) AS s, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM labels JOIN documents USING (doc_id) GROUP BY 1)"


def _quality_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf, "labels").join(docs, "doc_id")


@query("d29_precision_recall_curve", f"""
WITH {SCORES}, c AS (SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM g WINDOW w AS (ORDER BY s DESC))
SELECT s AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / p, 6) AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0""")
def d29(spark, sf):
    out = evaluate.precision_recall_curve(_quality_scores(spark, sf), "score", F.col("quality") == 1)
    return out.withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query("d29_one_vs_rest_curves", """
WITH r AS (SELECT unnest([0, 1, 2]) AS class, unnest([CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE), l_quantity / 50.0]) AS s,
 unnest([l_returnflag = 'A', l_returnflag = 'N', l_returnflag = 'R']) AS hit FROM lineitem),
g AS (SELECT class, s, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM r GROUP BY 1, 2),
c AS (SELECT class, s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS p FROM g WINDOW w AS (PARTITION BY class ORDER BY s DESC))
SELECT class, round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / p, 6) AS recall FROM c
UNION ALL SELECT DISTINCT class, NULL, 1.0, 0.0 FROM c""")
def d29_classes(spark, sf):
    chances = F.array(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_quantity") / 50.0)
    code = F.array_position(F.array(*map(F.lit, "ANR")), F.col("l_returnflag")) - 1
    rows = table(spark, sf, "lineitem").select(code.cast("int").alias("label"), chances.alias("chances"))
    out = evaluate.one_vs_rest_curves(rows, "label", "chances", [0, 1, 2])
    return out.withColumns({c: r6(c) for c in ("threshold", "precision", "recall")})


@query("d30_roc_curve", f"""
WITH {SCORES}, c AS (SELECT s, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY s DESC))
SELECT s AS threshold, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr FROM c""")
def d30_curve(spark, sf):
    out = evaluate.roc_curve(_quality_scores(spark, sf), "score", F.col("quality") == 1)
    return out.withColumns({"tpr": r6("tpr"), "fpr": r6("fpr")})


@query("d30_roc_auc", f"""
WITH {SCORES}, c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM g)
SELECT round(sum(pos * (less + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c""")
def d30(spark, sf):
    return evaluate.roc_auc(_quality_scores(spark, sf), "score", F.col("quality") == 1).withColumn("roc_auc", r6("roc_auc"))


@query("d31_regression_metrics", """
SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(l_extendedprice), 6) AS r2
FROM (SELECT l_extendedprice, l_extendedprice - l_quantity * 1500 AS e FROM lineitem)""")
def d31(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    out = evaluate.regression_metrics(rows, "l_extendedprice", "p")
    return out.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6("r2").alias("r2"))


@query("d35_class_weights", """
SELECT o_orderkey, o_orderstatus, round(w, 6) AS weight FROM orders JOIN (
 SELECT o_orderstatus, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM orders GROUP BY 1) USING (o_orderstatus)""")
def d35(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return evaluate.with_class_weight(rows, "o_orderstatus").withColumn("weight", r6("weight"))


def _anova_sql(c: str) -> str:
    return (f"SELECT '{c}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM ("
            f"SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS g FROM ("
            f"SELECT count({c}) AS n, avg({c}) AS m, var_samp({c}) AS v FROM lineitem GROUP BY l_returnflag))")


@query("f05_select_k_best", "SELECT feature, round(f, 4) AS f_score FROM (" + " UNION ALL ".join(_anova_sql(c) for c in LINE)
       + ") ORDER BY f DESC, feature LIMIT 3")
def f05(spark, sf):
    return profile.select_k_best(table(spark, sf, "lineitem"), LINE, "l_returnflag", 3).withColumn("f_score", F.round("f_score", 4))


def _scale_sql(offset: str, width: str) -> str:
    picks = ", ".join(f"round(({c} - {c}_o) / {c}_w, 6) AS {c}" for c in LINE)
    params = ", ".join(f"{offset.format(c=c)} AS {c}_o, {width.format(c=c)} AS {c}_w" for c in LINE)
    return f"SELECT l_orderkey, l_linenumber, {picks}, 0.0::DOUBLE AS flat FROM lineitem, (SELECT {params} FROM lineitem)"


def _scaled(spark, sf, fit):
    rows = _line(spark, sf, *LINE).withColumn("flat", F.lit(4.0))
    cols = [*LINE, "flat"]
    return scale.apply_scale(rows, fit(rows, cols)).withColumns({c: r6(c) for c in cols})


@query("i01_minmax_scale", _scale_sql("min({c})", "(max({c}) - min({c}))"))
def i01(spark, sf):
    return _scaled(spark, sf, scale.fit_minmax)


@query("i02_standard_scale", _scale_sql("avg({c})", "stddev_pop({c})"))
def i02(spark, sf):
    return _scaled(spark, sf, scale.fit_standard)


@query("i02_stored_scale", _scale_sql("avg({c})", "stddev_pop({c})"))
def i02_stored(spark, sf):
    """Scale whose parameters come back from the table beside a model."""
    path = scratch_path(spark, "scale")

    def fit(rows, columns):
        models.save_table(scale.scale_table(rows, scale.fit_standard(rows, columns)), path)
        return scale.load_scale(models.load_table(spark, path))

    return _scaled(spark, sf, fit)


@query("i03_robust_scale", _scale_sql("median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def i03(spark, sf):
    return _scaled(spark, sf, scale.fit_robust)
