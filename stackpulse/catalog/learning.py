"""Detection, learning, reports and streaming jobs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F, types as T

from ..functions.scalars import id_hash_sql
from ..operators import balance, cells as cell_ops, evaluate, forest, learn, ordered, reduce, series as ops, windows
from ..operators.warping import warp_distances
from ..plans import classifiers, stack, votes
from ..session import materialise, scratch_path
from ..sources import models, tables
from ..streaming import scoring
from .neighbours import DBSCAN
from .registry import N_CELLS, ORDER, SERIES, SERIES_SQL, cells_table, query, r6, series_table, table

PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_retailprice"]


def _priced(spark, sf):
    """Line items with the list price of their part and one integer key."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, sf, "lineitem").join(part, "l_partkey")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), "l_extendedprice", *PRICE_FEATURES)


def _priced_states(spark, sf):
    return learn.health_labels(materialise(_priced(spark, sf), "priced"), "l_extendedprice")[0]


@query("i04_pca")
def i04(spark, sf):
    rows = cells_table(spark, sf)
    return reduce.with_pca_columns(rows, reduce.fit_pca(rows, "cells", 2), "cells").select("vec_id", "PCA1", "PCA2")


@query("i05_truncated_svd")
def i05(spark, sf):
    rows = cells_table(spark, sf)
    return reduce.with_pca_columns(rows, reduce.fit_svd(rows, "cells", 4), "cells", "SVD").drop("cells", "label")


# Sums of even powers of all singular values are traces of powers of the table's
# product with itself.
@query("i05_singular_values", """
WITH v AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
g AS (SELECT a.p AS i, b.p AS j, sum(a.x * b.x) AS g FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2),
h AS (SELECT a.i, b.j, sum(a.g * b.g) AS h FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2),
m AS (SELECT 1 AS power, sum(g) AS total FROM g WHERE i = j UNION ALL SELECT 2, sum(g * g) FROM g
 UNION ALL SELECT 3, sum(g.g * h.h) FROM g JOIN h ON g.i = h.j AND g.j = h.i UNION ALL SELECT 4, sum(h * h) FROM h)
SELECT power, round(log10(total), 8) AS log_total FROM m""")
def i05_singular(spark, sf):
    axes = reduce.fit_svd(cells_table(spark, sf), "cells", N_CELLS)
    values = spark.createDataFrame([(axes.singular,)], "s array<double>").select(F.explode("s").alias("s"))
    powers = values.select("s", F.explode(F.array(*[F.lit(p) for p in (1, 2, 3, 4)])).alias("power"))
    return powers.groupBy("power").agg(F.round(F.log10(F.sum(F.pow("s", 2 * F.col("power")))), 8).alias("log_total"))


# The batch scaled to [0, 1] takes the place of the raw cells.
STACK = """stack AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS raw FROM embeddings),
feat AS (SELECT vec_id, list_concat([CASE WHEN label = 0 THEN (SELECT avg(label) FROM stack WHERE label <> 0) ELSE label END,
  list_aggregate(raw, 'stddev_samp')], raw) AS v FROM stack),
pos AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM feat),
scaled AS (SELECT vec_id, p, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS x FROM pos WINDOW w AS (PARTITION BY p)),
cells AS (SELECT vec_id, list(x ORDER BY p) AS c FROM scaled GROUP BY 1)"""
STACK_DBSCAN = STACK + DBSCAN[DBSCAN.index(", d AS"):]
REPORT_SQL = f"""WITH RECURSIVE labelled AS (WITH RECURSIVE {STACK_DBSCAN}),
rows_ AS (SELECT vec_id, label, list_min(CAST(embedding AS DOUBLE[])) AS v, list_position(embedding, list_min(embedding)) AS cell, "Cluster" = -1 AS hit
  FROM embeddings JOIN labelled USING (vec_id)), a AS (SELECT * FROM rows_ WHERE hit)
SELECT (SELECT count(*) FROM rows_) AS total_rows, (SELECT count(*) FROM a) AS total_anomalies,
 round((SELECT count(*) FROM a) * 100.0 / (SELECT count(*) FROM rows_), 6) AS anomaly_percentage,
 (SELECT 'Cell' || cell FROM a GROUP BY cell ORDER BY count(*) DESC, cell LIMIT 1) AS most_affected_cell,
 round((SELECT min(v) FROM a), 6) AS min_voltage, round((SELECT max(v) FROM a), 6) AS max_voltage, round((SELECT avg(label) FROM a), 6) AS avg_Load"""


def _rounded_summary(df):
    return df.withColumns({c: r6(c) for c in ("anomaly_percentage", "min_voltage", "max_voltage", "avg_Load")})


@query("i08_stack_report", REPORT_SQL)
def i08(spark, sf):
    rows = cells_table(spark, sf).withColumnRenamed("label", "Load")
    return _rounded_summary(stack.stack_report(rows, "vec_id", conditions=["Load"], n_cells=N_CELLS).summary)


@query("i09_health_labels", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.05) AS lo, quantile_cont(c_acctbal, 0.5) AS mid FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < lo THEN 0 WHEN c_acctbal < mid THEN 1 ELSE 2 END AS code FROM customer, q""")
def i09(spark, sf):
    rows, _ = learn.health_labels(table(spark, sf, "customer"), "c_acctbal")
    return rows.select("c_custkey", F.col("Health_State_Code").alias("code"))


@query("i10_augment_extremes", f"""
WITH a AS (SELECT c_custkey::DOUBLE AS t FROM customer
 UNION ALL SELECT c_custkey + 100 FROM customer WHERE {id_hash_sql('c_custkey', 42)} % 10000 < 500
 UNION ALL SELECT c_custkey - 50 FROM customer WHERE {id_hash_sql('c_custkey', 43)} % 10000 < 500)
SELECT count(*) AS n, sum(t) AS total_time FROM a""")
def i10(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("double").alias("time"), "c_acctbal")
    return learn.augment_extremes(rows, "c_acctbal", "time", key="c_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("time").alias("total_time"))


@query("i11_random_split", f"""
SELECT o_orderkey, CASE WHEN {id_hash_sql('o_orderkey', 42)} % 10000 < 8000 THEN 'train' ELSE 'test' END AS part FROM orders""")
def i11(spark, sf):
    train, test = balance.hash_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


RANKED = f"""(SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
 row_number() OVER (PARTITION BY o_orderstatus ORDER BY {id_hash_sql('o_orderkey', 42)}, o_orderkey) - 1 AS r FROM orders)"""


@query("i12_stratified_split", f"SELECT o_orderkey, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM {RANKED}")
def i12(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    train, test = balance.stratified_split(rows, "o_orderkey", "o_orderstatus")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).drop("o_orderstatus")


@query("i18_stratified_folds", f"SELECT o_orderkey, CAST(r % 2 AS INTEGER) AS fold FROM {RANKED}")
def i18_folds(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return balance.stratified_folds(rows, "o_orderkey", "o_orderstatus").select("o_orderkey", "fold")


@query("i13_random_forest")
def i13(spark, sf):
    train, test = balance.stratified_split(_priced_states(spark, sf), "key", "Health_State_Code")
    model = learn.train_forest(materialise(train, "train"), PRICE_FEATURES, "Health_State_Code", 100, 10)
    return evaluate.classification_metrics(model.transform(test), "Health_State_Code", "prediction")


@query("i14_retrain_on_top")
def i14(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), F.col("l_shipdate").cast("timestamp").cast("double").alias("time"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    _, _, metrics, _ = classifiers.train_health(rows, "key", "l_extendedprice", "time", trees=100, depth=10)
    return metrics


@query("i15_boosted_trees")
def i15(spark, sf):
    rows = _priced(spark, sf)
    train, test = balance.hash_split(rows, "key")
    model = learn.train_boosted(materialise(train, "train"), PRICE_FEATURES, "l_extendedprice", n_estimators=100, max_depth=7)
    return evaluate.regression_metrics(learn.score_voltage(test, model, "predicted"), "l_extendedprice", "predicted")


@query("i16_logistic_regression")
def i16(spark, sf):
    train, test = balance.stratified_split(_priced_states(spark, sf), "key", "Health_State_Code")
    model = learn.train_logistic(materialise(train, "train"), PRICE_FEATURES, "Health_State_Code")
    return evaluate.classification_metrics(model.transform(test), "Health_State_Code", "prediction")


@query("i17_grid_search_regression")
def i17(spark, sf):
    _, metrics, rmse = classifiers.train_voltage(_priced(spark, sf), "key", "l_extendedprice")
    return metrics.withColumn("cv_rmse", F.lit(rmse))


@query("i18_grid_search_classifier")
def i18(spark, sf):
    rows = _priced_states(spark, sf).drop("Health_State", "l_extendedprice")
    folded = materialise(balance.stratified_folds(rows, "key", "Health_State_Code"), "folded")

    def prepare(train):
        return Pipeline(stages=[
            learn.preparation_stage(train, PRICE_FEATURES, bounds=None),
            VectorAssembler(inputCols=[f"x_{c}" for c in PRICE_FEATURES], outputCol="features")]).fit(train)

    search, _ = learn.tune_forest(folded, "Health_State_Code", "fold", prepare=prepare, weighted=True)
    return learn.search_table(search, spark)


@query("i18_tuned_fault")
def i18_fault(spark, sf):
    rows = _priced_states(spark, sf).drop("Health_State", "l_extendedprice")
    _, scored, _, score = classifiers.train_fault(rows, "key", "Health_State_Code")
    return evaluate.classification_metrics(scored, "Health_State_Code", "predicted_class").withColumn("cv_balanced_accuracy", F.lit(score))


@query("i19_smote_counts", """
SELECT label, n AS original, max(n) OVER () - n AS synthetic FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)""")
def i19(spark, sf):
    grown = balance.smote(cells_table(spark, sf), "vec_id", "cells", "label")
    return grown.groupBy("label").agg(
        F.count_if(~F.col("synthetic")).alias("original"), F.count_if(F.col("synthetic")).alias("synthetic"))


def _fitted_forest(spark, sf):
    rows = _priced_states(spark, sf)
    return rows, learn.train_forest(rows, PRICE_FEATURES, "Health_State_Code", 100, 10)


@query("i20_feature_importance")
def i20(spark, sf):
    return learn.importances(_fitted_forest(spark, sf)[1], spark)


@query("f01_sorted_importances")
def f01(spark, sf):
    return learn.importances(_fitted_forest(spark, sf)[1], spark).orderBy(F.desc("importance"), "feature")


@query("f03_important_features")
def f03(spark, sf):
    return learn.importances(_fitted_forest(spark, sf)[1], spark).filter("importance > 0.05")


@query("i21_score_batch")
def i21(spark, sf):
    rows, model = _fitted_forest(spark, sf)
    return learn.score_health(rows.drop("Health_State", "Health_State_Code"), model).select("key", "Health_State_Predicted", "Health_State_Label")


@query("a12_model_save_load")
def a12(spark, sf):
    rows, model = _fitted_forest(spark, sf)
    path = scratch_path(spark, "a12")
    models.save_model(model, path)
    return learn.score_fault(rows.select("key", *PRICE_FEATURES), models.load_model(path)).select(
        "key", "predicted_class", "prediction_label", "confidence")


@query("i22_isolation_forest")
def i22(spark, sf):
    rows = cells_table(spark, sf)
    model = forest.fit_forest(rows, "vec_id", "cells").with_threshold(rows, "cells")
    return model.flag(rows, "cells").select("vec_id", "iso_anomaly")


@query("i27_shapley")
def i27(spark, sf):
    rows = cells_table(spark, sf)
    model = forest.fit_forest(rows, "vec_id", "cells")
    base = forest.background_rows(rows, "vec_id", "cells")
    return forest.shapley_values(rows, "vec_id", "cells", model, base)


def _plain_series(spark, sf):
    return ordered.index_rows(series_table(spark, sf), ORDER, SERIES)


@query("i23_dtw_distance")
def i23(spark, sf):
    rows = _plain_series(spark, sf)
    ref = ops.reference_window(rows, ["current", "voltage"], series=SERIES)
    return warp_distances(rows, ["current", "voltage"], ref, 30, SERIES)


@query("i24_reconstruction_error")
def i24(spark, sf):
    rows = materialise(_plain_series(spark, sf), "series")
    axes = windows.fit_window_axes(rows, ["current", "voltage"], 30, 8, SERIES)
    errors = materialise(windows.window_errors(rows, ["current", "voltage"], 30, axes, SERIES), "errors")
    return ops.percentile_flag(errors, "recon_error", "recon_anomaly")


@query("i24_window_covariance", f"""
WITH {SERIES_SQL}, w AS (SELECT s.user_id, s.row_no AS target, h.row_no - (s.row_no - 30) AS e, h.current AS x
  FROM series s JOIN series h ON s.user_id = h.user_id AND h.row_no BETWEEN s.row_no - 30 AND s.row_no - 1 WHERE s.row_no >= 30)
SELECT a.e AS i, b.e AS j, round(covar_samp(a.x, b.x), 5) AS covariance FROM w a JOIN w b ON a.user_id = b.user_id AND a.target = b.target GROUP BY 1, 2""")
def i24_covariance(spark, sf):
    _, _, covariance = windows.window_covariance(_plain_series(spark, sf), ["current"], 30, SERIES)
    rows = [(i, j, float(v)) for i, row in enumerate(covariance) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "i long, j long, covariance double").withColumn("covariance", F.round("covariance", 5))


@query("i25_three_way_vote")
def i25(spark, sf):
    rows = materialise(ops.series_features(series_table(spark, sf), ORDER, SERIES), "features")
    result = votes.vote_series(rows, votes.fit_series_model(rows, SERIES))
    return result.summary


EVAL = """s AS (SELECT quality AS y, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS p, n_chars FROM labels JOIN documents USING (doc_id)),
g AS (SELECT n_chars AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s GROUP BY 1),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM g)"""


@query("i28_evaluation_set", f"""
WITH {EVAL} SELECT 'accuracy' AS metric, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0 END), 6) AS value FROM s
UNION ALL SELECT 'balanced_accuracy', round((avg(p) FILTER (y = 1) + avg(1 - p) FILTER (y = 0)) / 2, 6) FROM s
UNION ALL SELECT 'roc_auc', round(sum(pos * (less + neg / 2.0)) / (sum(pos) * sum(neg)), 6) FROM c
UNION ALL SELECT 'curve_points', count(*) + 1 FROM g""")
def i28(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("y"), F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("p"),
        F.col("n_chars").cast("double").alias("s"))
    got = classifiers.evaluation_set(rows, "y", "p", "s")
    out = got["metrics"].select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    out = out.unionByName(got["metrics"].select(F.lit("balanced_accuracy").alias("metric"), F.col("balanced_accuracy").alias("value")))
    out = out.unionByName(got["roc_auc"].select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))
    out = out.unionByName(got["precision_recall"].agg(F.lit("curve_points").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")))
    return out.withColumn("value", r6("value"))


@query("s01_stream_records", """
WITH k AS (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS k FROM events),
q AS (SELECT quantile_cont(k, 0.01) AS lo, quantile_cont(k, 0.99) AS hi, avg(k) AS m FROM k),
c AS (SELECT event_id, least(greatest(CASE WHEN event_id % 7 = 0 THEN m ELSE k END, lo), hi) AS v, least(greatest(k, lo), hi) AS t FROM k, q)
SELECT event_id, round((v - (SELECT avg(t) FROM c)) / (SELECT stddev_pop(t) FROM c), 5) AS x FROM c""")
def s01(spark, sf):
    source, sink = scratch_path(spark, "s01-in"), scratch_path(spark, "s01-out")
    train = tables.parse_record(
        table(spark, sf, "events").select("event_id", "props"), "props", T.StructType([T.StructField("k", T.DoubleType())]), {})
    model = Pipeline(stages=[
        learn.preparation_stage(train, ["k"]), VectorAssembler(inputCols=["x_k"], outputCol="features")]).fit(train)
    # Records with a gap now and then; the stored mean fills it.
    train.withColumn("k", F.when(F.col("event_id") % 7 != 0, F.col("k"))).write.json(source)
    scoring.score_records(
        spark, source, train.schema, lambda df: model.transform(df).select("event_id", "x_k"), sink).awaitTermination()
    return spark.read.parquet(sink).select("event_id", F.round("x_k", 5).alias("x"))


@query("s02_stream_files", REPORT_SQL)
def s02(spark, sf):
    source, folder = scratch_path(spark, "s02-in"), scratch_path(spark, "s02-out")
    names = [f"Cell{i + 1}" for i in range(N_CELLS)]
    wide = cells_table(spark, sf).select("vec_id", F.col("label").alias("Load"), *tables.cell_columns(F.col("cells"), N_CELLS))
    wide.write.option("header", True).csv(source)

    def report(df, run_id):
        packed = cell_ops.pack_cells(df, names)
        stack.write_stack_report(stack.stack_report(packed, "vec_id", conditions=["Load"], n_cells=N_CELLS), folder, run_id)

    scoring.score_files(spark, source, wide.schema, report).awaitTermination()
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("total_rows", T.LongType()), ("total_anomalies", T.LongType()), ("anomaly_percentage", T.DoubleType()),
        ("most_affected_cell", T.StringType()), ("min_voltage", T.DoubleType()), ("max_voltage", T.DoubleType()), ("avg_Load", T.DoubleType()))])
    return _rounded_summary(spark.read.schema(schema).json(f"{folder}/summary/*"))
