"""Sources, sinks, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import scalars as S
from ..functions.arrays import euclidean
from ..operators import cells as cell_ops, clean
from ..operators.ordered import index_rows
from ..schema import FAULT_RANGES, drop_if_present, exclude_columns, numeric_columns, rename_snake, require_columns, select_features, with_missing_as_zero
from ..session import materialise, scratch_path
from ..sources import sinks, tables
from .registry import CELLS_SQL, N_CELLS, ORDER, SERIES, cells_table, query, r6, series_table, table

ALL_CELLS = ", ".join(f"round(c[{i}], 6) AS Cell{i}" for i in range(1, N_CELLS + 1))


@query("a01_csv_scan", "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS ts_us FROM events")
def a01(spark, sf):
    path = scratch_path(spark, "a01")
    cols = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    sinks.write_csv(cols, path)
    return tables.read_csv(spark, path, cols.schema)


@query("a02_source_dispatch", """
SELECT f AS source_format, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 4) AS total
FROM customer, (SELECT unnest(['csv', 'json', 'parquet']) AS f) GROUP BY ALL""")
def a02(spark, sf):
    src = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = f"{scratch_path(spark, 'a02')}.{fmt}"
        writer = src.write.option("header", True)
        getattr(writer, fmt)(path)
        part = tables.read_table(spark, path, src.schema).groupBy("c_mktsegment").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total")
        ).withColumn("source_format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("a03_json_cells", f"WITH {CELLS_SQL} SELECT vec_id, {ALL_CELLS} FROM cells")
def a03(spark, sf):
    body = cells_table(spark, sf).select("vec_id", F.to_json(F.struct(
        F.lit("2024-01-01 00:00:00").alias("Date_Time"), F.col("cells").alias("Cell_Voltages"))).alias("body"))
    schema = T.StructType([T.StructField("Date_Time", T.StringType()),
                           T.StructField("Cell_Voltages", T.ArrayType(T.DoubleType()))])
    flat, _ = tables.parse_stack_records(body, "body", N_CELLS, schema)
    return flat.select("vec_id", *[r6(f"Cell{i}").alias(f"Cell{i}") for i in range(1, N_CELLS + 1)])


@query("a04_json_map", """
SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS k, 0.0::DOUBLE AS absent FROM events""")
def a04(spark, sf):
    src = tables.parse_map(table(spark, sf, "events").select("event_id", "props"), "props", "m").drop("props")
    return tables.map_features(src, "m", ["k", "absent"])


@query("a05_json_rename", """
SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS TinH2_C FROM events""")
def a05(spark, sf):
    schema = T.StructType([T.StructField("k", T.DoubleType())])
    return tables.parse_record(table(spark, sf, "events").select("event_id", "props"), "props", schema, {"k": "TinH2_C"})


@query("a07_csv_report", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_tax = 0")
def a07(spark, sf):
    path = scratch_path(spark, "a07")
    rep = table(spark, sf, "lineitem").filter("l_tax = 0").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    sinks.write_csv(rep, path)
    return tables.read_csv(spark, path, rep.schema)


CELL_REPORT = f"""WITH {CELLS_SQL}
SELECT CAST(list_position(c, list_min(c)) AS INTEGER) AS min_cell, vec_id, round(list_min(c), 6) AS Min_Cell_Voltage
FROM cells"""


def _cell_report(spark, sf):
    df = cell_ops.cell_features(cells_table(spark, sf))
    return df.select("vec_id", r6("Min_Cell_Voltage").alias("Min_Cell_Voltage"), "min_cell")


CELL_SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("Min_Cell_Voltage", T.DoubleType()),
    T.StructField("min_cell", T.IntegerType())])


@query("a08_report_per_cell", f"SELECT min_cell, count(*) AS n, round(min(Min_Cell_Voltage), 6) AS lo FROM ({CELL_REPORT}) GROUP BY 1")
def a08(spark, sf):
    path = scratch_path(spark, "a08")
    sinks.write_by_cell(_cell_report(spark, sf), path)
    back = spark.read.schema(CELL_SCHEMA).option("header", True).csv(path)
    return back.groupBy("min_cell").agg(F.count(F.lit(1)).alias("n"), r6(F.min("Min_Cell_Voltage")).alias("lo"))


@query("a09_latest_report", f"SELECT vec_id, Min_Cell_Voltage, min_cell FROM ({CELL_REPORT}) WHERE min_cell > 32")
def a09(spark, sf):
    path = scratch_path(spark, "a09")
    rep = _cell_report(spark, sf)
    sinks.write_run(rep.filter("min_cell <= 32"), path, "20240101_000000")
    sinks.write_run(rep.filter("min_cell > 32"), path, "20240102_000000")
    return sinks.read_latest_run(spark, path).drop("run_id")


@query("a10_json_records", """
SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def a10(spark, sf):
    src = table(spark, sf, "nation")
    return sinks.as_records(src).select(F.from_json("record", src.schema).alias("r")).select("r.*")


@query("a11_metrics_table", """
SELECT round(quantile_cont(c_acctbal, 0.05), 6) AS critical_threshold,
       round(quantile_cont(c_acctbal, 0.5), 6) AS degraded_threshold FROM customer""")
def a11(spark, sf):
    from ..operators.quantiles import quantiles
    lo, mid = quantiles(table(spark, sf, "customer"), {"c_acctbal": [0.05, 0.5]})["c_acctbal"]
    path = scratch_path(spark, "a11")
    sinks.write_metrics({"critical_threshold": lo, "degraded_threshold": mid}, spark, path)
    got = sinks.read_thresholds(spark, path)
    return spark.createDataFrame([(got["critical_threshold"], got["degraded_threshold"])],
                                 "critical_threshold double, degraded_threshold double").select(
        r6("critical_threshold").alias("critical_threshold"), r6("degraded_threshold").alias("degraded_threshold"))


@query("a13_checkpoint_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a13(spark, sf):
    kept = materialise(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "a13")
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# --- projections and filters -------------------------------------------------

@query("b01_drop_duplicates", "SELECT DISTINCT user_id, event_type FROM events")
def b01(spark, sf):
    return clean.drop_duplicate_rows(table(spark, sf, "events").select("user_id", "event_type"))


@query("a06_required_columns", """
SELECT l_orderkey, l_linenumber, l_quantity, 'missing columns: [''humidity'', ''load'']' AS refusal FROM lineitem""")
def a06(spark, sf):
    """Rows of a table that has what is required, and what the check says about
    names that it lacks."""
    rows = table(spark, sf, "lineitem")
    try:
        require_columns(rows, ["l_quantity", "humidity", "load"])
        refusal = None
    except ValueError as error:
        refusal = str(error)
    return require_columns(rows, ["l_orderkey", "l_linenumber", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity", F.lit(refusal).alias("refusal"))


@query("b02_select_columns", "SELECT l_quantity, l_discount FROM lineitem")
def b02(spark, sf):
    return select_features(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])


@query("b03_exclude_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def b03(spark, sf):
    return exclude_columns(table(spark, sf, "customer"), ["c_name"])


@query("b04_drop_if_present", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def b04(spark, sf):
    return drop_if_present(table(spark, sf, "part"), "p_retailprice", "power")


@query("b05_numeric_columns", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def b05(spark, sf):
    src = table(spark, sf, "supplier")
    return src.select(*numeric_columns(src))


@query("b06_missing_feature_zero", "SELECT s_suppkey, s_acctbal, 0.0::DOUBLE AS humidity FROM supplier")
def b06(spark, sf):
    src = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return with_missing_as_zero(src, ["s_acctbal", "humidity"])


@query("b07_split_noise", """
SELECT 'noise' AS part, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'normal', count(*), sum(l_quantity) FROM lineitem WHERE l_linenumber <> 1""")
def b07(spark, sf):
    src = table(spark, sf, "lineitem").select(
        "l_quantity", F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_linenumber")).alias("Cluster"))
    normal, noise = clean.split_noise(src)
    total = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return total(noise, "noise").unionByName(total(normal, "normal"))


@query("b08_rows_of_cell", f"SELECT * FROM ({CELL_REPORT}) WHERE min_cell = 7")
def b08(spark, sf):
    path = scratch_path(spark, "b08")
    sinks.write_by_cell(_cell_report(spark, sf), path)
    return sinks.read_cell(spark, path, CELL_SCHEMA, 7, N_CELLS)


@query("b09_drop_incomplete", "SELECT event_id, value FROM events WHERE event_id % 7 <> 0")
def b09(spark, sf):
    return clean.drop_incomplete(series_table(spark, sf, gaps=True).select("event_id", F.col("current").alias("value")))


@query("b10_membership_flag", """
SELECT l_orderkey, l_linenumber, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) AS is_anomaly FROM lineitem""")
def b10(spark, sf):
    marks = table(spark, sf, "supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return clean.membership_flag(rows, marks, ["l_suppkey"]).drop("l_suppkey")


@query("b11_seeded_sample", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {S.id_hash_sql('l_orderkey', 42)} % 10000 < 500")
def b11(spark, sf):
    return clean.sample_rows(table(spark, sf, "lineitem"), 0.05, 42, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("b12_head_rows", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no FROM events ORDER BY ts, event_id LIMIT 100")
def b12(spark, sf):
    head = table(spark, sf, "events").select("ts", "event_id").orderBy(*ORDER).limit(100)
    return index_rows(head, ORDER).select("event_id", "row_no")


RANGES = {"l_quantity": (2, 45), "l_discount": (0, 0.08), "l_tax": (0.01, 0.07)}


@query("b13_range_check", " UNION ALL ".join(
    f"SELECT '{c}' AS field, {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, count(*) FILTER (NOT {c} BETWEEN {lo} AND {hi}) AS violations FROM lineitem"
    for c, (lo, hi) in RANGES.items()))
def b13(spark, sf):
    return clean.range_violations(table(spark, sf, "lineitem"), RANGES)


@query("b13_fields_in_range", "SELECT l_orderkey, l_linenumber, " + " AND ".join(
    f"coalesce({c} BETWEEN {lo} AND {hi}, false)" for c, (lo, hi) in RANGES.items()) + " AS in_range FROM lineitem")
def b13_rows(spark, sf):
    return clean.flag_ranges(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *RANGES), RANGES).drop(*RANGES)


@query("b13_fault_form_limits", "SELECT event_id, " + " AND ".join(
    f"coalesce(CASE WHEN event_id % {i + 2} <> 0 THEN value END BETWEEN {lo} AND {hi}, false)" for i, (lo, hi) in enumerate(FAULT_RANGES.values())) + " AS in_range FROM events")
def b13_form(spark, sf):
    """Records of the fault form; the field at place i is missing where i + 2
    divides the id."""
    fields = {c: F.when(F.col("event_id") % (i + 2) != 0, F.col("value")) for i, c in enumerate(FAULT_RANGES)}
    return clean.flag_ranges(table(spark, sf, "events").withColumns(fields), FAULT_RANGES).select("event_id", "in_range")


@query("b14_trainable_guard", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def b14(spark, sf):
    rows = clean.require_trainable(table(spark, sf, "lineitem"), "l_returnflag")
    return cell_ops.value_counts(rows, "l_returnflag")


@query("b15_report_projection", f"""
WITH {CELLS_SQL}, s AS (SELECT *, list_aggregate(c, 'stddev_samp') AS sd FROM cells)
SELECT CAST(vec_id AS VARCHAR) AS Date_Time, round(list_min(c), 6) AS Min_Cell_Voltage,
       'Cell' || list_position(c, list_min(c)) AS Min_Cell_Index, CAST(label AS DOUBLE) AS "Load"
FROM s WHERE sd > (SELECT quantile_cont(sd, 0.9) FROM s)""")
def b15(spark, sf):
    rows = cell_ops.cell_features(cells_table(spark, sf)).withColumns({
        "Date_Time": F.col("vec_id").cast("string"), "Load": F.col("label").cast("double"),
        "Min_Cell_Voltage": r6("Min_Cell_Voltage")})
    from ..operators.quantiles import quantile
    return cell_ops.report_rows(rows.filter(F.col("Cell_Voltage_Std") > quantile(rows, "Cell_Voltage_Std", 0.9)))


@query("b16_power", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS power FROM lineitem")
def b16(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(F.col("l_quantity") * F.col("l_discount")).alias("power"))


@query("b17_residual", "SELECT p_partkey, round(p_retailprice - (900 + p_size), 6) AS residual FROM part")
def b17(spark, sf):
    rows = table(spark, sf, "part").withColumn("predicted", F.lit(900.0) + F.col("p_size"))
    return clean.residuals(rows, "p_retailprice", "predicted").select("p_partkey", r6("residual").alias("residual"))


# --- joins -------------------------------------------------------------------

@query("c01_counts_all_cells", f"""
SELECT CAST(d.cell AS INTEGER) AS min_cell, 'Cell' || d.cell AS Min_Cell_Index, count(r.vec_id) AS "Count"
FROM range(1, {N_CELLS + 1}) d(cell) LEFT JOIN ({CELL_REPORT}) r ON r.min_cell = d.cell GROUP BY d.cell""")
def c01(spark, sf):
    return cell_ops.counts_per_cell(_cell_report(spark, sf), N_CELLS)


@query("c02_positional_align", """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_no, value, value > 50 AS flag FROM events""")
def c02(spark, sf):
    rows = index_rows(series_table(spark, sf), ORDER, SERIES)
    flags = rows.select("user_id", "row_no", (F.col("current") > 50).alias("flag"))
    return rows.select("user_id", "row_no", F.col("current").alias("value")).join(flags, ["user_id", "row_no"])


@query("c06_overlay", """
SELECT event_id, value, ts IN (SELECT ts FROM events WHERE value > 90) AS is_anomaly FROM events""")
def c06(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "value")
    return cell_ops.overlay(rows, rows.filter("value > 90"), "ts").drop("ts")


# --- sorting, top-k, union ---------------------------------------------------

@query("f02_top_rows", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def f02(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("f04_sort_cells", f"""
SELECT Min_Cell_Index, "Count", CAST(regexp_extract(Min_Cell_Index, '(\\d+)', 1) AS INTEGER) AS Cell_Number FROM (
SELECT 'Cell' || min_cell AS Min_Cell_Index, count(*) AS "Count" FROM ({CELL_REPORT}) GROUP BY 1)""")
def f04(spark, sf):
    rows = cell_ops.cell_features(cells_table(spark, sf))
    return cell_ops.sort_by_cell(cell_ops.value_counts(rows, "Min_Cell_Index", name="Count"))


@query("g01_union_by_name", """
SELECT 'all' AS part, c_custkey, c_acctbal FROM customer
UNION ALL SELECT 'low', c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0""")
def g01(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    low = rows.filter("c_acctbal < 0").select("c_acctbal", "c_custkey", F.lit("low").alias("part"))
    return rows.withColumn("part", F.lit("all")).unionByName(low)


# --- scalar functions --------------------------------------------------------

@query("h01_clean_time", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '1970-01-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS Date_Time FROM events""")
def h01(spark, sf):
    text = F.when(F.col("event_id") % 11 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", S.clean_time_text(text).alias("Date_Time"))


@query("h02_epoch_time", "SELECT event_id, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def h02(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format(S.epoch_to_time(F.col("event_id")), S.TIME_FORMAT).alias("t"))


@query("h03_invalid_times", "SELECT event_id % 11 = 0 AS refused, count(*) AS n FROM events GROUP BY 1")
def h03(spark, sf):
    text = F.when(F.col("event_id") % 11 == 0, F.lit("13:99 o'clock")).otherwise(F.col("ts").cast("string"))
    rows = table(spark, sf, "events").select("event_id", text.alias("text"))
    good, bad = clean.quarantine_times(rows, "text")
    n = lambda df, refused: df.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))
    return n(good, False).unionByName(n(bad, True))


@query("h04_run_stamp")
def h04(spark, sf):
    return table(spark, sf, "region").select("r_name", S.run_stamp().alias("run_id"))


@query("h05_label_digits", "SELECT c_custkey, CAST(regexp_extract(c_name, '(\\d+)', 1) AS INTEGER) AS number FROM customer")
def h05(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.label_number(F.col("c_name")).alias("number"))


@query("h06_code_labels", """
SELECT vec_id, CASE label % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Degraded' ELSE 'Healthy' END AS state FROM embeddings""")
def h06(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.map_codes(F.col("label") % 3, S.HEALTH_LABELS).alias("state"))


@query("h07_binary_relabel", "SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS fault FROM embeddings")
def h07(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.binary_fault(F.col("label")).alias("fault"))


@query("h08_left_closed_bins", """
SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN -1 WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END AS code FROM customer""")
def h08(spark, sf):
    v = F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", S.left_closed_bins(v, [0.0, 5000.0]).alias("code"))


@query("h09_clip", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5), 40) AS q FROM lineitem")
def h09(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.clip(F.col("l_quantity"), 5.0, 40.0).alias("q"))


@query("h10_finite_or_zero", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE value END::DOUBLE AS v FROM events""")
def h10(spark, sf):
    k = F.col("event_id") % 5
    v = (F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf")))
         .otherwise(F.col("value")))
    return table(spark, sf, "events").select("event_id", S.finite_or_zero(v).alias("v"))


@query("h11_euclidean", f"WITH {CELLS_SQL} SELECT vec_id, round(list_distance(c, list_reverse(c)), 6) AS d FROM cells")
def h11(spark, sf):
    return cells_table(spark, sf).select("vec_id", r6(euclidean(F.col("cells"), F.reverse("cells"))).alias("d"))


@query("h12_uniform")
def h12(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.uniform(2.0, 3.0, 42).alias("Utot"))


@query("h13_dynamic_neighbours", "SELECT source, greatest(5, CAST(floor(ln(count(*) * 1000.0)) AS INTEGER)) AS k FROM documents GROUP BY 1")
def h13(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(S.dynamic_neighbours(F.count(F.lit(1)) * 1000).alias("k"))


P3 = "[l_discount, l_tax, 0.1 - l_tax]"


@query("h14_argmax_code", f"""
WITH p AS (SELECT l_orderkey, l_linenumber, {P3} AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS code FROM p""")
def h14(spark, sf):
    p = F.array("l_discount", "l_tax", F.lit(0.1) - F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.argmax_code(p).alias("code"))


@query("h15_confidence", f"""
WITH p AS (SELECT l_orderkey, l_linenumber, {P3} AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, round(list_max(p), 6) AS confidence FROM p""")
def h15(spark, sf):
    p = F.array("l_discount", "l_tax", F.lit(0.1) - F.col("l_tax"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"), S.argmax_code(p).alias("code"))
    return rows.select("l_orderkey", "l_linenumber", r6(S.confidence(F.col("p"), F.col("code"))).alias("confidence"))


@query("h16_fault_label", "SELECT vec_id, CASE WHEN label = 0 THEN 'Normal' ELSE 'Faulty' END AS prediction FROM embeddings")
def h16(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.fault_label(F.col("label")).alias("prediction"))
