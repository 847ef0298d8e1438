"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

MOST_LABELS = 1000


def held_out(key: str = "doc_id") -> Column:
    """Rows kept away from training: CRC-32 of the id as text leaves 2 over 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _place(text: str) -> Column:
    return F.xxhash64(F.lit(17), text)


def bounded_sample(docs: DataFrame, text: str, rows: int, total_bytes: int, label: str | None = None,
                   marks: DataFrame | None = None, key: str | None = None) -> list[tuple[str, object]]:
    """(text, label) of at most ``rows`` rows and ``total_bytes`` bytes, picked
    by a hash of the text, so that a rerun picks the same. Each label gets an
    equal part of both bounds.

    Labels are a column of ``docs`` or come from ``marks`` (key, label). The
    choice is made on hashes and sizes; texts are read for the chosen ones only.
    A text over a hundredth of the byte bound is left out of the sample whole.
    Copies of a text count once for each label.
    """
    spark = docs.sparkSession
    columns = [F.octet_length(text).alias("size"), _place(text).alias("place")]
    narrow = docs.select(*columns, F.col(label).alias("label")) if marks is None else docs.select(*columns, F.col(key).alias("key")).join(marks, "key")
    narrow = materialise(narrow.filter("label is not null").filter(F.col("size") <= total_bytes // 100).select("label", "size", "place").distinct(), "sample-places")
    counts = {r["label"]: r["count"] for r in narrow.groupBy("label").count().orderBy("label").limit(MOST_LABELS).collect()}
    if not counts:
        return []
    share = max(1, rows // len(counts))
    # Hashes below a limit leave a few times the share of each label, however
    # many rows it has; ranks then settle which.
    chance = F.lit(0.0)
    for value, n in counts.items():
        chance = F.when(F.col("label") == F.lit(value), F.lit(4.0 * share / n)).otherwise(chance)
    few = narrow.filter(F.pmod("place", F.lit(1 << 40)) / F.lit(float(1 << 40)) < chance)
    w = Window.partitionBy("label").orderBy(F.pmod("place", F.lit(1 << 40)), "place", "size")
    ranked = few.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= share)
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    chosen = ranked.withColumn("upto", upto).filter(F.col("upto") <= total_bytes // len(counts)).select("place", "label").collect()
    if not chosen:
        return []
    wanted = spark.createDataFrame([(p,) for p in sorted({r["place"] for r in chosen})], "place long")  # ``rows`` hashes at most
    texts = docs.select(F.col(text).alias("text"), _place(text).alias("place")).filter("text is not null").join(F.broadcast(wanted), "place").distinct()
    by_place = {r["place"]: r["text"] for r in texts.collect()}
    return [(by_place[r["place"]], r["label"]) for r in sorted(chosen, key=lambda r: (r["place"], str(r["label"]))) if r["place"] in by_place]
