"""Sharding by sampled splitters: shards of near-equal bytes.

Records are ordered by (hash of the text, id, salt), so equal texts lie together
and no two records share a place. Splitters come from a sample in which every
record is drawn with a chance in proportion to its size; they cut the key space
into ranges of about equal bytes. Exact counts then show which ranges are
overfull, and those are cut again at their own sampled keys. Running totals
inside a range, on top of the totals of the ranges before it, give every record
its exact place, and the shard follows from that place: shards differ by at
most the size of one record. A text whose copies exceed a range is spread over
as many ranges as it needs, since the key goes on with id and salt.

A null text has size 1 and the hash of an empty text. Repeated rows stay
repeated and get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

SHARDS = 16
SAMPLES_PER_RANGE = 48
OVERFULL = 2.0
_KEY = ["text_hash", "doc_id", "salt"]


def _key(df: DataFrame | None = None) -> Column:
    return F.struct(*_KEY)


def _pick(splitters: list, key: Column) -> Column:
    """How many splitters are at or below the key: binary search in one
    expression, over a list padded to a power of two."""
    if not splitters:
        return F.lit(0)
    steps = 1 << (len(splitters)).bit_length()
    names = _KEY
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in splitters])
    count = F.lit(len(splitters))

    def step(low: Column, width: Column) -> Column:
        at = low + width
        return F.when((at <= count) & (F.get(table, F.least(at, count) - 1) <= key), at).otherwise(low)

    widths = []
    while steps:
        widths.append(steps)
        steps //= 2
    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)


def _uniform() -> Column:
    """A repeatable value in (0, 1) for every record."""
    return (F.pmod(F.xxhash64(*_KEY, F.lit(29)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _splitters(keyed: DataFrame, total: int, ranges: int) -> list[tuple]:
    """Quantile boundaries of a size-weighted sample; the sample holds about
    ``ranges * SAMPLES_PER_RANGE`` keys, however large the table."""
    chance = F.col("size") * F.lit(float(ranges * SAMPLES_PER_RANGE) / max(total, 1))
    drawn = keyed.filter(_uniform() < chance).select(*_KEY).collect()
    keys = sorted({tuple(r) for r in drawn}, key=_order)
    return _quantiles(keys, ranges)


def _order(key: tuple) -> tuple:
    return tuple((v is not None, 0 if v is None else v) for v in key)


def _quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    cuts = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return list(dict.fromkeys(cuts))


def _subdivide(keyed: DataFrame, splitters: list[tuple], total: int, ranges: int) -> list[tuple]:
    """Cut overfull ranges at sampled keys of their own."""
    target = max(1.0, total / max(1, ranges))
    for turn in range(4):
        full = keyed.groupBy(_pick(splitters, _key()).alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")) \
            .filter((F.col("bytes") > OVERFULL * target) & (F.col("n") > 1)).collect()
        if not full:
            break
        bytes_of = {r["part"]: r["bytes"] for r in full}
        wanted = sum(b / target for b in bytes_of.values()) * SAMPLES_PER_RANGE
        inside = keyed.filter(_pick(splitters, _key()).isin(list(bytes_of)))
        chance = F.col("size") * F.lit(wanted / sum(bytes_of.values()))
        drawn = inside.filter(F.pmod(F.xxhash64(*_KEY, F.lit(101 + turn)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance) \
            .select(_pick(splitters, _key()).alias("part"), *_KEY).collect()
        more: list[tuple] = []
        for part, size in bytes_of.items():
            own = sorted({tuple(r)[1:] for r in drawn if r["part"] == part}, key=_order)
            more += _quantiles(own, int(size / target) + 1)
        grown = sorted(set(splitters) | set(more), key=_order)
        if len(grown) == len(splitters):
            break
        splitters = grown
    return splitters


def shard_records(docs: DataFrame, shards: int = SHARDS, ranges: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every record's shard, and its
    place in the shard from 0 without gaps. ``key`` must be an integer column."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = materialise(docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("text_hash"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "shard-keys")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = ranges or max(2 * shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = _subdivide(keyed, _splitters(keyed, total, ranges), total, ranges)
    ranged = keyed.withColumn("part", _pick(splitters, _key()))
    inside = Window.partitionBy("part").orderBy(*_KEY)
    sums = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"))
    # One row per range: bounded by the number of splitters, which is known.
    before = F.broadcast(sums.select("part", (F.sum("part_bytes").over(Window.orderBy("part")) - F.col("part_bytes")).alias("bytes_before")))
    placed = ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("turn", F.row_number().over(inside)).join(before, "part") \
        .withColumn("shard", F.expr(f"int(least({shards - 1}, ((2 * (bytes_before + upto) - size) * {shards}) div {2 * max(total, 1)}))"))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard", "part", "turn"), "shard-places")
    # Slots: a shard takes a run of turns out of each of its ranges.
    runs = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))
    offsets = F.broadcast(runs.select("shard", "part", "first_turn", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("rows_before")))
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("turn") - F.col("first_turn")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the documents below ``path``, one folder per shard, in slot order.
    Ids must be unique."""
    docs.join(placed.select(F.col("doc_id").alias(key), "shard", "slot"), key) \
        .repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
