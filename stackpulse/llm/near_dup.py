"""Near-duplicate documents by circulant MinHash.

The words of a text, five at a time, form its set. Two fixed permutations of a
32-bit universe make all coordinates of the signature: the first scatters the
set, the second, shifted around the circle by one more place each time, gives
the next coordinate's order. Bands of coordinates deal documents into buckets;
documents with equal sets are one node from the start. Pairs from buckets are
confirmed by the exact Jaccard similarity of their full sets.

With 24 bands of 5 a pair at similarity 0.85 is missed with a chance below one
in a million (1 - 0.85^5, to the 24th power, is 7.7e-7). Documents of buckets
that still span components after the first comparisons get a longer signature,
four bits a coordinate; it spares pairs that differ in more coordinates than a
pair at the limit does, by 4.75 standard deviations, which misses about as
rarely.

Null and empty texts, and texts of white space, have an empty set and stay
alone. A text of fewer than five words has one member, its whole sequence.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from . import text as tx
from .links import link, size_ratio

SHINGLE = 5
BANDS, ROWS = 24, 5
NUMERATOR, DENOMINATOR = 85, 100
_STRIP = 4096
_SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)[:, None]
_SCHEMA = "doc_id {key}, n_shingles long, node long, set_high long, text_hash long, bands array<long>"
_LONG = 960
_DEVIATIONS = 4.75


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the universe."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    return x


def order(x: np.ndarray) -> np.ndarray:
    """The second permutation of the universe; changes its input."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(members: np.ndarray, shifts: np.ndarray = _SHIFTS, strip: int = _STRIP) -> np.ndarray:
    """Coordinate k is the least place of the scattered set under the second
    permutation shifted by k."""
    low = np.full(len(shifts), 0xFFFFFFFF, np.uint32)
    scattered = scatter((members >> np.uint64(32)).astype(np.uint32))
    for at in range(0, len(scattered), strip):
        np.minimum(low, order(scattered[None, at:at + strip] + shifts).min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates to a number."""
    nibbles = np.zeros(-(-len(sig) // 16) * 16, np.uint64)
    nibbles[:len(sig)] = sig & np.uint32(15)
    return np.bitwise_or.reduce(nibbles.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def likely(numerator: int, denominator: int, k: int = _LONG):
    """Whether the sketches of a pair differ in few enough coordinates."""
    alike = numerator / denominator
    same = alike + (1 - alike) / 16
    most = math.ceil(k * (1 - same) + _DEVIATIONS * math.sqrt(k * same * (1 - same)))

    def differing(x: Column, y: Column) -> Column:
        n = x.bitwiseXOR(y)
        n = n.bitwiseOR(F.shiftrightunsigned(n, 1))
        return F.bit_count(n.bitwiseOR(F.shiftrightunsigned(n, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return lambda x, y: F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda total, n: total + n) <= most


def _sketched(size: int):
    shifts = np.arange(1, _LONG + 1, dtype=np.uint32)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.slices(batch, "text"):
                out = [tx.signed(sketch(signature(members, shifts, _STRIP // 8))) for members in shingle_sets(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "sketch"])
    return run


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = tx.words(tx.LOWER[data], offsets, tx.SPACE)
    all_shingles = tx.shingles(found.hashes, size)
    first = found.first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= size:
            yield np.unique(all_shingles[a:b - size + 1])
        elif b > a:
            yield tx.whole(found.hashes[a:b])
        else:
            yield np.zeros(0, np.uint64)


def _signed(key_type: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.slices(batch, "text"):
                counts, nodes, highs, bands = [], [], [], []
                for members in shingle_sets(data, offsets, size):
                    counts.append(len(members))
                    if not len(members):
                        nodes.append(None), highs.append(None), bands.append([])
                        continue
                    digest = np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), np.int64)
                    nodes.append(int(digest[0])), highs.append(int(digest[1]))
                    bands.append(tx.signed(band_keys(signature(members))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(highs, pa.int64()),
                     part.column(2), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "set_high", "text_hash", "bands"])
    return run


def _confirm(numerator: int, denominator: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for part, data, offsets in tx.slices(batch, "tb"):
                keep = []
                hubs = part.column(0).to_pylist()
                for hub, text, members in zip(hubs, part.column(2), shingle_sets(data, offsets, size)):
                    if last[0] != hub:
                        raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                        last = hub, next(shingle_sets(raw, np.array([0, len(raw)]), size))
                    both = len(np.intersect1d(last[1], members, assume_unique=True))
                    keep.append(denominator * both >= numerator * (len(last[1]) + len(members) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = NUMERATOR,
                    denominator: int = DENOMINATOR, size: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the least id of every group of
    linked documents, and whether this document is it; ``hashed`` adds the
    text_hash, which tells apart rows that repeat an id.

    A null id is never the least; a group of nulls only has a null component
    and keeps all of them.
    """
    spark = docs.sparkSession
    tx.text_batch(spark)
    key_type = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    signed = materialise(texts.select("doc_id", "text", "text_hash").mapInArrow(_signed(key_type, size), _SCHEMA.format(key=key_type)), "signatures")
    # Equal sets: one node, with one document to stand for it.
    nodes = materialise(signed.filter("node is not null").groupBy("node").agg(
        F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("chosen"),
        F.min_by("bands", F.struct("doc_id", "text_hash")).alias("bands")), "sets")
    members = nodes.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").alias("weight"))

    def bodies(wanted: DataFrame) -> DataFrame:
        """(node, text) of one document for each wanted node."""
        chosen = wanted.join(nodes.select("node", "chosen.*"), "node").withColumn("same", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        return texts.withColumn("same", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) \
            .join(chosen.select("node", "same", "text_hash"), ["same", "text_hash"]).select("node", "text").dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        found = materialise(bodies(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "bodies")
        ta = found.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        tb = found.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm(numerator, denominator, size), "a long, b long")

    def sketches(wanted: DataFrame) -> DataFrame:
        return bodies(wanted).select("node", "text").mapInArrow(_sketched(size), "node long, sketch array<long>")

    grouped = link(members, verify, size_ratio(numerator, denominator), sketches, likely(numerator, denominator))
    owner = nodes.select("node", "least_id").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = owner.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_node = owner.join(least, "component").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node", "text_hash").join(of_node, "node", "left") \
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *["text_hash"] * hashed)
