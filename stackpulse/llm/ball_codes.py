"""Vector codes by ball k-means.

Vectors are quantised to integers and cut into equal consecutive parts; each
part position has a codebook. An entry with the parts assigned to it is a ball.
Its radius is known from the round before, widened by the way its entry has
moved. Only entries whose distance is within twice the radius are its
neighbours. For a part at distance d from its entry, entries further than 2d
from that entry are further from the part as well; so the neighbours, sorted by
distance, form rings: a part nearer than half the way to the first neighbour
lies in the stable core and needs no work, and one in ring k is held against the
first k neighbours only (k rounded up to a power of two). All of it is integer
arithmetic, so results equal those of a plain search, ties to the lower index
included.

Each round is a pass over a table of vectors and codes in the shared folder.
What travels to the driver and back are the codebooks, sums, counts and radii:
``PARTS`` x ``ENTRIES`` rows at any size of the table.

Rows with a null vector, or a null or non-finite component, take no part, nor do
rows of another length than most (ties: the shorter) and empty vectors. A length
that ``PARTS`` does not divide is filled up with zeros, which change no
distance. Quantised components stop at +-2^27, so that distances fit 64 bits up
to 127 components. Null ids are never among the first entries; rows that repeat
an id each give a row and count each. With fewer rows than entries the codebooks
are shorter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST_BROADCAST = 1 << 20
_LIMIT = float(1 << 27)
_STRIP = 1 << 18  # distances worked out at once


def usable(vectors: DataFrame, key: str, vector: str, label: str | None) -> tuple[DataFrame, int]:
    """Rows that take part and the length of their vectors."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"))
    rows = rows.filter(F.coalesce(good, F.lit(False)) & (F.size("vector") > 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    length = usual[0]["n"] if usual else 0
    return rows.filter(F.size("vector") == length), length


def quantise(x: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, width) integers."""
    whole = np.clip(np.floor(SCALE * x), -_LIMIT, _LIMIT).astype(np.int64)
    whole = np.pad(whole, ((0, 0), (0, -whole.shape[1] % parts)))
    return whole.reshape(len(whole), parts, -1)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel(), kind))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def search_all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest entry of each part, ties to the lower index."""
    strip = max(1, _STRIP // book.size)
    return np.concatenate([distances(x[at:at + strip], book).argmin(1) for at in range(0, len(x), strip)] or [np.zeros(0, np.int64)])


def neighbours(book: np.ndarray, radii: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each entry, its neighbours by distance and their squared distances.
    The bounds are rounded up, so that none is missed."""
    gaps = distances(book, book)
    out = []
    for i, radius in enumerate(radii):
        near = np.flatnonzero(gaps[i] <= np.ceil(4 * (radius * (1 + 1e-9) + 1e-6) ** 2))
        near = near[near != i]
        near = near[np.argsort(gaps[i][near], kind="stable")]
        out.append((near, gaps[i][near]))
    return out


def search_balls(x: np.ndarray, own: np.ndarray, book: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """Nearest entry of each part, given the entry that it had; and how many
    distances it took."""
    found = own.copy()
    mine = ((x - book[own]) ** 2).sum(1)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(book) + 1))
    work = len(x)
    for i, (ids, gaps) in enumerate(near):
        members = order[cuts[i]:cuts[i + 1]]
        if not len(members) or not len(ids):
            continue
        ring = np.searchsorted(gaps, 4 * mine[members], "right")
        level = np.ceil(np.log2(np.maximum(ring, 1))).astype(np.int64)
        for step in np.unique(level[ring > 0]):
            rows = members[(ring > 0) & (level == step)]
            candidates = np.sort(np.append(ids[:1 << int(step)], i))  # ties go to the lower index
            found[rows] = candidates[search_all(x[rows], book[candidates])]
            work += len(rows) * len(candidates)
    return found, work


def _quantised(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(quantise(_matrix(batch.column(2), np.float64, length), parts), pa.int32())], names=["vec_id", "label", "whole"])
    return run


def _assigned(shared, last: bool):
    """Codes of each vector; with ``last`` their summed distance too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, near = shared.value
        parts, _, width = books.shape
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _matrix(batch.column(2), np.int64, parts * width).reshape(n, parts, width)
            before = None if near is None else np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            codes = np.zeros((n, parts), np.int64)
            for p in range(parts):
                codes[:, p] = search_all(x[:, p], books[p]) if before is None else search_balls(x[:, p], before[:, p], books[p], near[p])[0]
            packed = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
            if last:
                error = ((x - books[np.arange(parts), codes]) ** 2).sum((1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(error)], names=["vec_id", "label", "codes", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["vec_id", "label", "whole", "codes"])
    return run


def _summed(shared):
    """Per batch and entry in use: count, largest squared distance, sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value[0]
        parts, size, width = books.shape
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _matrix(batch.column(0), np.int64, parts * width).reshape(n, parts, width)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            flat = codes + np.arange(parts) * size
            counts = np.bincount(flat.ravel(), minlength=parts * size)
            far = np.zeros(parts * size, np.int64)
            np.maximum.at(far, flat, ((x - books[np.arange(parts), codes]) ** 2).sum(2))
            sums = np.zeros((parts * size, width), np.int64)
            np.add.at(sums, flat.ravel(), x.reshape(-1, width))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array((used // size).astype(np.int32)), pa.array((used % size).astype(np.int32)), pa.array(counts[used]), pa.array(far[used]), _lists(sums[used], pa.int64())],
                                             names=["part", "entry", "n", "far", "sums"])
    return run


def _updated(table: DataFrame, shared) -> tuple[np.ndarray, list]:
    """Entries moved to the floored mean of their parts, and the neighbours of
    the new balls."""
    books = shared.value[0]
    width = books.shape[2]
    partial = table.select("whole", "codes").mapInArrow(_summed(shared), "part int, entry int, n long, far long, sums array<long>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(width)]).alias("sums"))
    moved, radii = books.copy(), np.zeros(books.shape[:2])
    for r in total.collect():  # one row for each entry
        new = [int(s) // r["n"] for s in r["sums"]]
        moved[r["part"], r["entry"]] = new
        shift = float(((books[r["part"], r["entry"]] - np.array(new)) ** 2).sum()) ** 0.5
        radii[r["part"], r["entry"]] = float(r["far"]) ** 0.5 + shift
    return moved, [neighbours(moved[p], radii[p]) for p in range(len(moved))]


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) and the codebooks (parts, entries, width).

    ``codes`` has one byte for each part, so there are 256 entries at most.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    rows, length = usable(vectors, key, vector, label)
    kind, label_kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, label {label_kind}, codes binary, error long"), np.zeros((parts, 0, 0), np.int64)
    books = np.ascontiguousarray(quantise(np.array([r["vector"] for r in first], np.float64), parts).transpose(1, 0, 2))
    ids = f"vec_id {kind}, label {label_kind}"
    table = rows.select("vec_id", "label", "vector").mapInArrow(_quantised(length, parts), f"{ids}, whole array<int>")
    near = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((books, near))  # codebooks of fixed size
        table = materialise(table.mapInArrow(_assigned(shared, False), f"{ids}, whole array<int>, codes binary"), "vector-codes")
        books, near = _updated(table, shared)
    shared = spark.sparkContext.broadcast((books, near))
    return table.mapInArrow(_assigned(shared, True), f"{ids}, codes binary, error long"), books


def codebooks_digest(books: np.ndarray) -> str:
    """Of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Adds ``label_error``: the error summed over rows of an equal label, null
    labels together. Sums are made before they are joined to the rows, and are
    broadcast only if they are counted to be few; otherwise a hot label is left
    to the split of skewed joins."""
    coded = materialise(coded, "coded-vectors")
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_of")
    few = sums.count() <= most_broadcast
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_of"))).drop("_of")
