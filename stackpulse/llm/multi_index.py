"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each half is quantised by its own codebook, and
a pair of centroids names a cell. A query ranks centroids for each half and
walks the pairs by the sum of their distances, from a heap, until the visited
cells hold the wanted share of all vectors. Visited entries are reranked by
their exact distance in double precision.

The codebooks are fitted on a bounded sample; every vector is indexed. Cells
are dealt out in chunks of bounded size, and queries in blocks, so a cell that
holds a third of all vectors is many tasks. Each chunk returns the best few of
each query only.

Vectors that are null, zero, of another length than most, or that hold a null or
non-finite component take no part, neither as queries nor as candidates. A row
with a null id takes none either. Rows that share a query's id count as its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise

CENTROIDS = 32
SAMPLE = 16384
SHARE = 0.6
LEAST_CANDIDATES = 4096
NEAREST = 10
CHUNK_ROWS, QUERY_ROWS = 4096, 512
_TURNS = 12


class Codebooks(NamedTuple):
    left: np.ndarray
    right: np.ndarray

    @property
    def cut(self) -> int:
        return self.left.shape[1]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm from rows spread over the sample."""
    points = np.unique(x, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(_TURNS):
        nearest = _distances(points, centres).argmin(1)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        centres[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centres


def _matrix(column) -> np.ndarray:
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(len(column), -1)
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    rows = rows.filter(F.coalesce(good, F.lit(False)))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vector") == (usual[0]["n"] if usual else 0))


def fit(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Codebooks | None:
    """Codebooks from at most ``sample`` distinct vectors, picked by hash."""
    # The sort keeps the best ``sample`` rows of each partition only.
    drawn = rows.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    if not drawn:
        return None
    x = np.array([r["vector"] for r in drawn])
    cut = max(1, x.shape[1] // 2)
    return Codebooks(_centroids(x[:, :cut], centroids), _centroids(x[:, cut:], centroids) if x.shape[1] > cut else np.zeros((1, 0)))


def _coded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            left, right = _distances(x[:, :books.cut], books.left).argmin(1), _distances(x[:, books.cut:], books.right).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], names=["vec_id", "vector", "left", "right"])
    return run


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells in order of summed distance until they hold ``wanted`` vectors."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, reached, held, out = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(counts[a[i], b[j]])
        if n:
            out.append((int(a[i]), int(b[j])))
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in reached:
                reached.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return out


def _visits(shared, wanted: int):
    """(query, vector, left, rights): the cells that a query visits, gathered by
    the left centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, counts = shared.value
        for batch in batches:
            ids, vectors, lefts, rights = [], [], [], []
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            near_left, near_right = _distances(x[:, :books.cut], books.left), _distances(x[:, books.cut:], books.right)
            for row, query in enumerate(batch.column(0).to_pylist()):
                cells: dict[int, list[int]] = {}
                for a, b in walk(near_left[row], near_right[row], counts, wanted):
                    cells.setdefault(a, []).append(b)
                for a, bs in cells.items():
                    ids.append(query), vectors.append(x[row]), lefts.append(a), rights.append(bs)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, batch.column(0).type), pa.array(vectors, pa.list_(pa.float64())), pa.array(lefts, pa.int32()), pa.array(rights, pa.list_(pa.int32()))],
                names=["query_id", "query", "left", "rights"])
    return run


def _rerank(nearest: int):
    def run(key, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            x, ids, right = _matrix(entries["vector"]), entries["vec_id"].to_numpy(), entries["right"].to_numpy()
            q = _matrix(queries["query"])
            rough, norms = _distances(q, x), (x ** 2).sum(1)
            for row, (query, visited) in enumerate(zip(queries["query_id"], queries["rights"])):
                allowed = np.flatnonzero(np.isin(right, np.asarray(visited)) & (ids != query))
                if not len(allowed):
                    continue
                d = rough[row, allowed]
                if len(allowed) > nearest:
                    # Every entry that rounding could put among the nearest; it
                    # grows with the squared norms, which the distances come from.
                    slack = 1e-12 * ((q[row] ** 2).sum() + norms[allowed])
                    edge = np.partition(d + slack, nearest - 1)[nearest - 1]
                    allowed = allowed[d - slack <= edge + 1e-9 * (1 + edge)]
                exact = np.sqrt(((x[allowed] - q[row]) ** 2).sum(1))
                best = np.lexsort((ids[allowed], exact))[:nearest]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[allowed][best], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST,
           share: float = SHARE, least: int = LEAST_CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query row.

    Each query visits cells until they hold ``share`` of all vectors, ``least``
    at the least.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    rows = usable(vectors, key, vector)
    books = fit(rows)
    if books is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(books)  # two codebooks of fixed size
    coded = rows.mapInArrow(_coded(shared), f"vec_id {kind}, vector array<double>, left int, right int")
    index = materialise(coded.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "multi-index")
    cells = index.groupBy("left", "right").count().collect()  # one row per cell, CENTROIDS squared at most
    counts = np.zeros((len(books.left), len(books.right)), np.int64)
    for r in cells:
        counts[r["left"], r["right"]] = r["count"]
    asked = usable(queries, key, vector).distinct()
    n_queries, total = asked.count(), int(counts.sum())
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    wanted = max(least, int(share * total))
    plan = spark.sparkContext.broadcast((books, counts))
    chunks = F.array(*[F.lit(int(max(1, -(-n // CHUNK_ROWS)))) for n in counts.sum(axis=1)])
    visits = asked.repartition(max(blocks, spark.sparkContext.defaultParallelism)) \
        .mapInArrow(_visits(plan, wanted), f"query_id {kind}, query array<double>, left int, rights array<int>") \
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(chunks, F.col("left")) - 1)))
    entries = index.withColumn("chunk", F.pmod("salt", F.get(chunks, F.col("left")).cast("long")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("salt")
    deal = ["left", "chunk", "block"]
    found = entries.groupBy(*deal).cogroup(visits.groupBy(*deal)).applyInPandas(_rerank(nearest), f"query_id {kind}, vec_id {kind}, score double").distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
