"""Random forests of folded rows, a tree a task.

Trees compare bins, so rows that are alike in all bins, in label and in weight
are one cell, and the cells of a table of few features are few however many rows
it has. They are dealt to every task as one array of codes and one of counts.
A task draws Poisson(n) of a cell's n rows, which is the bootstrap of its rows,
and grows one tree level by level from sums over (node, bin, kind). Splits,
least leaves, features per node and the merging of sister leaves of one class
follow Spark's forests, and the trees become a Spark model.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise, scratch_path

# Cells that every task holds, and pairs of label and weight.
HELD_CELLS, KINDS = 1 << 22, 64
# Codes that a task counts at once, and sums of a level that it holds at once.
_COUNTED, _SUMS = 1 << 20, 1 << 21
# Gains below are rounding.
_NO_GAIN = 1e-12
_TREE = "tree int, left array<int>, right array<int>, feature array<int>, cut array<int>, stats array<double>, raw array<long>, gain array<double>"
_NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double,"
    " leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def bins_of(x: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
    """How many cuts lie below each value; NaN is above all of them."""
    return np.searchsorted(np.asarray(cuts, float), x, side="left")


def _coded(cuts: list[list[float]], kinds: int):
    """(code, n) of the cells of a task's rows, bins first, then the kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        waiting, rows = [], 0

        def counted() -> None:
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            both, at = np.unique(np.concatenate([held[0], codes]), return_inverse=True)
            held[1] = np.bincount(at, np.concatenate([held[1], n]), len(both)).astype(np.int64)
            held[0] = both

        for batch in batches:
            code = np.zeros(len(batch), np.int64)
            for column, ends in zip(batch.columns, cuts):
                code = code * (len(ends) + 1) + bins_of(column.to_numpy(zero_copy_only=False), ends)
            waiting.append(code * kinds + batch.columns[-1].to_numpy(zero_copy_only=False))
            rows += len(code)
            if rows >= _COUNTED:
                counted()
                waiting, rows = [], 0
                if len(held[0]) >= HELD_CELLS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", "n"])
                    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if waiting:
            counted()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", "n"])
    return run


def coded_cells(rows: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[float]], kind: Column, kinds: int) -> DataFrame:
    """(code, n) of every occupied cell."""
    shaped = rows.select(*[F.col(c).cast("double") for c in columns], kind.cast("int").alias("_kind"))
    return shaped.mapInArrow(_coded([list(c) for c in cuts], kinds), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def decoded(codes: np.ndarray, sizes: Sequence[int], kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins, a row for each feature, kinds) of codes."""
    kind, rest = (codes % kinds).astype(np.int32), codes // kinds
    bins = np.empty((len(sizes), len(codes)), np.uint8 if max(sizes, default=1) <= 256 else np.int32)
    for f in range(len(sizes) - 1, -1, -1):
        bins[f], rest = rest % sizes[f], rest // sizes[f]
    return bins, kind


def _chosen(counts: np.ndarray, per_class: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, bin, kinds on the left) of the best split of each node, from the
    counts by (node, bin, kind); gain is -inf where none leaves enough rows."""
    total = counts.sum(axis=1)
    left = counts.cumsum(axis=1)[:, :-1]
    right = total[:, None] - left

    def spoiled(c: np.ndarray) -> np.ndarray:
        w = c @ per_class
        s = w.sum(axis=-1)
        return s - np.divide((w * w).sum(axis=-1), s, out=np.zeros_like(s), where=s > 0)

    weight = (total @ per_class).sum(axis=-1)
    gain = (spoiled(total)[:, None] - spoiled(left) - spoiled(right)) / np.maximum(weight, 1e-300)[:, None]
    gain[(left.sum(axis=-1) < least) | (right.sum(axis=-1) < least)] = -np.inf
    at = gain.argmax(axis=1)
    row = np.arange(len(at))
    return gain[row, at], at, left[row, at]


def grow_tree(bins: np.ndarray, kind: np.ndarray, drawn: np.ndarray, sizes: Sequence[int], per_class: np.ndarray, depth: int, least: int, each: int,
              rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Nodes of one tree, the root first, children after their parents.

    ``per_class`` is the weight that one row of a kind (row) gives a class
    (column); every node looks at ``each`` features of its own.
    """
    features, kinds, width = len(sizes), len(per_class), max(sizes)
    at = np.zeros(bins.shape[1], np.int64)
    drawn = drawn.astype(float)
    counts = [np.bincount(kind, drawn, kinds)[None]]
    made = {"left": [np.full(1, -1)], "right": [np.full(1, -1)], "feature": [np.full(1, -1)], "cut": [np.full(1, -1)], "gain": [np.full(1, -1.0)]}
    active, done = np.zeros(1, np.int64), 1  # places of the open nodes in the last level
    for _ in range(depth if width > 1 else 0):
        m = len(active)
        if not m:
            break
        pick = np.argsort(rng.random((m, features)), axis=1)[:, :each] if each < features else np.tile(np.arange(features), (m, 1))
        gain, feature, cut = np.full(m, _NO_GAIN), np.full(m, -1), np.full(m, -1)
        lefts = np.zeros((m, kinds))
        some = max(1, _SUMS // (width * kinds))
        order = np.argsort(at, kind="stable") if m > some else None
        bounds = [0, len(at)] if order is None else np.searchsorted(at, np.append(np.arange(0, m, some), m), sorter=order)
        for part, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
            rows = np.arange(len(at)) if order is None else order[low:high]
            first, n = part * some, min(some, m - part * some)
            here = at[rows] - first
            for j in range(pick.shape[1]):
                f = pick[first:first + n, j]
                place = (here * width + bins[f[here], rows]) * kinds + kind[rows]
                found, b, left = _chosen(np.bincount(place, drawn[rows], n * width * kinds).reshape(n, width, kinds), per_class, least)
                better = np.flatnonzero(found > gain[first:first + n])
                to = first + better
                gain[to], feature[to], cut[to], lefts[to] = found[better], f[better], b[better], left[better]
        split = np.flatnonzero(feature >= 0)
        above = counts[-1][active[split]]
        below = np.empty((2 * len(split), kinds))
        below[::2], below[1::2] = lefts[split], above - lefts[split]
        to = active[split]
        for name, values in (("left", done + 2 * np.arange(len(split))), ("right", done + 2 * np.arange(len(split)) + 1), ("feature", feature[split]), ("cut", cut[split]), ("gain", gain[split])):
            made[name][-1][to] = values
        for name in made:
            made[name].append(np.full(len(below), -1.0 if name == "gain" else -1))
        counts.append(below)
        done += len(below)
        weight = below @ per_class
        alive = ((weight > 0).sum(axis=1) > 1) & (below.sum(axis=1) >= 2 * least)
        active = np.flatnonzero(alive)
        child = np.full(m, -1)
        child[split] = 2 * np.arange(len(split))
        rank = np.cumsum(alive) - 1
        rows = np.flatnonzero(child[at] >= 0)
        node = at[rows]
        to = child[node] + (bins[feature[node], rows] > cut[node])
        rows, to = rows[alive[to]], to[alive[to]]
        at, bins, kind, drawn = rank[to], bins[:, rows], kind[rows], drawn[rows]
    counts = np.concatenate(counts)
    tree = {name: np.concatenate(values) for name, values in made.items()}
    return merged(tree | {"stats": counts @ per_class, "raw": counts.sum(axis=1)})


def depths(tree: dict[str, np.ndarray]) -> np.ndarray:
    depth, level = np.zeros(len(tree["left"]), np.int16), np.zeros(1, np.int64)
    while len(level):
        children = np.concatenate([tree[side][level] for side in ("left", "right")])
        depth[children[children >= 0]] = depth[level[0]] + 1
        level = children[children >= 0]
    return depth


def cut_back(tree: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """Which nodes are leaves of the tree at that depth. Sister leaves of one
    class are one leaf, as in a tree grown to that depth only."""
    leaf = (tree["left"] < 0) | (tree["depth"] >= depth)
    kind = tree["stats"].argmax(axis=1)
    for level in range(int(tree["depth"].max()), -1, -1):
        at = np.flatnonzero(~leaf & (tree["depth"] == level))
        left, right = tree["left"][at], tree["right"][at]
        leaf[at] = leaf[left] & leaf[right] & (kind[left] == kind[right])
    return leaf


def merged(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tree with sister leaves of one class as one leaf, and without what was
    below it."""
    depth = depths(tree)
    leaf = cut_back(tree | {"depth": depth}, len(depth))
    kept = np.zeros(len(leaf), bool)
    kept[0] = True
    for level in range(int(depth.max()) + 1):
        at = np.flatnonzero(kept & ~leaf & (depth == level))
        kept[tree["left"][at]] = kept[tree["right"][at]] = True
    number = np.cumsum(kept) - 1
    out = {name: values[kept].copy() for name, values in tree.items()}
    ends = leaf[kept]
    for side in ("left", "right"):
        out[side] = np.where(ends, -1, number[out[side]])
    out["feature"][ends], out["cut"][ends], out["gain"][ends] = -1, -1, -1.0
    return out


@dataclass
class FoldedRows:
    """Cells of a table, sorted by code, with what the codes mean."""

    spark: SparkSession
    cuts: list[list[float]]
    kinds: list[tuple[int, float]]
    codes: np.ndarray
    n: np.ndarray

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    @property
    def classes(self) -> int:
        return max(2, 1 + max(label for label, _ in self.kinds))

    def trees(self, count: int, depth: int, least: int, each: int, seed: int) -> DataFrame:
        """A pinned table with one row a tree; cuts are numbers of bins."""
        per_class = np.zeros((len(self.kinds), self.classes))
        for i, (label, weight) in enumerate(self.kinds):
            per_class[i, label] = weight
        shared = self.spark.sparkContext.broadcast((self.codes, self.n))  # ``HELD_CELLS`` at most
        sizes = self.sizes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    codes, n = shared.value
                    rng = np.random.default_rng([seed, number])
                    drawn = rng.poisson(n)
                    held = drawn > 0
                    tree = grow_tree(*decoded(codes[held], sizes, len(per_class)), drawn[held], sizes, per_class, depth, least, each, rng)
                    whole = lambda x, kind: pa.array([x.astype(kind)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), *[whole(tree[c], np.int32) for c in ("left", "right", "feature", "cut")],
                         whole(tree["stats"].ravel(), float), whole(tree["raw"], np.int64), whole(tree["gain"], float)],
                        names=["tree", "left", "right", "feature", "cut", "stats", "raw", "gain"])

        grown = materialise(self.spark.range(0, count, 1, count).mapInArrow(run, _TREE), "trees")
        shared.unpersist()
        return grown

    def model(self, trees: DataFrame, label: str, **params) -> RandomForestClassificationModel:
        """The trees as a Spark model on values: a row is in a bin up to a cut if
        its value is at most the cut."""
        path, spark = scratch_path(self.spark, "forest"), self.spark
        count, now = trees.count(), int(time.time() * 1000)
        common = {"timestamp": now, "sparkVersion": spark.version, "defaultParamMap": {"impurity": "gini"}, "numFeatures": len(self.cuts), "numClasses": self.classes}
        own = {"featuresCol": "features", "labelCol": label, **params}
        kind = "org.apache.spark.ml.classification"
        head = {"class": f"{kind}.RandomForestClassificationModel", "uid": f"RandomForestClassifier_{uuid.uuid4().hex[:12]}", "paramMap": {**own, "numTrees": count}, "numTrees": count}
        spark.createDataFrame([(json.dumps({**common, **head}),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        one = [(t, json.dumps({**common, "class": f"{kind}.DecisionTreeClassificationModel", "uid": f"dtc_{uuid.uuid4().hex[:12]}", "paramMap": own}), 1.0) for t in range(count)]
        spark.createDataFrame(one, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        trees.mapInArrow(_saved(self.cuts, self.classes), _NODES).write.parquet(f"{path}/data")
        return RandomForestClassificationModel.load(path)


def _saved(cuts: list[list[float]], classes: int):
    """Nodes as a Spark model stores them."""
    ends, starts = np.concatenate([np.asarray(c, float) for c in cuts]), np.cumsum([0, *map(len, cuts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                number, tree = read_tree(batch, i, classes)
                inner, stats = tree["left"] >= 0, tree["stats"]
                n = len(inner)
                lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                split = pa.StructArray.from_arrays(
                    [pa.array(tree["feature"]), lists(np.append(0, np.cumsum(inner)), ends[starts[tree["feature"][inner]] + tree["cut"][inner]]), pa.array(np.full(n, -1, np.int32))],
                    names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
                impurity = 1 - ((stats / stats.sum(axis=1, keepdims=True)) ** 2).sum(axis=1)
                node = pa.StructArray.from_arrays(
                    [pa.array(np.arange(n, dtype=np.int32)), pa.array(stats.argmax(axis=1).astype(float)), pa.array(impurity),
                     lists(np.arange(n + 1) * classes, stats.ravel()), pa.array(tree["raw"]), pa.array(tree["gain"]),
                     pa.array(tree["left"]), pa.array(tree["right"]), split],
                    names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), node], names=["treeID", "nodeData"])
    return run


def read_tree(batch, i: int, classes: int) -> tuple[int, dict[str, np.ndarray]]:
    """(number, nodes) of a row of a table of trees."""
    tree = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("left", "right", "feature", "cut", "stats", "raw", "gain")}
    return batch.column("tree")[i].as_py(), tree | {"stats": tree["stats"].reshape(-1, classes)}


def held_trees(trees: DataFrame, classes: int) -> Iterator[list[dict[str, np.ndarray]]]:
    """The trees in their order, one after another, with the depth of each node."""
    for number in range(trees.count()):
        _, tree = read_tree(trees.filter(F.col("tree") == number).toArrow().combine_chunks(), 0, classes)
        yield [tree | {"depth": depths(tree)}]


def kind_of(kinds: Sequence[tuple], columns: Sequence[str]) -> Column:
    """Number of a row's kind."""
    number = None
    for i, values in enumerate(kinds):
        same = F.lit(True)
        for c, v in zip(columns, values):
            same = same & (F.col(c) == F.lit(v))
        number = F.when(same, F.lit(i)) if number is None else number.when(same, F.lit(i))
    return number


def fold_rows(rows: DataFrame, columns: Sequence[str], cuts: Sequence[Sequence[float]], label: str, weight: str) -> FoldedRows | None:
    """Cells of a table, or None where one task cannot hold them."""
    pairs = [tuple(r) for r in rows.select(label, F.col(weight).cast("double")).distinct().limit(KINDS + 1).collect()]
    whole = all(v is not None and w is not None and v >= 0 and float(v).is_integer() and w >= 0 for v, w in pairs)
    if not pairs or not whole or len(pairs) > KINDS or int(max(v for v, _ in pairs)) >= KINDS:
        return None
    kinds = sorted((int(v), float(w)) for v, w in pairs)
    space = len(kinds)
    for c in cuts:
        space *= len(c) + 1
    if space >= 1 << 62:
        return None
    cells = materialise(coded_cells(rows, columns, cuts, kind_of(kinds, [label, weight]), len(kinds)), "cells")
    if cells.count() > HELD_CELLS:
        return None
    held = cells.toArrow()
    codes, n = (held.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    return FoldedRows(rows.sparkSession, [list(map(float, c)) for c in cuts], kinds, codes[order], n[order])
