"""Isolation forest (Liu, Ting and Zhou 2008) and sampled Shapley attribution.

Each tree sees a bounded sample and is built in its own group; the forest is a
small table (trees x at most 511 nodes), so scoring ships it to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialise
from .quantiles import quantile

SAMPLE = 256
TREES = 100
# Rows that are explained together, and rows of a task.
EXPLAINED, EXPLAINED_TASK = 256, 4096
# Rows that go down all trees together.
SCORED = 256
NODE_SCHEMA = "tree int, node int, left int, right int, feature int, threshold double, size int, depth int"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    c = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def tree_samples(df: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, row) with ``sample`` rows per tree, chosen by hash of key and tree.

    Every row is offered to a tree by its hash for that tree, at a rate
    somewhat above the need; the surplus is cut off by rank inside each bounded
    group.
    """
    n = max(1, df.count())
    need = sample + 6 * sample ** 0.5 + 12  # beyond the spread of a draw
    limit = F.lit(int(min(1.0, need / n) * 2**40))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed + 1)), F.lit(2**40)) < limit)
    offered = df.withColumn("tree", F.explode(chosen))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)), key)
    return offered.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample).drop("_r")


@dataclass
class IsolationForest:
    nodes: DataFrame
    psi: int
    threshold: float | None = None

    def tables(self) -> list[dict[str, np.ndarray]]:
        """Node arrays per tree; bounded by trees x (2 x sample - 1) rows."""
        rows = self.nodes.toPandas().sort_values(["tree", "node"])
        out = []
        for _, t in rows.groupby("tree"):
            leaf = t["feature"].to_numpy() < 0
            out.append({
                "left": np.where(leaf, t["node"], t["left"]), "right": np.where(leaf, t["node"], t["right"]),
                "feature": np.where(leaf, 0, t["feature"]), "threshold": t["threshold"].to_numpy(),
                "path": t["depth"].to_numpy() + average_path(t["size"].to_numpy()), "levels": int(t["depth"].max()),
            })
        return out

    def score(self, df: DataFrame, vector: str, name: str = "score") -> DataFrame:
        """Anomaly score in (0, 1); larger is more isolated."""
        trees, psi = packed(self.tables()), self.psi

        @F.pandas_udf("double")
        def score_rows(vectors: pd.Series) -> pd.Series:
            return pd.Series(forest_scores(np.stack(vectors.to_numpy()), trees, psi) if len(vectors) else [])

        return df.withColumn(name, score_rows(F.col(vector)))

    def with_threshold(self, df: DataFrame, vector: str, contamination: float = 0.05) -> "IsolationForest":
        """Cut so that the given share of ``df`` lies beyond it."""
        scored = materialise(self.score(df, vector, "_s").select("_s"), "scores")
        return IsolationForest(self.nodes, self.psi, quantile(scored, "_s", 1.0 - contamination))

    def flag(self, df: DataFrame, vector: str, name: str = "iso_anomaly") -> DataFrame:
        if self.threshold is None:
            raise ValueError("fit a threshold first")
        return self.score(df, vector, "_s").withColumn(name, F.col("_s") > F.lit(self.threshold)).drop("_s")

    def save(self, path: str) -> None:
        self.nodes.withColumns({"psi": F.lit(self.psi), "cut": F.lit(self.threshold).cast("double")}).write.mode(
            "overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        table = spark.read.parquet(path)
        r = table.select("psi", "cut").first()
        return cls(table.drop("psi", "cut"), r["psi"], r["cut"])


def packed(trees: Sequence[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What scoring reads of ``one_table``: the children of node i are at 2i and
    2i + 1, and a leaf is its own child."""
    if not trees:
        return {"root": np.zeros(0, np.int64)}
    table = one_table(trees)
    return {k: table[k] for k in ("root", "feature", "threshold", "path")} | {
        "child": np.stack([table["left"], table["right"]], axis=1).ravel(), "levels": np.array(max(t["levels"] for t in trees))}


def forest_scores(x: np.ndarray, trees: Sequence[dict[str, np.ndarray]] | dict[str, np.ndarray], psi: int) -> np.ndarray:
    """Scores of rows; all trees go down a level at once. Who scores often hands
    in the ``packed`` trees."""
    table = trees if isinstance(trees, dict) else packed(trees)
    count, width, total = len(table["root"]), x.shape[1] if x.ndim > 1 else 0, np.zeros(len(x))
    if not count:
        return np.full(len(x), np.nan)
    for begin in range(0, len(x), SCORED):
        part = np.ascontiguousarray(x[begin:begin + SCORED])
        values, head = part.ravel(), np.arange(len(part))[:, None] * width
        at = np.repeat(table["root"][None], len(part), axis=0)
        for _ in range(int(table["levels"])):
            right = ~(values[head + table["feature"][at]] < table["threshold"][at])
            at = table["child"][2 * at + right]
        # Summed tree by tree, so a score does not depend on the rows beside it.
        total[begin:begin + SCORED] = np.cumsum(table["path"][at], axis=1)[:, -1]
    return 2.0 ** (-(total / count) / max(float(average_path(psi)), 1e-12))


def one_table(trees: Sequence[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The nodes of all trees one after another; ``root`` has the first of each."""
    root = np.cumsum([0, *[len(t["left"]) for t in trees]])[:-1].astype(np.int64)
    out = {k: np.concatenate([t[k] for t in trees]) for k in ("feature", "threshold", "path")}
    for side in ("left", "right"):
        out[side] = np.concatenate([t[side] + r for t, r in zip(trees, root)]).astype(np.int64)
    return out | {"root": root, "leaf": out["left"] == np.arange(len(out["left"]))}


@dataclass
class Boxes:
    """Every leaf of a forest as the ranges of values that lead to it.

    Condition i is on ``feature[i]`` and belongs to leaf ``owner[i]``, whose first
    one is ``start``; the value is not below ``low`` and below ``high``, which is
    NaN where the path never turns left. A leaf has one condition a feature."""

    owner: np.ndarray
    start: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    path: np.ndarray
    trees: int

    def met(self, x: np.ndarray) -> np.ndarray:
        """(condition, row): which conditions the rows meet."""
        value = np.ascontiguousarray(x.T)[self.feature]
        high = self.high[:, None]
        return ~(value < self.low[:, None]) & ((value < high) | np.isnan(high))


def leaf_boxes(trees: dict[str, np.ndarray]) -> Boxes:
    """Boxes of the leaves of ``one_table``."""
    start, conditions, path = [], [], []
    todo = [(int(r), {}) for r in trees["root"]]
    while todo:
        node, box = todo.pop()
        if trees["leaf"][node]:
            start.append(len(conditions))
            path.append(trees["path"][node])
            # A tree of one leaf has one condition that all values meet.
            conditions += [(len(path) - 1, f, *ends) for f, ends in (box or {0: (-np.inf, np.nan)}).items()]
            continue
        f, cut = int(trees["feature"][node]), float(trees["threshold"][node])
        low, high = box.get(f, (-np.inf, np.nan))
        todo.append((int(trees["left"][node]), box | {f: (low, float(np.fmin(high, cut)))}))
        todo.append((int(trees["right"][node]), box | {f: (max(low, cut), high)}))
    owner, feature, low, high = (np.array(c) for c in zip(*conditions))
    return Boxes(owner, np.array(start), feature, low, high, np.array(path), len(trees["root"]))


def first_steps(met: np.ndarray, rank: np.ndarray, boxes: Boxes) -> np.ndarray:
    """(leaf, row): the step from which a background row no longer keeps a way to
    the leaf shut: after the last feature whose condition it fails."""
    after = (rank[boxes.feature] + 1).astype(np.int32)[:, None]
    return np.maximum.reduceat(np.where(met, np.int32(0), after), boxes.start, axis=0)


def last_steps(met: np.ndarray, rank: np.ndarray, boxes: Boxes) -> np.ndarray:
    """(leaf, row): the last step at which an explained row leaves the way to the
    leaf open: before the first feature whose condition it fails."""
    before = rank[boxes.feature].astype(np.int32)[:, None]
    return np.minimum.reduceat(np.where(met, np.int32(len(rank)), before), boxes.start, axis=0)


def batch_scores(last: np.ndarray, first: np.ndarray, order: np.ndarray, boxes: Boxes, psi: int) -> np.ndarray:
    """Scores (explained row, step, background row) while background rows take
    over the features of the explained ones in the given order.

    A leaf is met at the steps from ``first`` of the background row to ``last``
    of the explained one. A step changes one feature, so only the leaves with a
    condition on it come or go, and one matrix product adds up their paths for
    all pairs of rows.
    """
    change = np.zeros((last.shape[1], len(order) + 1, first.shape[1]))
    change[:, 0] = boxes.path @ (first == 0)
    by_feature = np.argsort(boxes.feature, kind="stable")
    ends = np.searchsorted(boxes.feature[by_feature], np.arange(len(order) + 1))
    for step, f in enumerate(order):
        leaves = boxes.owner[by_feature[ends[f]:ends[f + 1]]]
        if len(leaves):
            path, of_x, of_b = boxes.path[leaves][:, None], last[leaves], first[leaves]
            come = (of_x > step).T.astype(float) @ ((of_b == step + 1) * path)
            change[:, step + 1] = come - (of_x == step).T.astype(float) @ ((of_b <= step) * path)
    total = np.cumsum(change, axis=1, out=change)
    return 2.0 ** (-(total / boxes.trees) / max(float(average_path(psi)), 1e-12))


def path_scores(x: np.ndarray, base: np.ndarray, rank: np.ndarray, trees: dict[str, np.ndarray], psi: int) -> np.ndarray:
    """Scores (step, background row) while a background row takes over the
    features of ``x`` in the order of ``rank``."""
    boxes = leaf_boxes(trees)
    last, first = last_steps(boxes.met(x[None, :]), rank, boxes), first_steps(boxes.met(base), rank, boxes)
    return batch_scores(last, first, np.argsort(rank), boxes, psi)[0]


def mean_gains(x: np.ndarray, base: np.ndarray, boxes: Boxes, psi: int, permutations: int, seed: int) -> np.ndarray:
    """(row, feature): mean gain of the negated score over the orders and the
    background rows."""
    total = np.zeros(x.shape)
    met, met_base = boxes.met(x), boxes.met(base)
    for order in range(permutations):
        path = np.random.default_rng([seed, order // 2]).permutation(x.shape[1])
        path = path[::-1] if order % 2 else path
        rank = np.argsort(path)
        values = batch_scores(last_steps(met, rank, boxes), first_steps(met_base, rank, boxes), path, boxes, psi)
        total[:, path] -= np.diff(values.mean(axis=2), axis=1)
    return total / permutations


def fit_forest(
    df: DataFrame, key: str, vector: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42
) -> IsolationForest:
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("_x"))
    chosen = tree_samples(rows, key, trees, sample, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values(key)["_x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes: list[list] = []
        todo = [(0, np.arange(len(x)), 0)]
        nodes.append([tree, 0, -1, -1, -1, 0.0, len(x), 0])
        while todo:
            node, members, depth = todo.pop()
            part = x[members]
            low, high = part.min(axis=0), part.max(axis=0)
            spread = np.nonzero(high > low)[0]
            if depth >= limit or len(members) < 2 or not len(spread):
                continue
            feature = int(rng.choice(spread))
            cut = float(rng.uniform(low[feature], high[feature]))
            cut = cut if cut > low[feature] else float(high[feature])
            left = part[:, feature] < cut
            for side, keep in (("left", left), ("right", ~left)):
                child = len(nodes)
                nodes.append([tree, child, -1, -1, -1, 0.0, int(keep.sum()), depth + 1])
                nodes[node][2 if side == "left" else 3] = child
                todo.append((child, members[keep], depth + 1))
            nodes[node][4], nodes[node][5] = feature, cut
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    nodes = chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    # Small and fixed from here on: pin it on the driver.
    fixed = nodes.toPandas()
    psi = int(fixed.loc[fixed["node"] == 0, "size"].max()) if len(fixed) else 0
    return IsolationForest(df.sparkSession.createDataFrame(fixed, NODE_SCHEMA), psi)


def shapley_values(
    df: DataFrame, key: str, vector: str, model: IsolationForest, background: np.ndarray, permutations: int = 4, seed: int = 42
) -> DataFrame:
    """(key, feature, contribution) of the negated anomaly score.

    Each row goes through feature orders; an order and its reverse start from
    the background rows and take over the row's features one by one. The mean
    gain of a feature is its contribution; contributions of a row sum to its
    score less the mean background score. ``background`` is a small sample.
    """
    boxes, psi, base = leaf_boxes(one_table(model.tables())), model.psi, np.asarray(background, dtype=float)
    # A row costs much more to explain than to move, so rows are dealt out evenly.
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("_x"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // EXPLAINED_TASK))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, gains array<double>"

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), EXPLAINED):
                some = pdf.iloc[at:at + EXPLAINED]
                x = np.stack([np.asarray(v, dtype=float) for v in some["_x"]])
                yield pd.DataFrame({key: some[key], "gains": list(mean_gains(x, base, boxes, psi, permutations, seed))})

    each = rows.repartition(parts).mapInPandas(explain, schema)
    return each.select(key, F.posexplode("gains").alias("feature", "gain")).groupBy(key, "feature").agg(
        F.avg("gain").alias("contribution"))


def background_rows(df: DataFrame, key: str, vector: str, rows: int = 100, seed: int = 42) -> np.ndarray:
    """A hash sample of ``rows`` rows of the whole table as a matrix."""
    head = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(rows).select(F.col(vector).cast("array<double>").alias("x")).collect()
    return np.array([r["x"] for r in head])
