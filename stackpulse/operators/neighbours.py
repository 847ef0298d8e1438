"""Exact neighbour search: k nearest neighbours and eps ranges.

Equal points are folded into one weighted point first, so a group of copies
costs one row. The points are then packed into blocks of bounded size. A ball
tree, grown on a bounded sample in the full space, deals them to slabs (its
leaves); inside a slab they are cut into tiles and blocks along the leaf's own
directions. Distances to a few far-apart pivots make the boxes of slabs, tiles
and blocks: by the triangle inequality no distance is shorter than the largest
gap between two boxes. Boxes, and spheres in the full space, prune on the way
from a query block to its candidate blocks before any vectors move. Pairs of
blocks that are left travel in groups, so that a block is sent once for each
group it meets instead of once for each block. Each pair is measured as a whole
and gives back reduced results only, never its point pairs. In the search for
the k nearest a task holds a group of query blocks and all that they meet
streams past it, so it gives back k neighbours a point. Products in single
precision tell which pairs of points are measured.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..session import materialise
from .ordered import index_rows

BLOCK_POINTS = 512
PIVOTS = 8
# Bounds of the ball tree: leaves, sampled points, and numbers sent for either.
LEAVES, SAMPLE, SENT = 1024, 8192, 1 << 22
# Blocks of a group that travel together, and about how many bytes of vectors.
GROUP_BLOCKS, GROUP_BYTES = 8, 1 << 24
_PART = 1 << 20
# Groups up to this size may be ordered by a plain window.
PLAIN_WINDOW_ROWS = 1_000_000
# Up to this many blocks are compared through one array.
FEW_BLOCKS = 256
_CHUNK = 4_000_000
# Points that a query block meets at once.
MET = 4096
# Rounding of a square in single precision, for each dimension and its size.
SINGLE = 2.4e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Euclidean distances between two small sets, from differences, so the
    result for a pair does not depend on the set it was measured in."""
    out = np.empty((len(a), len(b)))
    step = max(1, _CHUNK // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def rough_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """All squared distances from one matrix product, and how far off they may be."""
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = 4e-15 * (a.shape[1] + 8) * (aa.max(initial=0.0) + bb.max(initial=0.0))
    return aa[:, None] + bb[None, :] - 2 * (a @ b.T), float(slack)


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of chosen pairs, as ``distances`` has them."""
    out = np.empty(len(i))
    step = max(1, _CHUNK // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        diff = a[i[at:at + step]] - b[j[at:at + step]]
        out[at:at + step] = np.sqrt((diff * diff).sum(axis=1))
    return out


def single_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """As ``rough_squares``, from a product in single precision around the middle
    of ``a``; not for numbers that it cannot hold."""
    mid = a.mean(axis=0) if len(a) else 0.0
    x, y = a - mid, b - mid
    aa, bb = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", y, y)
    size = aa.max(initial=0.0) + bb.max(initial=0.0)
    if not size < 1e30:
        return rough_squares(a, b)
    squares = x.astype(np.float32) @ y.astype(np.float32).T
    squares *= -2
    squares += aa.astype(np.float32)[:, None]
    squares += bb.astype(np.float32)
    return squares, float(SINGLE * (a.shape[1] + 8) * size) + 1e-30


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which distances are at most ``eps``; close calls are measured."""
    squares, slack = single_squares(a, b)
    if slack > 1e-2 * eps * eps:  # too coarse for so small a radius
        squares, slack = rough_squares(a, b)
    slack += 1e-6 * eps * eps if squares.dtype == np.float32 else 1e-12 * eps * eps
    out = squares <= eps * eps
    i, j = np.nonzero(np.abs(squares - eps * eps) <= slack)
    out[i, j] = pair_distances(a, b, i, j) <= eps
    return out


def fold_copies(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct points (point, weight, vec); ``point`` is the least key."""
    return df.groupBy(F.col(vector).alias("vec")).agg(
        F.min(key).cast("bigint").alias("point"), F.count(F.lit(1)).alias("weight"))


def map_to_points(df: DataFrame, points: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, point) of every row. ``points`` has one row per vector, so a group
    of copies is skewed on the row side only, which AQE splits."""
    return df.select(F.col(key), F.col(vector).alias("vec")).join(points.select("vec", "point"), "vec").drop("vec")


@dataclass
class Blocks:
    """``payload``: block, slab, tile, ids, weights, flat (vectors end to end).
    ``meta``: block, slab, tile, lo, hi (boxes), points, weight, centre, reach
    and, when asked for, limits (bound on each point's k-th distance) and radius
    (the largest of them). ``group`` gives a block's group from its number."""

    payload: DataFrame
    meta: DataFrame
    dim: int
    most: int  # about the number of blocks, at most
    axes: int
    slabs_together: int  # slabs of a group; 0 if a tile is one
    slabs_asking: int  # slabs of a group that asks alone; 0 if a tile is one
    leaves: int  # slabs, at most

    def group(self, block: Column) -> Column:
        tile = F.floor(block / _PART)
        return (F.floor(tile / _PART / self.slabs_together) if self.slabs_together else tile).cast("bigint")

    def asking_group(self, block: Column) -> Column:
        tile = F.floor(block / _PART)
        return (F.floor(tile / _PART / self.slabs_asking) if self.slabs_asking else tile).cast("bigint")

    def dealt(self, rows: DataFrame, group: str) -> DataFrame:
        """One task for each group that asks, if groups are numbered in a row."""
        if not self.slabs_asking:
            return rows.repartition(group)
        return rows.repartitionById(math.ceil(self.leaves / self.slabs_asking), F.col(group).cast("int"))


def build_blocks(points: DataFrame, block_points: int = BLOCK_POINTS, k: int | None = None) -> Blocks:
    """Pack a pinned table of folded points; ``k`` also bounds k-th distances."""
    row = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.min(F.size("vec")).alias("dmin")).first()
    n, dim = row["n"], row["d"] or 0
    if n and row["dmin"] != dim:
        raise ValueError("vectors differ in length")
    leaves = max(1, min(LEAVES, SENT // max(1, dim), math.ceil(n / block_points)))
    placed = _place(points, n, dim, block_points, leaves, (k or 0) + 1)
    n_axes = min(PIVOTS, dim) if n <= block_points else PIVOTS
    axes = [F.col("axes")[i] for i in range(n_axes)]
    payload = placed.groupBy("block", "slab", "tile").agg(
        F.collect_list(F.struct("point", "weight", "vec")).alias("rows"),
        F.array(*[F.min(a) for a in axes]).alias("lo"),
        F.array(*[F.max(a) for a in axes]).alias("hi"),
    ).select(
        "block", "slab", "tile", "lo", "hi",
        F.col("rows.point").alias("ids"), F.col("rows.weight").alias("weights"), F.flatten("rows.vec").alias("flat"),
    )
    payload = materialise(payload, "blocks")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            centre, reach, limits, radius = [], [], [], []
            for flat in pdf["flat"]:
                x = np.asarray(flat, dtype=float).reshape(-1, dim)
                mid = x.mean(axis=0)
                centre.append(mid.tolist())
                reach.append(float(distances(x, mid[None, :]).max()))
                limit = np.full(len(x), np.inf)
                if k is not None and len(x) >= k:
                    squares, slack = rough_squares(x, x)
                    limit = np.sqrt(np.partition(squares, k - 1, axis=1)[:, k - 1].clip(0) + 2 * slack) * (1 + 1e-12)
                limits.append(limit.tolist() if k is not None else [])
                radius.append(float(limit.max()))
            yield pdf.drop(columns=["flat"]).assign(centre=centre, reach=reach, limits=limits, radius=radius)

    own = payload.select(
        "block", "slab", "tile", "lo", "hi", F.size("ids").alias("points"),
        F.aggregate("weights", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("weight"), "flat")
    meta = own.mapInPandas(
        measure, "block long, slab long, tile long, lo array<double>, hi array<double>, points int, weight long,"
        " centre array<double>, reach double, limits array<double>, radius double")
    blocks = math.ceil(n / block_points)
    # Few blocks form small groups, so that every core has some.
    most = max(GROUP_BLOCKS, GROUP_BYTES // (8 * max(1, dim) * block_points))
    size = min(most, max(1, int(blocks / math.sqrt(4 * points.sparkSession.sparkContext.defaultParallelism))))
    together = size * leaves // max(1, blocks)
    # Four groups a core that ask, if they are not too large.
    asking = min(most * leaves // max(1, blocks), max(1, leaves // (4 * points.sparkSession.sparkContext.defaultParallelism)))
    return Blocks(payload, materialise(meta, "block_meta"), dim, blocks + 2 * leaves, n_axes, together, asking, leaves)


@dataclass
class PointSet:
    """Folded points of a table and their blocks, shared by several searches."""

    points: DataFrame
    blocks: Blocks


def point_set(df: DataFrame, key: str, vector: str, k: int | None = None, block_points: int = BLOCK_POINTS) -> PointSet:
    points = materialise(fold_copies(df, key, vector), "points")
    return PointSet(points, build_blocks(points, max(block_points, (k or 0) + 1), k))


def far_points(x: np.ndarray, count: int) -> np.ndarray:
    """Points far from each other: each the furthest from those before it."""
    found = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    least = ((x - x[found[0]]) ** 2).sum(axis=1)
    while len(found) < count:
        found.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[found[-1]]) ** 2).sum(axis=1))
    return x[found]


@dataclass
class BallTree:
    """Node i sends a point down ``children[i][x . normals[i] > cuts[i]]``; a
    child below 0 is a leaf, -1 the first. ``directions`` of a leaf are its two
    main ones."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    directions: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.cuts) else -1)
        for i in range(len(self.cuts)):  # parents come before their children
            here = np.flatnonzero(at == i)
            if len(here):
                at[here] = self.children[i][(x[here] @ self.normals[i] > self.cuts[i]).astype(int)]
        return -1 - at


def _split(x: np.ndarray, least: int) -> tuple[np.ndarray, float] | None:
    """A plane between the two means of ``x``, moved to the median if one side
    would hold fewer than ``least`` points."""
    a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    for _ in range(5):
        far = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
        if far.all() or not far.any():
            break
        a, b = x[~far].mean(axis=0), x[far].mean(axis=0)
    normal = b - a
    along = x @ normal
    cut = float((b @ b - a @ a) / 2)
    n = int((along > cut).sum())
    if min(n, len(x) - n) < least:
        cut = float(np.median(along))
        n = int((along > cut).sum())
    return (normal, cut) if min(n, len(x) - n) >= max(1, min(least, len(x) // 4)) else None


def ball_tree(x: np.ndarray, leaves: int, least: int) -> BallTree:
    """Grown by splitting the fullest leaf; leaves are numbered so that near
    ones have near numbers."""
    held, nodes, root = [(-len(x), 0, np.arange(len(x)), None)], [], None
    done, serial = [], 0
    while held and len(held) + len(done) < leaves:
        _, _, rows, above = heapq.heappop(held)
        plane = _split(x[rows], least) if len(rows) >= 2 * least else None
        if plane is None:
            done.append((rows, above))
            continue
        right = x[rows] @ plane[0] > plane[1]
        i = len(nodes)
        nodes.append((*plane, [None, None]))
        if above is not None:
            nodes[above[0]][2][above[1]] = i
        for side, part in enumerate((rows[~right], rows[right])):
            serial += 1
            heapq.heappush(held, (-len(part), serial, part, (i, side)))
    ends = {above: rows for rows, above in done + [(rows, above) for _, _, rows, above in held]}
    order, todo = [], [0] if nodes else []
    if not nodes:
        order = [None]
    while todo:  # leaves from left to right
        i = todo.pop()
        if isinstance(i, tuple):
            nodes[i[0]][2][i[1]] = -1 - len(order)
            order.append(i)
            continue
        for side in (1, 0):
            child = nodes[i][2][side]
            todo.append((i, side) if child is None else child)
    directions = np.zeros((len(order), 2, x.shape[1]))
    for leaf, above in enumerate(order):
        rows = x[ends[above]]
        if len(rows) > 1:
            main = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)[2][:2]
            directions[leaf, :len(main)] = main
    return BallTree(np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes], dtype=np.int64), directions)


def _located(shared):
    """Pivot distances, leaf and coordinates inside the leaf of each point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, pivots = shared.value
        for batch in batches:
            if not len(batch):
                continue
            vec = batch.column(batch.schema.get_field_index("vec"))
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            leaf = tree.leaf_of(x)
            along = np.einsum("nd,nkd->nk", x, tree.directions[leaf])
            axes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots)), pa.array(distances(x, pivots).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, axes, pa.array(leaf), pa.array(along[:, 0]), pa.array(along[:, 1])],
                                             names=[*batch.schema.names, "axes", "slab", "_a0", "_a1"])
    return run


def _sample(points: DataFrame, n: int, dim: int, wanted: int) -> np.ndarray:
    """The vectors of the least hashes. Each partition would send its own best
    ones to the driver, in all far more than are wanted, so hashes that are
    surely too large go first."""
    share = (wanted + 8 * math.sqrt(wanted) + 16) / n
    mark = F.xxhash64("point")
    some = points if share >= 1 else points.filter(mark < F.lit(int(-2.0 ** 63 + share * 2.0 ** 64)))
    for rows in (some, points):
        found = rows.orderBy(mark, "point").limit(wanted).select(F.col("vec").cast("array<double>").alias("vec")).toArrow()
        if len(found) >= min(wanted, n):
            break
    return found.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _place(points: DataFrame, n: int, dim: int, block_points: int, leaves: int, least: int) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    if n <= block_points:
        return points.withColumns({
            "axes": F.slice("vec", 1, PIVOTS), "slab": zero, "tile": zero, "block": zero})
    sampled = min(SAMPLE, max(leaves, SENT // dim))
    x = _sample(points, n, dim, sampled)
    scale = len(x) / n
    tree = ball_tree(x, leaves, max(1, round(max(block_points / 3, least) * scale)))
    shared = points.sparkSession.sparkContext.broadcast((tree, far_points(x, PIVOTS)))  # ``LEAVES`` planes at most
    points = points.select("point", "weight", F.col("vec").cast("array<double>").alias("vec"))
    located = points.mapInArrow(_located(shared), "point long, weight long, vec array<double>, axes array<double>, slab long, _a0 double, _a1 double")
    if n <= PLAIN_WINDOW_ROWS:
        w = Window.partitionBy("slab")
        ranked = located.withColumns({
            "row_no": F.row_number().over(w.orderBy("_a0", "point")) - 1, "series_rows": F.count(F.lit(1)).over(w)})
    else:
        ranked = index_rows(located, ["_a0", "point"], ["slab"]).drop("_slice")
    tiles = F.ceil(F.sqrt(F.col("series_rows") / block_points))
    tile = F.col("slab") * _PART + F.floor(F.col("row_no") * tiles / F.col("series_rows")).cast("bigint")
    w = Window.partitionBy("tile")  # about the root of block_points times the slab's rows each
    rows = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy("_a1", "point")) - 1
    part = F.floor(rank * F.ceil(rows / block_points) / rows).cast("bigint")
    return ranked.withColumn("tile", tile).withColumn("block", F.col("tile") * _PART + part).drop("row_no", "series_rows", "_a0", "_a1")


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Largest gap between two boxes on one axis; no distance is shorter."""
    gaps = F.zip_with(
        F.zip_with(lo_a, hi_b, lambda x, y: x - y), F.zip_with(lo_b, hi_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.greatest(F.array_max(gaps), F.lit(0.0))


def _slack(radius: Column, lo: Column, hi: Column) -> Column:
    """Radius with room for rounding in the axes."""
    size = F.greatest(F.abs(F.array_min(lo)), F.abs(F.array_max(hi)))
    return radius + F.lit(1e-9) * (radius + size + 1.0)


def _apart(left: str | Column, right: str | Column) -> Column:
    return F.sqrt(F.aggregate(
        F.zip_with(left, right, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def _side(table: DataFrame, prefix: str, level: str, radius: Column | None = None) -> DataFrame:
    """Boxes and spheres of a level, named for one side of a pair."""
    cols = [F.col(level).alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in ("lo", "hi", "centre", "reach")]]
    if radius is not None:
        cols.append(_slack(radius, F.col("lo"), F.col("hi")).alias("wide"))
    return table.select(*cols)


def _spheres(table: DataFrame, keys: list[str], blocks: Blocks) -> DataFrame:
    """Per key: box, sphere around the spheres below it, weight, largest radius."""
    mids = table.groupBy(*keys).agg(F.array(*[F.avg(F.col("centre")[i]) for i in range(blocks.dim)]).alias("mid"))
    return table.join(mids, keys).groupBy(*keys).agg(
        F.array(*[F.min(F.col("lo")[i]) for i in range(blocks.axes)]).alias("lo"),
        F.array(*[F.max(F.col("hi")[i]) for i in range(blocks.axes)]).alias("hi"),
        F.first("mid").alias("centre"),
        F.max((_apart("centre", "mid") + F.col("reach")) * (1 + 1e-12)).alias("reach"),
        F.sum("weight").alias("weight"), F.max("radius").alias("radius"),
    )


def tile_spheres(blocks: Blocks) -> DataFrame:
    return _spheres(blocks.meta, ["slab", "tile"], blocks)


def _dealt_out(small: DataFrame, *keys: str) -> DataFrame:
    """A table of few bytes but much work over all cores."""
    return small.repartition(small.sparkSession.sparkContext.defaultParallelism, *keys)


def tile_pairs(blocks: Blocks, tiles: DataFrame, radius: float | None = None) -> DataFrame:
    """Ordered pairs of tiles (q, c) in reach, with both sides' spheres.

    The slabs, ``LEAVES`` at most, are attached as one array; tiles come by an
    equi join on the slab.
    """
    slabs = _spheres(tiles, ["slab"], blocks).agg(F.collect_list(F.struct("slab", "lo", "hi", "centre", "reach")))
    asking = _side(tiles, "q", "tile", F.col("radius") if radius is None else F.lit(float(radius)))
    touched = F.filter("slabs", lambda b: (_gap(F.col("q_lo"), F.col("q_hi"), b["lo"], b["hi"]) <= F.col("wide"))
                       & (_apart(F.col("q_centre"), b["centre"]) - F.col("q_reach") - b["reach"] <= F.col("wide")))
    step = _dealt_out(asking, "q").withColumn("slabs", slabs.scalar()).select(*asking.columns, F.explode(touched["slab"]).alias("slab"))
    others = tiles.select("slab", F.col("tile").alias("c"), *[F.col(x).alias(f"c_{x}") for x in ("lo", "hi", "centre", "reach")])
    return in_reach(step.join(others, "slab").drop("slab"))


def in_reach(pairs: DataFrame) -> DataFrame:
    """Keep pairs whose boxes and spheres come within ``wide`` of each other;
    ``apart`` is the distance of the centres."""
    near = pairs.filter(_gap(F.col("q_lo"), F.col("q_hi"), F.col("c_lo"), F.col("c_hi")) <= F.col("wide"))
    near = near.withColumn("apart", _apart("q_centre", "c_centre"))
    return near.filter(F.col("apart") - F.col("q_reach") - F.col("c_reach") <= F.col("wide"))


def block_pairs(blocks: Blocks, tiles: DataFrame | None, radius: float | None = None) -> DataFrame:
    """Ordered pairs of blocks (q, c) in reach, with both sides' spheres.

    ``tiles`` are the tile pairs (q, c) to look into; without them every block
    is compared with all the others through one array, which is for few blocks.
    """
    asked = F.col("radius") if radius is None else F.lit(float(radius))
    asking = _side(blocks.meta, "q", "block", asked)
    if tiles is None:
        every = blocks.meta.agg(F.collect_list(F.struct(F.col("block").alias("c"), *[
            F.col(x).alias(f"c_{x}") for x in ("lo", "hi", "centre", "reach")])))
        return in_reach(asking.withColumn("b", F.explode(every.scalar())).select(*asking.columns, "b.*"))
    home = blocks.meta.select("block", "tile")
    pairs = tiles.select(F.col("q").alias("q_tile"), F.col("c").alias("c_tile"))
    asking = asking.join(home.select(F.col("block").alias("q"), F.col("tile").alias("q_tile")), "q")
    others = _side(blocks.meta, "c", "block").join(home.select(F.col("block").alias("c"), F.col("tile").alias("c_tile")), "c")
    return in_reach(_dealt_out(pairs, "q_tile", "c_tile").join(asking, "q_tile").join(others, "c_tile").drop("q_tile", "c_tile"))


def candidate_pairs(blocks: Blocks, radius: float | None = None) -> DataFrame:
    """Ordered pairs (q, c) of blocks that may hold points within the radius of
    the query block; without ``radius`` each block asks with its own.

    Whole tiles are compared before their blocks are.
    """
    tiles = None if blocks.most <= FEW_BLOCKS else tile_pairs(blocks, tile_spheres(blocks), radius)
    return block_pairs(blocks, tiles, radius).select("q", "c")


def measure_pairs(
    blocks: Blocks, pairs: DataFrame, left: DataFrame, right: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Bring the payloads of block pairs together and run ``fn`` on them.

    Near blocks form groups; a payload is sent once for each group it meets.
    """
    keys = ["q_group", "c_group"]
    grouped = pairs.select("q", "c", blocks.group(F.col("q")).alias("q_group"), blocks.group(F.col("c")).alias("c_group"))
    q = left.withColumnsRenamed({x: f"q_{x}" for x in left.columns})
    c = right.withColumnsRenamed({x: f"c_{x}" for x in right.columns})
    asking = grouped.groupBy(*keys, "q").agg(F.collect_list("c").alias("c")).join(q, F.col("q") == F.col("q_block")).drop("q_block")
    meeting = grouped.select(F.col("q_group").alias("of_q"), F.col("c_group").alias("of_c"), F.col("c").alias("c_block")).distinct()
    asked = meeting.join(c, "c_block")
    names = StructType.fromDDL(schema).names

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        met = ours.drop(columns=keys).explode("c").merge(theirs.drop(columns=["of_q", "of_c"]), left_on="c", right_on="c_block").drop(columns="c_block")
        found = list(fn(iter([met])))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({x: [] for x in names})

    return asking.groupBy(*keys).cogroup(asked.groupBy("of_q", "of_c")).applyInPandas(run, schema)


def nearest(df: DataFrame, key: str, vector: str, k: int, block_points: int = BLOCK_POINTS) -> DataFrame:
    """k nearest rows of every row: (key, rank, neighbour, distance).

    A row is its own first neighbour when it has no copies; ties go to the
    smaller key. Fewer than k rows in all give fewer neighbours.
    """
    found = point_set(df, key, vector, k, block_points)
    points, near = found.points, nearest_points(found.blocks, k)
    # The first k members of each point are enough for any list of k.
    first = Window.partitionBy("vec").orderBy(key)
    members = df.select(F.col(vector).alias("vec"), key).withColumn("_m", F.row_number().over(first)).filter(F.col("_m") <= k)
    members = members.join(points.select("vec", "point"), "vec").select(
        F.col("point").alias("neighbour_point"), F.col(key).alias("neighbour"))
    lists = near.join(members, "neighbour_point")
    rank = F.row_number().over(Window.partitionBy("point").orderBy("distance", "neighbour"))
    lists = lists.withColumn("rank", rank).filter(F.col("rank") <= k)
    packed = lists.groupBy("point").agg(F.collect_list(F.struct("rank", "neighbour", "distance")).alias("l"))
    rows = map_to_points(df, points, key, vector)
    return rows.join(packed, "point").select(key, F.explode("l").alias("l")).select(key, "l.*")


class _Asking:
    """The k nearest of each point of one query block in what it has met. Limits
    shrink on the way, so few pairs of points are measured."""

    def __init__(self, ids: np.ndarray, a: np.ndarray, limits: np.ndarray, k: int):
        self.ids, self.a, self.limits, self.k = ids, a, np.array(limits, dtype=float), k
        self.mid = a.mean(axis=0)
        x = a - self.mid
        self.size, self.single = np.einsum("nd,nd->n", x, x), x.astype(np.float32)
        self.at, self.near, self.d, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def _squares(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squares less the size of the asking point, and how far off they may be."""
        y = b - self.mid
        bb = np.einsum("nd,nd->n", y, y)
        most = bb.max(initial=0.0)
        if not most + self.size.max(initial=0.0) < 1e30:
            squares, slack = rough_squares(self.a, b)
            return squares - self.size[:, None], np.full(len(self.a), slack)
        squares = self.single @ y.astype(np.float32).T
        squares *= -2
        squares += bb.astype(np.float32)
        return squares, SINGLE * (b.shape[1] + 8) * (self.size + most) + 1e-30

    def meet(self, b: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> None:
        squares, slack = self._squares(b)
        edge = self.limits ** 2 * (1 + 1e-9) + slack - self.size
        if len(b) > self.k and not np.isfinite(self.limits).all():
            edge = np.minimum(edge, np.partition(squares, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
        i, j = np.divmod(np.flatnonzero(squares <= edge.astype(squares.dtype)[:, None]), max(1, len(b)))
        d = pair_distances(self.a, b, i, j)
        inside = d <= self.limits[i]
        i, j, d = i[inside], j[inside], d[inside]
        if not len(i):
            return
        touched = np.zeros(len(self.a), bool)
        touched[i] = True
        old = touched[self.at]
        at, near = np.concatenate([self.at[old], i]), np.concatenate([self.near[old], ids[j]])
        d, weights = np.concatenate([self.d[old], d]), np.concatenate([self.weights[old], weights[j]])
        order = np.lexsort((near, d, at))
        order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < self.k]
        at, near, d, weights = at[order], near[order], d[order], weights[order]
        full = np.arange(len(at)) - np.searchsorted(at, at) == self.k - 1
        self.limits[at[full]] = d[full]
        for name, new in (("at", at), ("near", near), ("d", d), ("weights", weights)):
            setattr(self, name, np.concatenate([getattr(self, name)[~old], new]))

    def found(self) -> tuple[np.ndarray, ...]:
        """(points, neighbours, distances, weights), the nearest first."""
        order = np.lexsort((self.near, self.d, self.at))
        return self.ids[self.at[order]], self.near[order], self.d[order], self.weights[order]


def _nearest_of(pairs: pd.DataFrame, dim: int, k: int) -> tuple[np.ndarray, ...]:
    """(points, neighbours, distances, weights): up to k nearest of each point of
    one query block in the blocks of ``pairs``."""
    first = next(pairs.itertuples(index=False))
    block = _Asking(np.asarray(first.q_ids), np.asarray(first.q_flat, dtype=float).reshape(-1, dim), first.q_limits, k)
    for r in pairs.itertuples(index=False):
        block.meet(np.asarray(r.c_flat, dtype=float).reshape(-1, dim), np.asarray(r.c_ids), np.asarray(r.c_weights))
    return block.found()


def _streamed(dim: int, k: int):
    """Nearest points from rows (g, kind, block, ids, weights, flat, limits, wants)
    in order: the query blocks of a group (kind 0) with the blocks that they
    want, then the blocks they meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asking, wanted = None, [], {}
        held: list[tuple] = []

        def meet() -> None:
            if held:
                b, ids, weights = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
                for i in held[0][0]:
                    asking[i].meet(b, ids, weights)
                held.clear()

        def result() -> pa.RecordBatch:
            found = [np.concatenate(x) for x in zip(*[block.found() for block in asking])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["point", "neighbour_point", "distance", "weight"])

        for batch in batches:
            groups, kinds, numbers = (batch.column(c).to_pylist() for c in ("g", "kind", "block"))
            for row, (g, kind, number) in enumerate(zip(groups, kinds, numbers)):
                ids, weights, flat, limits, wants = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("ids", "weights", "flat", "limits", "wants"))
                x = flat.reshape(-1, dim)
                if g != group:
                    meet()
                    if asking:
                        yield result()
                    group, asking, wanted = g, [], {}
                if kind == 0:
                    for c in wants.tolist():
                        wanted.setdefault(c, []).append(len(asking))
                    asking.append(_Asking(ids.copy(), x.copy(), limits, k))
                    continue
                if held and (held[0][0] != wanted[number] or sum(len(h[1]) for h in held) + len(x) > MET):
                    meet()
                held.append((wanted[number], x, ids, weights))
            meet()
        if asking:
            yield result()
    return run


def nearest_points(blocks: Blocks, k: int) -> DataFrame:
    """k nearest distinct points of every point:
    (point, neighbour_point, distance, weight of the neighbour).

    ``blocks`` must have been built for this k. One task holds the blocks of a
    group that asks, ``GROUP_BYTES`` of vectors or four groups a core, and reads
    the blocks that they may reach, near ones first.
    """
    pairs = candidate_pairs(blocks).select("q", "c", blocks.asking_group(F.col("q")).alias("g"), blocks.asking_group(F.col("c")).alias("of_c"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    payload = blocks.payload.select("block", "ids", "weights", F.col("flat").cast("array<double>").alias("flat"))
    asking = pairs.groupBy("g", F.col("q").alias("block")).agg(F.collect_list("c").alias("wants")) \
        .join(payload.join(blocks.meta.select("block", "limits"), "block"), "block").withColumn("kind", F.lit(0))
    # A task may send its blocks to every group, so they are dealt out first.
    spread = payload.repartition(4 * payload.sparkSession.sparkContext.defaultParallelism, "block")
    met = pairs.select("g", F.col("c").alias("block"), F.when(F.col("g") == F.col("of_c"), 1).otherwise(2).alias("kind")).distinct() \
        .join(spread, "block").withColumns({"wants": none("bigint"), "limits": none("double")})
    columns = ["g", "kind", "block", "ids", "weights", "flat", "limits", "wants"]
    rows = blocks.dealt(asking.select(*columns).unionByName(met.select(*columns)), "g").sortWithinPartitions("g", "kind", "block")
    return rows.mapInArrow(_streamed(blocks.dim, k), "point long, neighbour_point long, distance double, weight long")


def kth_of_points(blocks: Blocks, k: int) -> DataFrame:
    """(point, k_distance) of every point that has k rows around it."""
    near = nearest_points(blocks, k)
    upto = Window.partitionBy("point").orderBy("distance", "neighbour_point").rowsBetween(Window.unboundedPreceding, 0)
    reached = near.withColumn("_w", F.sum("weight").over(upto)).filter(F.col("_w") >= k)
    return reached.groupBy("point").agg(F.min("distance").alias("k_distance"))


def kth_distances(
    df: DataFrame, key: str, vector: str, k: int, block_points: int = BLOCK_POINTS, points: PointSet | None = None
) -> DataFrame:
    """Distance of every row to its k-th nearest row, itself counted."""
    found = points or point_set(df, key, vector, k, block_points)
    return map_to_points(df, found.points, key, vector).join(kth_of_points(found.blocks, k), "point", "left").drop("point")


def within_eps_counts(df: DataFrame, key: str, vector: str, eps: float, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Number of rows within ``eps`` of every row, itself counted."""
    found = point_set(df, key, vector, None, block_points)
    blocks = found.blocks
    counts = eps_counts(blocks, candidate_pairs(blocks, eps), eps)
    members = blocks.payload.select("block", F.posexplode("ids").alias("pos", "point"))
    counts = members.join(counts, ["block", "pos"]).select("point", "neighbours")
    return map_to_points(df, found.points, key, vector).join(counts, "point").drop("point")


def eps_counts(blocks: Blocks, pairs: DataFrame, eps: float) -> DataFrame:
    """Weighted neighbour count per point: (block, pos, neighbours)."""
    dim = blocks.dim

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a = np.asarray(r.q_flat, dtype=float).reshape(-1, dim)
                b = np.asarray(r.c_flat, dtype=float).reshape(-1, dim)
                hits = within(a, b, eps) @ np.asarray(r.c_weights, dtype=np.int64)
                at = np.nonzero(hits)[0]
                if len(at):
                    yield pd.DataFrame({"block": r.q, "pos": at.astype(np.int32), "hits": hits[at]})

    shares = measure_pairs(
        blocks, pairs, blocks.payload.select("block", "flat"), blocks.payload.select("block", "weights", "flat"),
        count, "block long, pos int, hits long")
    return shares.groupBy("block", "pos").agg(F.sum("hits").alias("neighbours"))
