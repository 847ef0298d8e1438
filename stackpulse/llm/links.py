"""Links inside buckets, without pairing every member with every other.

``link`` finds the edges that decide the connected components. First every
member of a bucket is compared with the bucket's least member only. Components
of the accepted pairs settle nearly all buckets, since a pair inside one
component needs no comparison any more. Large buckets that still span several
components are dealt into small random cells, in which members of different
components are compared, and dealt anew as long as that finds links. What is
left are the few members outside the largest component of a bucket: these are
compared with all members of other components. So every pair of a bucket is
either compared or already connected, and no link between components is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.density import _joined
from ..session import materialise

Verify = Callable[[DataFrame], DataFrame]
Likely = Callable[[Column, Column], Column]
Fits = Callable[[str, str], Column]

CELL = 96    # members of a random cell
WORTH = 4    # cells go on while one pair in so many is a link
FEW = 1 << 14  # edges that one task joins


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable, for nodes of edges (a, b).

    Alternates two steps of least-neighbour stars; the edges never grow in
    number, and each round's edges are a table in the shared folder. A few edges
    are joined by one task.
    """
    spark = edges.sparkSession
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    if 0 < mark[0] <= FEW:
        return now.coalesce(1).mapInArrow(_joined, "a long, b long").toDF("node", "component")
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = materialise(small, "small-star")
        again = _mark(now)
        if again == mark:
            break
        mark = again
    if not mark[0]:
        return spark.createDataFrame([], "node long, component long")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _merged(labels: DataFrame, accepted: DataFrame) -> DataFrame:
    """Labels after more links; nodes without a label stand for themselves."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = accepted.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tops = materialise(components(joined).withColumnRenamed("component", "top"), "tops")
    old = labels.join(tops.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = tops.join(labels.select("node"), "node", "left_anti").select("node", F.col("top").alias("component"))
    return materialise(old.unionByName(new), "components")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that span several components."""
    labelled = shared.join(labels, "node", "left").select("bucket", "node", "weight", F.coalesce("component", "node").alias("component"))
    spread = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")) \
        .filter("low <> high").select("bucket", "size")
    return materialise(labelled.join(spread, "bucket"), "open-buckets")


def _narrowed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of open buckets that stay open after more links; a bucket of one
    component stays one."""
    of = rows.select("node", "component").distinct()
    ends = found.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    tops = materialise(components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("component", "top"), "tops")
    now = rows.join(tops, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
    spread = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    return materialise(now.join(spread, "bucket"), "open-buckets")


def _cells(rows: DataFrame, turn: int, fits: Fits, likely: Likely) -> DataFrame:
    """Pairs of different components from random cells of large buckets; each
    node takes part in its largest bucket."""
    largest = rows.filter(F.col("size") > CELL).groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("of"), F.first("component").alias("component"), F.first("weight").alias("wx"), F.first("sketch").alias("sx"))
    dealt = largest.select("of.bucket", "node", "component", "wx", "sx", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("of.size") / CELL)).alias("cell"))
    other = dealt.select("bucket", "cell", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("wx").alias("wy"), F.col("sx").alias("sy"))
    return dealt.join(other, ["bucket", "cell"]).filter("node < y and component <> cy").filter(fits("wx", "wy")).filter(likely(F.col("sx"), F.col("sy"))).select(F.col("node").alias("a"), F.col("y").alias("b"))


def _outsiders(rows: DataFrame, fits: Fits, likely: Likely) -> DataFrame:
    """Members outside the largest component of a bucket, paired with members of
    other components, each pair in one of the buckets that it shares only."""
    listed = rows.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    full = rows.join(listed, "node")
    largest = rows.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("top")) \
        .select("bucket", F.col("top.component").alias("largest"))
    outside = full.join(largest, "bucket").filter("component <> largest") \
        .select("bucket", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("buckets").alias("bx"), F.col("weight").alias("wx"), F.col("sketch").alias("sx"), "largest")
    inside = full.select("bucket", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("buckets").alias("by"), F.col("weight").alias("wy"), F.col("sketch").alias("sy"))
    # Between two outsiders the lesser one speaks.
    return outside.join(inside, "bucket").filter("cx <> cy and (cy = largest or x < y)").filter(fits("wx", "wy")) \
        .filter(F.col("bucket") == F.array_min(F.array_intersect("bx", "by"))).filter(likely(F.col("sx"), F.col("sy"))) \
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def size_ratio(numerator: int, denominator: int) -> Fits:
    """Sets whose sizes are further apart than the limit cannot be that alike."""
    return lambda x, y: F.least(x, y) * denominator >= F.greatest(x, y) * numerator


def link(members: DataFrame, verify: Verify, fits: Fits, sketch: Callable[[DataFrame], DataFrame] | None = None, likely: Likely = lambda x, y: F.lit(True)) -> DataFrame:
    """(node, component) for linked nodes, from (bucket, node, weight) rows.

    ``verify`` takes pairs (a, b), a below b, and returns those that are links.
    ``fits`` tells from the weights, the set sizes, whether two nodes can be one.
    ``sketch`` gives (node, sketch) rows for the nodes of buckets that stay
    open; ``likely`` looks at the sketches of a pair and says whether it can be
    a link. It must hold for every link.
    """
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "weight")).alias("hub"), F.max("node").alias("last")) \
        .filter("hub.node <> last").select("bucket", F.col("hub.node").alias("hub"), F.col("hub.weight").alias("hub_weight"))
    shared = materialise(members.join(hubs, "bucket").select("bucket", "node", "weight", "hub", "hub_weight"), "buckets")
    tried = materialise(shared.filter("node <> hub").filter(fits("weight", "hub_weight")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "hub-pairs")
    labels = materialise(components(materialise(verify(tried).select("a", "b"), "links")), "components")
    rows = _open(shared, labels)
    if rows.isEmpty():
        return labels
    sketches = None if sketch is None else materialise(sketch(rows.select("node").distinct()), "sketches")

    def sketched() -> DataFrame:
        return rows.withColumn("sketch", F.lit(None)) if sketches is None else rows.join(sketches, "node")

    turn, more = 0, []
    while not rows.filter(F.col("size") > CELL).isEmpty():
        turn += 1
        pairs = materialise(_cells(sketched(), turn, fits, likely), "cell-pairs")
        found = materialise(verify(pairs).select("a", "b"), "links")
        n_pairs, n_found = pairs.count(), found.count()
        if n_found:
            more.append(found)
            rows = _narrowed(rows, found)
        if n_found * WORTH < n_pairs or not n_found:
            break
    rest = materialise(_outsiders(sketched(), fits, likely), "last-pairs")
    if not rest.isEmpty():
        more.append(materialise(verify(rest).select("a", "b"), "links"))
    return _merged(labels, functools.reduce(DataFrame.unionByName, more)) if more else labels
