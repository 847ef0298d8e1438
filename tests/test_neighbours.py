import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackpulse.operators import density, neighbours as nn


def make(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


def cloud(seed=0, n=260, d=5):
    rng = np.random.default_rng(seed)
    blob = rng.normal(size=(n, d))
    blob[: n // 3] = blob[0]  # a third of all rows are copies
    blob[n // 3: n // 2] = blob[1] + rng.normal(scale=0.01, size=(n // 2 - n // 3, d))
    return blob


def brute(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.fixture(params=[0, 256], ids=["descent", "one array"])
def few(request, monkeypatch):
    monkeypatch.setattr(nn, "FEW_BLOCKS", request.param)


@pytest.mark.parametrize("block", [12, 512])
def test_nearest_equals_brute_force(spark, few, block):
    x = cloud()
    got = nn.nearest(make(spark, x), "id", "x", 5, block).toPandas()
    d = brute(x)
    assert len(got) == 5 * len(x)
    for i, part in got.groupby("id"):
        want = sorted((d[i, j], j) for j in range(len(x)))[:5]
        part = part.sort_values("rank")
        assert part["neighbour"].tolist() == [j for _, j in want]
        assert np.allclose(part["distance"], [v for v, _ in want])


def test_kth_distance_counts_copies(spark, few):
    x = cloud(3)
    got = nn.kth_distances(make(spark, x), "id", "x", 6, 12).toPandas().set_index("id")["k_distance"]
    want = np.sort(brute(x), axis=1)[:, 5]
    assert np.allclose(got.sort_index(), want)


def test_fewer_rows_than_k(spark):
    got = nn.nearest(make(spark, np.eye(3)), "id", "x", 5).toPandas()
    assert len(got) == 9


def test_eps_counts(spark, few):
    x = cloud(1)
    got = nn.within_eps_counts(make(spark, x), "id", "x", 1.0, 12).toPandas().set_index("id")["neighbours"]
    assert (got.sort_index().to_numpy() == (brute(x) <= 1.0).sum(axis=1)).all()


def brute_dbscan(x, eps, m):
    near = brute(x) <= eps
    core = near.sum(axis=1) >= m
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = number
        while todo:
            for j in np.nonzero(near[todo.pop()])[0]:
                if label[j] < 0:
                    label[j] = number
                    if core[j]:
                        todo.append(j)
        number += 1
    return label, core


@pytest.mark.parametrize("block", [12, 512])
@pytest.mark.parametrize("eps", [0.05, 0.9, 1.4])
def test_dbscan_equals_brute_force(spark, eps, block, monkeypatch):
    monkeypatch.setattr(nn, "FEW_BLOCKS", 0)
    x = cloud(2)
    got = density.dbscan(make(spark, x), "id", "x", eps, 5, block).toPandas().set_index("id").sort_index()
    label, core = brute_dbscan(x, eps, 5)
    assert (got["Cluster"].to_numpy() == label).all()
    assert (got["is_core"].to_numpy() == core).all()


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize("eps", [0.3, 1.0])
def test_dbscan_crowded_ball(spark, eps, few, monkeypatch):
    monkeypatch.setattr(nn, "FEW_BLOCKS", few)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(420, 4))
    x[:300] = rng.normal(scale=0.01, size=(300, 4))  # most rows crowd together
    x[300:330] += 6
    df = make(spark, x[rng.permutation(420)])
    x = np.array([r["x"] for r in df.orderBy("id").collect()])
    got = density.dbscan(df, "id", "x", eps, 4, 8).toPandas().set_index("id").sort_index()
    label, core = brute_dbscan(x, eps, 4)
    assert (got["Cluster"].to_numpy() == label).all() and (got["is_core"].to_numpy() == core).all()
    found = nn.point_set(df, "id", "x", None, 8)
    pairs, flooded, sure = density._settle(found.blocks, eps, 4)
    blocks = found.blocks.meta.count()
    crowded = flooded.count()
    left = pairs.filter("NOT linked").join(flooded.select(F.col("block").alias("q")), "q", "left_semi").join(
        flooded.select(F.col("block").alias("c")), "c", "left_semi").count()
    assert crowded > 30 and left < crowded * crowded / 20 and blocks > crowded
    if few == 0:
        assert pairs.filter("NOT linked").count() < blocks * blocks / 2


def test_dbscan_keeps_wide_keys(spark):
    keys = [2**62 + i for i in range(12)]
    df = spark.createDataFrame([(k, [float(i // 6) * 10]) for i, k in enumerate(keys)], "id long, x array<double>")
    got = density.dbscan(df, "id", "x", 1.0, 3, 4).toPandas().sort_values("id")
    assert got["id"].tolist() == keys and got["Cluster"].tolist() == [0] * 6 + [1] * 6


def test_dbscan_long_chain(spark):
    x = np.c_[np.arange(150) * 0.5, np.zeros(150)]
    got = density.dbscan(make(spark, x), "id", "x", 0.5, 3, 10).toPandas()
    assert set(got["Cluster"]) == {0}


def test_dbscan_all_noise_and_one_ball(spark):
    assert set(density.dbscan(make(spark, np.arange(40.0)[:, None] * 10), "id", "x", 1.0, 3, 8).toPandas()["Cluster"]) == {-1}
    assert set(density.dbscan(make(spark, np.zeros((40, 3))), "id", "x", 1.0, 3, 8).toPandas()["Cluster"]) == {0}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19], "a long, b long")
    nodes = spark.range(61).withColumnRenamed("id", "node")
    got = {r["node"]: r["root"] for r in density.connected_components(edges, nodes).collect()}
    assert got == {i: i - i % 20 for i in range(61)}


def test_near_stored_cores(spark):
    x = cloud(6)
    label, core = brute_dbscan(x, 0.9, 5)
    cores = make(spark, x).filter(F.col("id").isin([int(i) for i in np.nonzero(core)[0]]))
    got = density.near_stored_cores(make(spark, x), cores, "id", "x", 0.9, 16).toPandas().set_index("id").sort_index()
    assert (got["is_anomaly"].to_numpy() == (label < 0)).all()


def test_stored_index_is_opened_not_built(spark, monkeypatch, tmp_path):
    x = clustered(20, 40, 8)
    cores, path = make(spark, x[::2]), str(tmp_path / "index")
    density.store_cores(cores, "id", "x", path, 16)

    def never(*args, **kwargs):
        raise AssertionError("built again")

    monkeypatch.setattr(nn, "build_blocks", never)
    monkeypatch.setattr(density, "point_set", never)
    monkeypatch.setattr(density, "ASKED", 7)
    rng = np.random.default_rng(8)
    y = np.concatenate([x, x[:50] + rng.normal(size=(50, 8)) * 0.3, np.full((40, 8), 50.0), np.repeat(x[:1], 30, axis=0)])
    asking = make(spark, y).unionByName(spark.createDataFrame([(10_000, None), (10_001, [float("nan")] * 8), (10_002, [None] * 8)], "id long, x array<double>"))
    for eps in (0.2, 0.6):
        want = dict(enumerate((np.sqrt(((y[:, None] - x[None, ::2]) ** 2).sum(axis=2)) > eps).all(axis=1)))
        got = density.score_against_stored(asking.repartition(5), path, "id", "x", eps).collect()
        assert {r["id"]: r["is_anomaly"] for r in got} == {**want, 10_000: True, 10_001: True, 10_002: True} and len(got) == len(y) + 3
    assert density.score_against_stored(asking.limit(0), path, "id", "x", 0.2).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        density.score_against_stored(make(spark, y[:, :5]), path, "id", "x", 0.2).collect()


def test_index_without_cores(spark, tmp_path):
    rows = make(spark, clustered(2, 5, 4))
    density.store_cores(rows.limit(0), "id", "x", str(tmp_path / "none"))
    assert {r["is_anomaly"] for r in density.score_against_stored(rows, str(tmp_path / "none"), "id", "x", 9.0).collect()} == {True}


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(density, "TASK_EDGES", 7)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19], "a long, b long").repartition(9)
    nodes = spark.range(61).withColumnRenamed("id", "node")
    got = {r["node"]: r["root"] for r in density.connected_components(edges, nodes).collect()}
    assert got == {i: i - i % 20 for i in range(61)}


def clustered(clusters=60, each=100, d=64, seed=1):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(clusters, d)) * 3, each, axis=0) + rng.normal(size=(clusters * each, d)) * 0.1


@pytest.mark.parametrize("few", [0, 10**6])
def test_separated_clusters_are_pruned(spark, few, monkeypatch):
    """In 64 dimensions, far more than there are axes, few block pairs stay."""
    monkeypatch.setattr(nn, "FEW_BLOCKS", few)
    x = clustered()
    blocks = nn.point_set(make(spark, x), "id", "x", 5, 32).blocks
    n = blocks.meta.count()
    sizes = blocks.meta.agg(F.min("points"), F.max("points")).first()
    assert sizes[0] >= 5 and sizes[1] <= 32
    assert nn.candidate_pairs(blocks).count() < 0.05 * n * n
    assert nn.candidate_pairs(blocks, 2.0).count() < 0.05 * n * n


def test_tree_sends_points_to_balanced_leaves():
    x = clustered()
    tree = nn.ball_tree(x, 188, 10)
    leaf = tree.leaf_of(x)
    counts = np.bincount(leaf)
    assert counts.sum() == len(x) and counts.min() >= 10
    # No leaf but a few holds rows of two clusters.
    mixed = sum(len(np.unique(np.flatnonzero(leaf == k) // 100)) > 1 for k in range(len(counts)))
    assert mixed <= len(counts) / 20


def test_tree_of_equal_points_is_one_leaf():
    tree = nn.ball_tree(np.zeros((50, 3)), 8, 2)
    assert set(tree.leaf_of(np.zeros((5, 3)))) == {0}


def test_payloads_travel_once_for_each_group(spark, monkeypatch):
    """With groups, a payload is sent far less often than it has pairs."""
    x = np.random.default_rng(3).normal(size=(1600, 3))
    blocks = nn.point_set(make(spark, x), "id", "x", None, 16).blocks
    pairs = nn.candidate_pairs(blocks, 1.5)
    sent = pairs.select(blocks.group(F.col("q")).alias("g"), "c").distinct().count()
    assert sent < pairs.count() / 3


def test_neighbours_of_a_group_leave_together(spark):
    """A query block gives up to k neighbours a point for all blocks that it meets
    in a group, and groups grow with the table."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(900, 4)).round(1)
    x[100:140] = x[:40]
    k, own = 5, np.arange(0, 100)
    d = nn.distances(x[own], x)
    limits = np.sort(nn.distances(x[own], x[own]), axis=1)[:, k - 1]
    pairs = pd.DataFrame([{
        "q": 1, "c": c, "q_ids": own.tolist(), "q_flat": x[own].ravel().tolist(), "q_limits": limits.tolist(),
        "c_ids": list(range(c * 100, c * 100 + 100)), "c_weights": [c + 1] * 100, "c_flat": x[c * 100:c * 100 + 100].ravel().tolist()} for c in range(9)])
    points, near, far, weights = nn._nearest_of(pairs, 4, k)
    assert len(points) == k * len(own)
    for i in own:
        want = np.lexsort((np.arange(900), d[i]))[:k]
        assert near[points == i].tolist() == want.tolist() and np.allclose(far[points == i], d[i][want])
    assert (weights == near // 100 + 1).all()
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(6000, 4)))], "id long, x array<double>")
    blocks = nn.point_set(rows, "id", "x", None, 16).blocks
    assert blocks.meta.select(blocks.group(F.col("block")).alias("g")).distinct().count() <= 12


def test_a_search_gives_back_k_rows_a_point(spark):
    """Whatever number of groups a point meets, nothing is left to be merged; far
    off, tiny and copied points come out as they are measured."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 3))
    x[:300] = x[:300] * 1e-4 + 1e6
    x[300:330] = x[300]
    x[330:340] *= 1e100
    k = 6
    found = nn.point_set(make(spark, x), "id", "x", k, 24)
    groups = found.blocks.meta.select(found.blocks.asking_group(F.col("block"))).distinct().count()
    with np.errstate(over="ignore"):
        got = nn.nearest_points(found.blocks, k).toPandas()
    assert groups > 5 and (got.groupby("point").size() == k).all() and got["point"].nunique() == 1471
    kept = np.r_[0:301, 340:1500]
    at = rng.choice(len(kept), 60, replace=False)
    d = nn.distances(x[kept][at], x[kept])
    for i, row in zip(kept[at], d):
        near = got[got["point"] == i].sort_values(["distance", "neighbour_point"])
        order = np.lexsort((kept, row))[:k]
        assert near["neighbour_point"].tolist() == kept[order].tolist() and (near["distance"].to_numpy() == row[order]).all()


def test_within_in_single_precision():
    rng = np.random.default_rng(9)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e6), (1e-30, 0.0), (1e100, 0.0), (1e20, 0.0)):
        a, b = (rng.normal(size=(n, 5)) * scale + shift for n in (70, 90))
        b[:20] = a[:20]
        d = nn.distances(a, b)
        for eps in (*np.quantile(d, [0.1, 0.5]), float(d[3, 40]), 0.0):
            assert (nn.within(a, b, eps) == (d <= eps)).all()


def test_sample_is_that_of_all_points(spark):
    """The driver gets few points more than it wants, and the same ones."""
    points = spark.range(5000).select(F.col("id").alias("point"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    got = nn._sample(points, 5000, 2, 100)
    want = [r["point"] for r in points.orderBy(F.xxhash64("point"), "point").limit(100).collect()]
    assert got[:, 0].astype(int).tolist() == want
    assert len(nn._sample(points.limit(50), 50, 2, 100)) == 50
    far = points.filter(F.xxhash64("point") > 0)  # no hash is small
    assert len(nn._sample(far, 5000, 2, 100)) == 100


def test_clusters_from_distances_of_the_curve(spark, few):
    """The elbow's distances tell the cores; nothing is counted twice."""
    rows = make(spark, cloud())
    want_eps, k = density.elbow_eps(rows, "id", "x", None, 0.5, 12)
    got, eps, min_samples = density.elbow_dbscan(rows, "id", "x", None, None, 0.5, 12)
    assert (eps, min_samples) == (want_eps, k)
    want = density.dbscan(rows, "id", "x", eps, k, 12)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("is_core").count() > 0
