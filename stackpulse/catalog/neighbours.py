"""Neighbour search and density clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, neighbours as nn
from ..operators.quantiles import pick_rank
from ..session import materialise, scratch_path
from .registry import CELLS_SQL, cells_table, query, r6

DIST = f"""{CELLS_SQL}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.c, b.c) AS d FROM cells a, cells b)"""
ELBOW = f"""{DIST}, k AS (SELECT greatest(5, CAST(floor(ln(count(*))) AS INTEGER)) AS k, count(*) AS n FROM cells),
kd AS (SELECT i, d AS kd FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d) , k WHERE r = k.k),
eps AS (SELECT kd AS eps FROM (SELECT kd, row_number() OVER (ORDER BY kd) - 1 AS r FROM kd), k WHERE r = CAST(floor(k.n * 0.2) AS BIGINT))"""


@query("c03_nearest_neighbours", f"""
WITH {DIST} SELECT vec_id, rank, neighbour, round(d, 5) AS distance FROM (SELECT i AS vec_id, j AS neighbour, d,
 CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INTEGER) AS rank FROM d) WHERE rank <= 5""")
def c03(spark, sf):
    return nn.nearest(cells_table(spark, sf), "vec_id", "cells", 5).withColumn("distance", F.round("distance", 5))


@query("c04_eps_range_join", f"WITH {DIST} SELECT i AS vec_id, count(*) AS neighbours FROM d WHERE d <= 1.2 GROUP BY 1")
def c04(spark, sf):
    return nn.within_eps_counts(cells_table(spark, sf), "vec_id", "cells", 1.2)


@query("e08_k_distance_pick", f"WITH {ELBOW} SELECT round(eps, 6) AS eps FROM eps")
def e08(spark, sf):
    rows = cells_table(spark, sf)
    # Pinned, because picking a rank reads it several times.
    curve = materialise(nn.kth_distances(rows, "vec_id", "cells", density.min_samples_for(rows.count())), "k_distances")
    eps = pick_rank(curve, "k_distance", 0.2)
    return spark.createDataFrame([(eps,)], "eps double").withColumn("eps", r6("eps"))


@query("i06_elbow_eps", f"WITH {ELBOW} SELECT round(eps, 6) AS eps, k AS min_samples FROM eps, k")
def i06(spark, sf):
    eps, k = density.elbow_eps(cells_table(spark, sf), "vec_id", "cells")
    return spark.createDataFrame([(eps, k)], "eps double, min_samples int").withColumn("eps", r6("eps"))


# Components of the core graph by repeated reachability.
DBSCAN = f"""WITH RECURSIVE {ELBOW},
near AS (SELECT i, j FROM d, eps WHERE d <= eps),
core AS (SELECT i FROM near, k GROUP BY i, k.k HAVING count(*) >= k.k),
edge AS (SELECT near.i, near.j FROM near JOIN core a ON near.i = a.i JOIN core b ON near.j = b.i),
reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, edge.j FROM reach JOIN edge ON reach.j = edge.i),
root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
num AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM root),
border AS (SELECT near.i, min(num.cluster) AS cluster FROM near JOIN num ON near.j = num.i WHERE near.i NOT IN (SELECT i FROM core) GROUP BY 1)
SELECT vec_id, CAST(coalesce(num.cluster, border.cluster, -1) AS INTEGER) AS "Cluster", num.i IS NOT NULL AS is_core
FROM cells LEFT JOIN num ON num.i = vec_id LEFT JOIN border ON border.i = vec_id"""


@query("i07_dbscan", DBSCAN)
def i07(spark, sf):
    return density.elbow_dbscan(cells_table(spark, sf), "vec_id", "cells")[0]


@query("i08_stored_cores", f"WITH {DIST} SELECT i AS vec_id, min(d) > 1.2 AS is_anomaly FROM d JOIN cells s ON s.vec_id = d.j AND s.label = 0 GROUP BY 1")
def i08_cores(spark, sf):
    """Every record against the stored index of core points, here those of one label."""
    rows, path = cells_table(spark, sf), scratch_path(spark, "core-index")
    density.store_cores(rows.filter("label = 0"), "vec_id", "cells", path)
    return density.score_against_stored(rows, path, "vec_id", "cells", 1.2)
