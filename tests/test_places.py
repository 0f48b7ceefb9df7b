"""Work that follows places and pieces: many rows at one place, and queries that read a part of the graph."""

import os

import pytest
from pyspark.sql import functions as F

from waymill.operators import graph, search, spatial

HERE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("any_distance", [False, True])
def test_rows_at_one_place_are_searched_once(spark, monkeypatch, any_distance):
    left = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3 * 10.0).alias("lx"), F.lit(0.0).alias("ly"))
    right = spark.range(400).select((F.col("id") + 7).alias("n"), (F.col("id") % 2 * 14.0).alias("rx"), F.lit(0.0).alias("ry"))
    met = []
    monkeypatch.setattr(spatial, "planar", lambda *c, f=spatial.planar: met.append(1) or f(*c))
    find = (lambda: spatial.nearest_any(left, right, "k", "n")) if any_distance else (lambda: spatial.nearest(left, right, 100.0, "k", "n"))
    out = find()
    assert {(r.k, r.n, r.distance) for r in out.collect()} == {(k, *((7, 0.0), (8, 4.0), (8, 6.0))[k % 3]) for k in range(300)}
    # The join of points with points has a row for each two places that meet, not for each two rows.
    joined = out._jdf.queryExecution().analyzed().toString()
    assert met and "Deduplicate" in joined or "Distinct" in joined


def test_walks_between_nodes_that_share_places(spark):
    rows = [(i, float(i % 4) * 500, 0.0) for i in range(40)]
    nodes = graph.walk_nodes(spark.createDataFrame(rows, "id long, x double, y double"))
    got = [(r.src, r.dst, r.weight_sec, r.distance_m) for r in graph.walks_within(nodes.select("id", "x", "y"), 800.0).collect()]
    at = {r.source_id: r.id for r in nodes.collect()}
    want = [(at[str(a)], at[str(b)], max(1, round(abs(x - z) / 1.2)), abs(x - z)) for a, x, _ in rows for b, z, _ in rows if a != b and abs(x - z) <= 800]
    assert sorted(got) == sorted(want)


def test_queries_of_edges_load_nothing_for_searches(spark, monkeypatch):
    if not os.path.isdir(HERE):
        pytest.skip("no test data")
    from waymill.plans import derived, graphs

    monkeypatch.setattr(derived, "_BUILDS", {})
    monkeypatch.setattr(search, "loaded", lambda *a: pytest.fail("searches are not asked for"))
    assert graphs.transfer_edges(spark, HERE).count() and graphs.access_edges(spark, HERE).count() == 2 and graphs.csr_head(spark, HERE).count()


def test_only_edges_with_hours_hold_them():
    import pyarrow as pa

    hours = [list(range(24)), None, [-1] * 24, None]
    t = pa.table({"src": [2, 1, 1, 3], "dst": [3, 2, 3, 1], "edge": [9, 8, 7, 6], "weight_sec": pa.array([50, 60, 70, 80], pa.int32()), "by_hour": pa.array(hours, pa.list_(pa.int16()))})
    g = search.Graph.of(t)
    assert g.hours.shape == (2, 24) and g.weights(5).tolist() == [-1, 60, 5, 80] and g.weights(None).tolist() == [70, 60, 50, 80]
