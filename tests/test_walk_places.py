"""Searches over a walk network by places equal those over its edges."""

import pytest
from pyspark.sql import functions as F

from waymill.operators import graph, parts, search


def _graphs(spark):
    """(nodes, edges made one by one, edges by places) of walk nodes that share places, and rides between some of them."""
    rows = [(10 * i + 3, float(i % 5 * 700), float(i % 3 * 650)) for i in range(40)] + [(901, 20_000.0, 0.0), (902, 50_000.0, -0.0), (903, 50_000.0, 0.0), (904, None, 0.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double")
    rides = spark.createDataFrame([(3, 5000, 7, 50, None), (5000, 333, 8, 1, None), (901, 83, 9, 40, [-1] * 12 + [4] * 12), (333, 901, 10, 2, None), (43, 5000, 11, 50, None)], "src long, dst long, edge long, weight_sec int, by_hour array<short>")
    one = graph.walks_within(nodes, 800.0).select(*rides.columns).unionByName(rides)
    walks, places = graph.walks_by_place(nodes, 800.0)
    return nodes.unionByName(places), one, rides.withColumn("hops", F.lit(1).cast("byte")).unionByName(walks)


def _shown(df):
    return sorted((r.origin, -1 if r.hour is None else r.hour, r.target, r.seconds, r.settled, *([[tuple(s) for s in r.path]] if "path" in df.columns else [])) for r in df.collect())


@pytest.mark.parametrize("way", ["broadcast", "read by tasks"])
def test_searches_by_places_equal_those_of_edges(spark, monkeypatch, way):
    places, one, by_places = _graphs(spark)
    asked = spark.createDataFrame([(3, 5, None), (13, 20, [3, 333, 901]), (901, 5, [83]), (901, 20, None), (902, None, None), (904, 1, None), (333, None, [43, 902])], "origin long, hour int, targets array<long>")
    want = _shown(search.one_to_many(one, asked, paths_too=True))
    if way != "broadcast":
        monkeypatch.setattr(search, "BROADCAST_EDGES", by_places.count() - 1)
        ready = search.loaded(by_places, places)
        assert ready.shared is None and ready.parts is None
    else:
        ready = search.loaded(by_places, places)
    assert _shown(search.one_to_many(ready, asked, paths_too=True)) == want
    assert len(want) > 80 and (902, -1, 903, 1, 2) in {w[:5] for w in want}


def test_parts_of_a_graph_by_places_give_the_same_times(spark):
    _, one, by_places = _graphs(spark)
    asked = spark.createDataFrame([(3, 5, [333, 83]), (902, None, None)], "origin long, hour int, targets array<long>")
    ready = search.loaded(by_places)
    found = parts.searched(parts.divided(ready.edges, None, 14), asked, True).withColumn("path", search.resolved(F.col("path"), F.col("origin")))
    want = search.one_to_many(one, asked, paths_too=True)
    short = lambda df: sorted((r.origin, r.target, r.seconds, r.settled, len(r.path), sum(s.node == r.target for s in r.path[-1:])) for r in df.collect())
    assert short(found) == short(want)
    ids = {r.edge: (r.src, r.dst) for r in one.collect()}
    for r in found.collect():
        at = r.origin
        for s in r.path:
            assert ids[s.edge] == (at, s.node)
            at = s.node


def test_edges_grow_with_places_and_not_with_their_nodes(spark):
    nodes = spark.createDataFrame([(i, float(i % 2 * 700), 0.0) for i in range(2000)], "id long, x double, y double")
    assert graph.walks_by_place(nodes, 800.0)[0].count() == 2 * 2000 + 4


def test_a_build_stores_walks_by_places_and_reads_the_same_edges(spark, tmp_path):
    """Ten nodes at each of 40 places: 159,600 walk edges of 1,600 pairs of places."""
    from waymill.operators import builds

    nodes = graph.walk_nodes(spark.createDataFrame([(i, float(i % 40), -0.0) for i in range(400)] + [(1000, 9e6, 0.0), (1001, None, 0.0)], "id long, x double, y double"))
    edges = graph.walks_within(nodes.select("id", "x", "y"), 800.0)
    bus = nodes.limit(0).select(F.col("id").alias("edge"), F.col("id").alias("src"), F.col("id").alias("dst"), "kind", "mode", "line", F.lit(1).alias("weight_sec"), F.lit(None).cast("array<short>").alias("by_hour"), F.lit(0.0).alias("distance_m"))
    places = graph.places_in_reach(nodes.select("id", "x", "y"), 800.0)
    builds.publish(spark, f"{tmp_path}/a", lambda: graph.Part(nodes, edges))
    builds.publish(spark, f"{tmp_path}/b", lambda: graph.Part(nodes, bus, places), check=lambda part: part.edges.columns == edges.columns or 1 / 0)
    one, two = (builds.ledger(spark, f"{tmp_path}/{n}").select("nodes", "edges", "counts").first() for n in "ab")
    assert one == two and one.edges == 400 * 399
    part = builds.active(spark, f"{tmp_path}/b")[1]
    assert sorted(map(tuple, part.edges.select("edge", "src", "dst", "weight_sec", "distance_m").collect())) == sorted(map(tuple, edges.select("edge", "src", "dst", "weight_sec", "distance_m").collect()))
    folder = builds.ledger(spark, f"{tmp_path}/b").first().folder
    assert sum(spark.read.parquet(f"{folder}/{t}").count() for t in ("edges", "places")) == 1601
