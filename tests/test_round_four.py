"""Work that follows places where many rows share them, and searches in graphs that tasks map from the shared folder."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from waymill.operators import graph, mapped, routes, search, spatial


def _join_rows(df):
    """Rows that the joins of a collected result made, the most of any join."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            plan.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            plan.append(node.plan())
            continue
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return most


def test_rows_in_reach_are_summed_by_places(spark):
    """A thousand rows at each of three places on both sides: nine pairs of places and three million pairs of rows."""
    left = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3 * 100).cast("double").alias("lx"), F.lit(0.0).alias("ly"))
    right = left.select(F.col("lx").alias("rx"), F.col("ly").alias("ry")).union(spark.createDataFrame([(9e5, 0.0), (None, 0.0)], "rx double, ry double"))
    left = left.union(spark.createDataFrame([(9000, 5e5, 0.0), (9001, None, 0.0)], "k long, lx double, ly double"))
    out = spatial.sums_within(left, right, 150.0, "k")
    assert _join_rows(out) <= 3002
    got = {r.k: (r.n, r.mean) for r in out.collect()}
    assert got == {k: (2000, 50.0) if k % 3 != 1 else (3000, 200 / 3) for k in range(3000)}


def test_walk_speed_equals_that_of_the_edges(spark):
    rows = [(i, float(i % 7 * 130), float(i % 3 * 177)) for i in range(90)] + [(900, 90_000.0, 0.0), (901, 50_000.0, 0.0), (902, 50_000.0, -0.0), (903, None, 0.0), (5, 5 * 130.0, 2 * 177.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double")
    rides = spark.createDataFrame([(1, 900, 5, None), (900, 1, 7, [-1] * 24)], "src long, dst long, weight_sec int, by_hour array<short>")
    made = graph.walks_within(nodes, 500.0).select(*rides.columns)
    want = graph.max_speed(nodes, rides.unionByName(made), 8).first()
    got = graph.max_speed(nodes, rides, 8, graph.walk_speed(nodes, 500.0)).first()
    assert got == want and got.n > 1000 and graph.walk_speed(nodes, 500.0).first().speed == graph.max_speed(nodes, made, 8).first().speed
    assert graph.walk_speed(nodes.where("id = 900"), 500.0).first() == (None, 0)


def test_walk_speed_makes_no_edges(spark):
    """A thousand nodes at one place have 999,000 edges."""
    nodes = spark.range(1000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    out = graph.walk_speed(nodes, 500.0)
    assert out.first().n == 999_000 and _join_rows(out) <= 9


def _small(spark):
    """A random graph of rides in hours and walks by places, and requests."""
    rng = random.Random(11)
    rows = [(10 * i + 3, float(i % 5 * 700), float(i % 3 * 650)) for i in range(40)] + [(901, 20_000.0, 0.0)]
    nodes = spark.createDataFrame(rows, "id long, x double, y double")
    hours = lambda: [rng.choice([-1, rng.randrange(1, 900), 30_000]) for _ in range(24)]
    ids = [r[0] for r in rows] + list(range(5000, 5060))
    rides = [(rng.choice(ids), rng.choice(ids), 100 + i, rng.choice([rng.randrange(1, 400), 40_000]) if i % 7 == 1 else rng.randrange(1, 400), None if i % 3 else hours()) for i in range(250)]
    rides = spark.createDataFrame(rides + [(901, 902, 9, 3, [-1] * 24)], "src long, dst long, edge long, weight_sec int, by_hour array<short>")
    walks, places = graph.walks_by_place(nodes, 800.0)
    asked = [(3, 5, None), (5001, 20, [3, 333, 5044]), (13, 20, [3, 901, 77]), (901, 5, [3]), (5002, None, None), (99_999, 1, None), (333, None, [43, 333])]
    return rides.withColumn("hops", F.lit(1).cast("byte")).unionByName(walks), spark.createDataFrame(asked, "origin long, hour int, targets array<long>")


def _shown(df):
    return sorted((r.origin, -1 if r.hour is None else r.hour, r.target, r.seconds, r.settled, *([[tuple(s) for s in r.path]] if "path" in df.columns else [])) for r in df.collect())


@pytest.mark.parametrize("segment,at_once", [(1 << 18, 1 << 21), (7, 3)])
def test_searches_in_mapped_arrays_equal_the_kernels(spark, monkeypatch, segment, at_once):
    edges, asked = _small(spark)
    want, plain = (_shown(search.one_to_many(edges, asked, paths_too=p)) for p in (True, False))
    sums = {(r.origin, r.hour): (r.reached, r.total, r.most) for r in search.reach(edges, asked).collect()}
    monkeypatch.setattr(search, "BROADCAST_EDGES", edges.count() - 1)
    ready = search.loaded(edges)
    assert ready.shared is None and ready.parts is None and ready.size == edges.count()
    if segment == 1 << 18:
        assert _shown(search.one_to_many(ready, asked, paths_too=True)) == want and _shown(search.one_to_many(ready, asked)) == plain
        assert {(r.origin, r.hour): (r.reached, r.total, r.most) for r in search.reach(ready, asked).collect()} == sums
        every = search.one_to_many(edges, asked.select("origin", "hour")).groupBy("origin", "hour").agg(F.count("*"), F.sum("seconds"), F.max("seconds"))
        assert sums == {(r[0], r[1]): tuple(r)[2:] for r in every.collect()} and len(sums) == 6
        return
    # As tasks do it, in this process, which the bounds are set for.
    monkeypatch.setattr(mapped, "SEGMENT", segment)
    monkeypatch.setattr(mapped, "AT_ONCE", at_once)
    folder, hours = str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).removeprefix("file:") + "/mapped-test", (-1, 5, 20)
    os.makedirs(folder + "/arrays")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes.write.parquet(folder + "/nodes")
    rows = edges.selectExpr("src", "dst", "edge", "hops", "weight_sec AS w0", "int(coalesce(by_hour[5], weight_sec)) AS w1", "int(coalesce(by_hour[20], weight_sec)) AS w2").toArrow()
    for back in (False, True):
        turned = rows.rename_columns(["far", "near", "edge", "hops", "w0", "w1", "w2"] if back else ["near", "far", "edge", "hops", "w0", "w1", "w2"])
        made = pa.Table.from_batches(mapped._numbered(folder, hours)(iter(turned.to_batches())))
        names = {}
        for part in set(made.column("part").to_pylist()):
            r = mapped._arrays(folder, hours, back)(made.filter(pc.field("part") == part)).to_pylist()[0]
            names[part] = r["name"]
        count = -(-nodes.count() // segment)
        mapped._listed(folder, "back" if back else "out", [names.get(i) for i in range(count)])
    assert count > 5
    at = mapped.Mapped(folder, nodes.count(), nodes.where("id < 0").count(), hours, (50, 50, 50), len(rows))
    held = [tuple(x) for x in mapped._searches(at, iter(search.written(asked.where("hour IS NULL OR hour IN (5, 20)"), "asked").toArrow().to_batches()))]
    got = []
    for h, hour, row, origin, wanted, key in held:
        to = [i for i in (range(at.places, at.nodes) if wanted is None else wanted[wanted >= 0].tolist()) if key[i] != search.NO_LABEL]
        steps = mapped.paths(h, at.places, hour, key, origin, np.array(to, np.int64)).to_pylist()
        got += [(row["origin"], -1 if row["hour"] is None else row["hour"], int(h.ids[t]), int(key[t] >> search.HOP_BITS), [s["node"] for s in p]) for t, p in zip(to, steps)]
    assert sorted(got) == [(*w[:4], [s[1] for s in w[5]]) for w in want]


def test_no_label_is_written_where_sums_are_asked_for(spark, monkeypatch):
    edges, asked = _small(spark)
    ready = search.loaded(edges)
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(at))
    search.reach(ready, asked).collect()
    assert {n.split("-")[0] for n in set(os.listdir(at)) - before} == {"search"}


def test_steps_make_the_walk_edges_on_paths_alone(spark):
    """300 nodes at three places have 89,700 walk edges; two paths walk three of them."""
    nodes = graph.walk_nodes(spark.range(300).select("id", (F.col("id") % 3 * 700).cast("double").alias("x"), F.lit(0.0).alias("y")))
    at = nodes.select("id", "x", "y")
    every = graph.walks_within(at, 800.0)
    ids = {int(r.source_id): r.id for r in nodes.collect()}
    asked = spark.createDataFrame([(ids[0], 8, [ids[5], ids[1]])], "origin long, hour int, targets array<long>")
    walks, places = graph.walks_by_place(at, 800.0)
    found = search.written(search.one_to_many(walks, asked, paths_too=True), "found")
    out = graph.walks_on(found, at)
    on = {s.edge for r in found.collect() for s in r.path}
    assert {r.edge for r in out.collect()} == on and 2 <= len(on) <= 3 and _join_rows(out) <= 9
    key = lambda df: sorted(map(str, df.collect()))
    assert key(routes.steps(found, out, nodes)) == key(routes.steps(found, every, nodes)) and key(out) == key(every.where(F.col("edge").isin(*on)))
