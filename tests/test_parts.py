"""Searches in the parts of a graph: by tasks with origins of their own, and in rounds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from waymill.operators import parts, search
from waymill.scratch import shared_dir, written


@pytest.fixture(scope="module")
def graph_(spark):
    rng = random.Random(5)
    hours = lambda: [rng.choice([-1, rng.randrange(1, 900)]) for _ in range(24)]
    rows = [(i, j, rng.randrange(1, 60), None) for i in range(120) for j in (i - 1, i + 1) if 0 <= j < 120] + [(rng.randrange(120), rng.randrange(120), 400, hours()) for _ in range(60)]
    ready = search.loaded(spark.createDataFrame(rows + [(200, 201, 1, None)], "src long, dst long, weight_sec int, by_hour array<short>"))
    asked = written(spark.createDataFrame([(o, h, t) for o in (0, 60, 119, 200, 201) for h in (None, 8) for t in ([0, 40, 201],)] + [(7, 9, None)], "origin long, hour int, targets array<long>"), "asked")
    return ready, parts.divided(ready.edges, None, 20), asked


def _shown(df):
    return sorted((r.origin, -1 if r.hour is None else r.hour, r.target, r.seconds, r.settled, [tuple(s) for s in r.path]) for r in df.collect())


@pytest.mark.parametrize("held,states,band", [(parts.HELD_EDGES, parts.HELD_STATES, parts.BAND), (parts.HELD_EDGES, 1, 1), (40, 1000, 50)])
def test_tasks_and_rounds_give_the_kernels_rows(spark, graph_, monkeypatch, held, states, band):
    ready, divided, asked = graph_
    want = _shown(search.one_to_many(ready, asked, paths_too=True))
    assert divided.count > 3 and _shown(parts.searched(divided, asked, True)) == want
    sums = {(r.origin, r.hour): (r.reached, r.total) for r in parts.reach(divided, asked).collect()}
    for name, value in (("HELD_EDGES", held), ("HELD_STATES", states), ("BAND", band), ("_HELD", {})):
        monkeypatch.setattr(parts, name, value)
    # As a task does it, in this process, which the bounds are set for.
    batches = parts._homes(divided, asked).toArrow().to_batches()
    here = [r for b in parts._reach(divided.folder, divided.nodes)(iter(batches)) for r in b.to_pylist()]
    assert {(r["origin"], None if r["hour"] < 0 else r["hour"]): (r["reached"], r["total"]) for r in here} == sums
    every = search.one_to_many(ready, asked.select("origin", "hour")).groupBy("origin", "hour").agg(F.count("*").alias("n"), F.sum("seconds").alias("s"))
    assert sums == {(r.origin, r.hour): (r.n, r.s) for r in every.collect()}
    monkeypatch.setattr(parts, "HELD_EDGES", 1)
    assert _shown(parts.searched(divided, asked, True)) == want


def test_sums_and_divisions_leave_no_tables_of_labels_or_clusters(spark, graph_):
    ready, divided, asked = graph_
    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    parts.reach(divided, asked).collect()
    assert set(os.listdir(at)) == before
    again = parts.divided(ready.edges, None, 20)
    assert {n.split("-")[0] for n in set(os.listdir(at)) - before} == {"parts"} and sorted(again.owners.collect()) == sorted(divided.owners.collect())


def test_parts_grow_where_there_would_be_too_many(graph_):
    ready, divided, _ = graph_
    fewer = parts.divided(ready.edges, None, 20, most=2)
    assert fewer.count <= 2 < divided.count and fewer.nodes == divided.nodes == 122
