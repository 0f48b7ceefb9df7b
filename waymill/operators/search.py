"""Shortest paths of many origins: one vectorised search over a broadcast graph, over a mapped one, or searches in its parts beyond its size.

Graphs beyond a broadcast are arrays in the shared folder that tasks map (``mapped``), much larger ones are divided into parts that exchange labels at their borders (``parts``); rounds of joins
alone (``relaxed_many``) need no arrays at all, but a round for each edge of the longest path. All ways give the same rows. A state is (origin, hour, node), and its label one number: seconds above HOP_BITS bits
that count edges. The least label is the fastest way and of those the one with the fewest edges; of edges that reach a
node with its least label the one from the smallest node counts, and of those the smallest edge id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.functions.scalars import number_of
from waymill.scratch import cut, written

#: Edges of a graph that is broadcast, some 28 bytes each, and numbers of their hours, two bytes each: 170 and 96 MB at most.
BROADCAST_EDGES, BROADCAST_HOURS = 6_000_000, 48_000_000
#: Up to how many times that tasks map arrays in the shared folder (``mapped``), some eight bytes an edge and hour.
READ_TIMES = 16
#: The id of walk edges between places (``graph.walks_by_place``), which paths replace by those of the edges between nodes.
WALKED = -1
#: Labels that a task holds at once: as many as stay in a core's cache.
STATES = 500_000
HOP_BITS = 20
NO_LABEL = np.iinfo(np.int64).max
NO_SERVICE = -1
STEP = pa.struct([("edge", pa.int64()), ("node", pa.int64()), ("seconds", pa.int64())])
NAMES = ["origin", "hour", "target", "seconds", "settled", "path"]
SUMS = ["origin", "hour", "reached", "total", "most"]
PATH = "array<struct<edge:bigint,node:bigint,seconds:bigint>>"


@dataclass(frozen=True)
class Graph:
    """Edges sorted by source and id: head[i]..head[i + 1] are those of node i; back lists edges by target likewise."""

    ids: np.ndarray
    head: np.ndarray
    to: np.ndarray
    edge: np.ndarray
    base: np.ndarray
    hours: np.ndarray | None  # (edges with hours, 24)
    hourly: np.ndarray | None  # the places of those edges
    source: np.ndarray
    back_head: np.ndarray
    back: np.ndarray
    hops: np.ndarray | None = None  # what each edge counts, one where there are none
    places: int = 0  # the first nodes, of negative ids, stand for places

    @classmethod
    def of(cls, table: pa.Table) -> Graph:
        """The graph of a table of src, dst, edge, weight_sec and perhaps by_hour and hops."""
        src, dst, edge, weight = (table.column(c).to_numpy() for c in ("src", "dst", "edge", "weight_sec"))
        ids = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        order = np.lexsort((edge, a))
        hours = hourly = None
        if "by_hour" in table.column_names:
            lists = table.column("by_hour").combine_chunks()
            there = np.asarray(lists.is_valid())
            hourly = np.flatnonzero(there[order]).astype(np.int32)
            hours = lists.drop_null().flatten().to_numpy().reshape(-1, 24)
            row = np.cumsum(there) - 1
            hours = hours[row[order[hourly]]]
            hours = hours.astype(np.int16 if not hours.size or hours.max() < 32_000 else np.int32)
        hops = table.column("hops").to_numpy()[order].astype(np.int8) if "hops" in table.column_names else None
        a, b, weight, edge = a[order], b[order], weight[order], edge[order]
        back = np.argsort(b, kind="stable").astype(np.int32)
        places = np.arange(len(ids) + 1)
        return cls(ids, np.searchsorted(a, places), b.astype(np.int32), edge, weight.astype(np.int32), hours, hourly, a.astype(np.int32), np.searchsorted(b[back], places), back, hops, 0 if hops is None else int(np.searchsorted(ids, 0)))

    def weights(self, hour: int | None) -> np.ndarray:
        """The weights of all edges in an hour; those without hours have their base weight."""
        if hour is None or self.hours is None:
            return self.base
        out = self.base.copy()
        out[self.hourly] = self.hours[:, hour]
        return out

    def added(self, weight: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
        """What edges add to a label by weights of all edges: seconds above the bits that count edges."""
        some = weight if edges is None else weight[edges]
        hops = 1 if self.hops is None else self.hops if edges is None else self.hops[edges]
        return (np.maximum(some, 0).astype(np.int64) << HOP_BITS) + hops

    def index(self, nodes) -> np.ndarray:
        """Places of node ids, -1 for those that no edge touches."""
        nodes = np.asarray(nodes, np.int64)
        if not len(self.ids):
            return np.full(len(nodes), -1)
        at = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[at] == nodes, at, -1)


def _fan(head: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of nodes the numbers from head[node] to head[node + 1], and which entry they belong to."""
    size = head[nodes + 1] - head[nodes]
    which = np.repeat(np.arange(len(nodes)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + head[nodes][which], which


def labels(g: Graph, weight: np.ndarray, sources: np.ndarray, targets: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(labels of each source's nodes, seconds up to which they are final) for places of sources and targets.

    Labels settle in bands of seconds, all sources at once; a band is relaxed until nothing in it changes. A
    source whose targets are all settled is done.
    """
    n, k = len(g.ids), len(sources)
    key = np.full(k * n, NO_LABEL)
    at = np.arange(k) * n + sources
    key[at] = 0
    limit = np.full(k, NO_LABEL >> HOP_BITS)

    def unfinished(wait: np.ndarray, high: int) -> np.ndarray:
        for i, wanted in enumerate(targets or []):
            if limit[i] == NO_LABEL >> HOP_BITS:
                far = key[i * n + wanted] >> HOP_BITS if len(wanted) else np.zeros(1, np.int64)
                if far.max() < high:
                    limit[i] = far.max()
        return wait[limit[wait // n] == NO_LABEL >> HOP_BITS]

    settle(g, weight, key, at, unfinished if targets is not None else None)
    return key.reshape(k, n), limit


def distinct(states: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """States once each and in order; ``mark``, false for each state there is, spares sorting many."""
    if len(states) * 64 < len(mark):
        return np.unique(states).astype(np.int64)
    mark[states] = True
    out = np.flatnonzero(mark)
    mark[out] = False
    return out


def settle(g: Graph, weight: np.ndarray, key: np.ndarray, wait: np.ndarray, unfinished: Callable[[np.ndarray, int], np.ndarray] | None = None) -> None:
    """Spreads the labels ``key`` of the states ``wait`` (source times nodes plus node) over the graph, in place.

    After each band of seconds ``unfinished`` may leave out states of sources that are done.
    """
    n = len(g.ids)
    open_ = weight >= 0
    band = max(1, int(weight[open_].mean() * 2)) if open_.any() else 1
    high, mark = band, np.zeros(len(key), bool)
    while len(wait):
        label = key[wait] >> HOP_BITS
        high = max(high, int(label.min()) + band)
        now = distinct(wait[label < high], mark)
        later = [wait[label >= high]]
        while len(now):
            edges, which = _fan(g.head, now % n)
            new = key[now][which] + g.added(weight, edges)
            to = g.to[edges] if n == len(key) else (now - now % n)[which] + g.to[edges]
            better = np.flatnonzero((new < key[to]) & (weight[edges] >= 0))
            to = to[better]
            np.minimum.at(key, to, new[better])
            to = distinct(to, mark)
            near = key[to] >> HOP_BITS < high
            now = to[near]
            later.append(to[~near])
        wait = distinct(np.concatenate(later), mark)
        # Labels under ``high`` are final; entries that a later, smaller label overtook are done.
        wait = wait[key[wait] >> HOP_BITS >= high]
        if unfinished is not None:
            wait = unfinished(wait, high)
        high += band


def paths(g: Graph, weight: np.ndarray, key: np.ndarray, origin: int, wanted: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each wanted node (edge id, node id, seconds so far) of its path's edges in order, by the labels of one source.

    Where a way leads through places, the step is the one between nodes, and the smallest node before counts as everywhere.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in wanted]
    now, who = wanted.copy(), np.arange(len(wanted))
    while len(now):
        moving = now != origin
        now, who = now[moving], who[moving]
        if not len(now):
            break
        edge, source = _before(g, weight, key, now)
        for i, e, v in zip(who.tolist(), edge.tolist(), now.tolist()):
            out[i].append((e, int(g.ids[v]), int(key[v] >> HOP_BITS)))
        now = source.astype(now.dtype)
    return [steps[::-1] for steps in out]


def _before(g: Graph, weight: np.ndarray, key: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge id, node) that each node has its label from: the smallest node, then the smallest id. Places are looked through."""
    at, who, through = now, np.arange(len(now)), False
    found: list[tuple[np.ndarray, ...]] = []
    while len(at):
        slots, which = _fan(g.back_head, at)
        edges = g.back[slots]
        before = key[g.source[edges]]
        tight = (weight[edges] >= 0) & (before != NO_LABEL)
        tight &= np.where(tight, before, 0) + g.added(weight, edges) == key[at][which]
        edges, which = edges[tight], who[which[tight]]
        source = g.source[edges]
        real = source >= g.places
        found.append((which[real], source[real], np.full(int(real.sum()), WALKED) if through else g.edge[edges[real]]))
        at, who, through = source[~real], which[~real], True
    which, source, edge = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((edge, source, which))
    _, first = np.unique(which[order], return_index=True)
    return edge[order][first], source[order][first]


def resolved(path: Column, origin: Column) -> Column:
    """A path without its steps at places, its walk edges with the ids of the edges between nodes (``graph.walk_edges``)."""
    steps = F.filter(path, lambda s: s["node"] >= 0)

    def named(s: Column, i: Column) -> Column:
        before = F.get(steps, i - 1)
        text = [F.coalesce(before["node"], origin).cast("string"), s["node"].cast("string"), F.lit("WALK"), F.lit(""), (s["seconds"] - F.coalesce(before["seconds"], F.lit(0))).cast("string")]
        return F.struct(F.when(s["edge"] == WALKED, number_of(*text)).otherwise(s["edge"]).alias("edge"), s["node"].alias("node"), s["seconds"].alias("seconds"))

    return F.transform(steps, named).cast(PATH)


def numbered(edges: DataFrame) -> DataFrame:
    """Edges with an id ``edge``: theirs, or one of what they are."""
    if "edge" in edges.columns:
        return edges
    return edges.withColumn("edge", number_of(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src", "dst", "kind", "line", "weight_sec") if c in edges.columns]))


@dataclass(frozen=True)
class Loaded:
    """A graph ready for any number of searches: its edges, and the broadcast kernel graph or, if it is much too large, its
    parts. With neither, tasks map the graph in the hours of a search. ``size`` is the number of edges."""

    edges: DataFrame
    shared: Broadcast | None
    parts: Any = None
    size: int = 0


def loaded(edges: DataFrame, places: DataFrame | None = None) -> Loaded:
    """Edges with the columns that searches read, written once and broadcast if they are few enough; up to ``READ_TIMES`` as many stay where
    they are until tasks map them for a search; more are written and divided into parts, by the places (id, x, y) of nodes where they are given."""
    from waymill.operators import parts

    e = numbered(edges)
    columns = ["src", "dst", "edge", "weight_sec"] + [c for c in ("by_hour", "hops") if c in e.columns]
    e = e.select(*columns)
    timed = F.count("by_hour") if "by_hour" in e.columns else F.lit(0)
    size = e.agg(F.count("*").alias("n"), (timed * 24).alias("hours")).first()
    small = size.n <= BROADCAST_EDGES and size.hours <= BROADCAST_HOURS
    if not small and size.n <= READ_TIMES * BROADCAST_EDGES:
        return Loaded(e, None, None, size.n)
    e = written(e, "search-edges")
    if not small:
        return Loaded(e, None, parts.divided(e, places), size.n)
    return Loaded(e, e.sparkSession.sparkContext.broadcast(Graph.of(e.toArrow())), None, size.n)


def one_to_many(edges: DataFrame | Loaded, origins: DataFrame, targets: list[int] | None = None, paths_too: bool = False) -> DataFrame:
    """(origin, hour, target, seconds, settled[, path]) of origins (origin, hour[, targets]); unreachable targets have no row.

    Targets are those of the origin's row, else ``targets``, else all nodes that can be reached. ``path`` lists
    (edge, node, seconds so far) from the first edge to the target. ``settled`` counts the nodes no further than the
    furthest target, all that are reached where a target isn't. Edges are (src, dst, weight_sec[, by_hour][, edge]); a null
    hour takes base weights; an origin that no edge touches has no row. Rows that repeat are searched once.
    """
    from waymill.operators import mapped, parts

    at = edges if isinstance(edges, Loaded) else loaded(edges)
    wanted = F.col("targets") if "targets" in origins.columns else F.lit(None if targets is None else [int(t) for t in targets]).cast("array<long>")
    asked = origins.select(F.col("origin").cast("long"), F.col("hour").cast("int"), wanted.alias("targets"))
    every = F.max(F.col("targets").isNull())
    asked = asked.groupBy("origin", "hour").agg(F.when(~every, F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets"))))).alias("targets"))
    asked = written(asked.where("origin IS NOT NULL"), "search-origins")
    if at.parts is not None:
        out = parts.searched(at.parts, asked, paths_too)
    elif at.shared is not None:
        out = kernel(at.shared, asked, paths_too)
    else:
        out = mapped.searched(mapped.mapped(at.edges, _hours(asked), paths_too), asked, paths_too)
    if paths_too and "hops" in at.edges.columns:
        out = out.withColumn("path", resolved(F.col("path"), F.col("origin")))
    return out


def _hours(asked: DataFrame) -> list[int | None]:
    """The hours that are asked for, of which there are 25 at most."""
    return [r.hour for r in asked.select("hour").distinct().collect()]


def reach(edges: DataFrame | Loaded, asked: DataFrame) -> DataFrame:
    """(origin, hour, reached, total, most) of origins (origin, hour): how many nodes each reaches, their seconds in all and the most.
    Only these sums leave a task, whatever the number of labels."""
    from waymill.operators import mapped, parts

    at = edges if isinstance(edges, Loaded) else loaded(edges)
    asked = asked.where("origin IS NOT NULL").select(F.col("origin").cast("long"), F.col("hour").cast("int")).distinct().withColumn("targets", F.lit(None).cast("array<long>"))
    asked = written(asked, "search-origins")
    if at.parts is not None:
        return parts.reach(at.parts, asked)
    if at.shared is None:
        return mapped.reach(mapped.mapped(at.edges, _hours(asked), False), asked)
    return kernel(at.shared, asked, False, sums=True)


def kernel(shared: Broadcast, asked: DataFrame, paths_too: bool, sums: bool = False) -> DataFrame:
    """one_to_many, or with ``sums`` reach, by the broadcast graph: tasks search the origins of an hour together."""
    context = asked.sparkSession.sparkContext
    schema = "origin long, hour int, target long, seconds long, settled long" + f", path {PATH}" * paths_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        n = max(1, len(g.ids))
        for arrow in batches:
            batch = arrow.to_pandas()
            hours = batch.hour.astype("Float64").fillna(-1).astype(int)
            for hour, some in batch.groupby(hours):
                weight = g.weights(None if hour < 0 else int(hour))
                some = some[g.index(some.origin.to_numpy()) >= 0]
                for i in range(0, len(some), max(1, STATES // n)):
                    yield from (summed if sums else found)(g, weight, None if hour < 0 else int(hour), some.iloc[i : i + max(1, STATES // n)])

    def summed(g: Graph, weight: np.ndarray, hour: int | None, some: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        key, _ = labels(g, weight, g.index(some.origin.to_numpy()), None)
        there = key[:, g.places :] != NO_LABEL
        seconds = np.where(there, key[:, g.places :] >> HOP_BITS, 0)
        hours = pa.nulls(len(some), pa.int32()) if hour is None else pa.array(np.full(len(some), hour, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(some.origin.to_numpy()), hours, pa.array(there.sum(1)), pa.array(seconds.sum(1)), pa.array(seconds.max(1, initial=0))], SUMS)

    def found(g: Graph, weight: np.ndarray, hour: int | None, some: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        sources = g.index(some.origin.to_numpy())
        given = [None if t is None else g.index(t) for t in some.targets]
        # A target that isn't in the graph is never reached, so that all that can be is settled.
        to_all = any(t is None or (t < 0).any() for t in given)
        key, limit = labels(g, weight, sources, None if to_all else given)
        for i, (origin, source, wanted) in enumerate(zip(some.origin, sources, given)):
            mine = key[i]
            reached = mine != NO_LABEL
            reached[: g.places] = False
            at = np.flatnonzero(reached) if wanted is None else wanted[wanted >= 0]
            at = at[reached[at]]
            whole = wanted is None or len(at) < len(wanted)
            last = (mine[reached] >> HOP_BITS).max() if whole else (mine[at] >> HOP_BITS).max() if len(at) else 0
            k = len(at)
            hours = pa.nulls(k, pa.int32()) if hour is None else pa.array(np.full(k, hour, np.int32))
            settled = int((mine[reached] >> HOP_BITS <= last).sum())
            columns = [pa.array(np.full(k, origin, np.int64)), hours, pa.array(g.ids[at], pa.int64()), pa.array(mine[at] >> HOP_BITS, pa.int64()), pa.array(np.full(k, settled, np.int64))]
            if paths_too:
                columns.append(pa.array([[dict(zip(("edge", "node", "seconds"), step)) for step in p] for p in paths(g, weight, mine, int(source), at)], pa.list_(STEP)))
            yield pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])

    if sums:
        # Each origin's search is as long as any other's, whatever its hour.
        tasks = max(1, min(asked.count(), context.defaultParallelism * 8))
        return asked.repartition(tasks, "origin", "hour").mapInArrow(run, "origin long, hour int, reached long, total long, most long")
    tasks = max(1, min(asked.count(), context.defaultParallelism * 2))
    return asked.repartition(tasks, "hour", F.pmod(F.xxhash64("origin"), F.lit(max(1, tasks // 4)))).mapInArrow(run, schema)


def _state(*more: str) -> list[str]:
    return ["origin", "hour", *more]


def hour_weight(edges: DataFrame) -> Column:
    """The weight of edges in the hour of a column ``hour``; a null hour takes the base weight."""
    base = F.col("weight_sec")
    return base if "by_hour" not in edges.columns else F.when(F.col("hour").isNull(), base).otherwise(F.coalesce(F.get("by_hour", F.col("hour")), base))


def hourly(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(hour, src, dst, edge, w) of the edges open in the hours asked for, of which there are 25 at most."""
    hours = asked.select("hour").distinct()
    w = hour_weight(edges)
    return edges.join(F.broadcast(hours)).select(F.coalesce("hour", F.lit(-1)).alias("hour"), "src", "dst", "edge", w.cast("long").alias("w")).where("w >= 0")


def relaxed(open_edges: DataFrame, asked: DataFrame, max_rounds: int = 5000) -> DataFrame:
    """(origin, hour, node, key) by rounds over (hour, src, dst, edge, w): nodes with smaller labels send to their neighbours.

    A round is one join and one aggregate that combines before the shuffle, for all origins and hours, and is
    checkpointed. Labels beyond an origin's furthest target, once all its targets have one, aren't sent on.
    """
    wanted = asked.where("targets IS NOT NULL").select(*_state(F.explode("targets").alias("node")))
    sizes = asked.where("targets IS NOT NULL").select("origin", "hour", F.size("targets").alias("n"))
    bounded = not sizes.isEmpty()
    known = cut(asked.select("origin", "hour", F.col("origin").alias("node"), F.lit(0).cast("long").alias("key")).join(open_edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi").select(*_state("node", "key")))
    front = known
    for _ in range(max_rounds):
        if bounded:
            limits = known.join(wanted, _state("node")).groupBy("origin", "hour").agg(F.max("key").alias("far"), F.count("*").alias("m")).join(sizes, _state()).where("m = n").select(*_state("far"))
            front = front.join(limits, _state(), "left").where("far IS NULL OR key <= far").drop("far")
        e = open_edges.withColumnRenamed("src", "node")
        sent = front.join(e, ["hour", "node"]).groupBy("origin", "hour", F.col("dst").alias("node")).agg(F.min(F.col("key") + F.shiftleft("w", HOP_BITS) + 1).alias("new"))
        both = known.join(sent, _state("node"), "full_outer")
        nearer = F.col("new").isNotNull() & (F.col("key").isNull() | (F.col("new") < F.col("key")))
        both = cut(both.select(*_state("node"), F.least("key", "new").alias("key"), nearer.alias("nearer")))
        known, front = both.drop("nearer"), both.where("nearer").drop("nearer")
        if front.isEmpty():
            return known
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def walked(open_edges: DataFrame, known: DataFrame, ends: DataFrame) -> DataFrame:
    """(origin, hour, target, path) of ends (origin, hour, node, key), walked back an edge of every path a round."""
    now = cut(ends.select("origin", "hour", F.col("node").alias("target"), "node", "key"))
    steps = None
    e = open_edges.withColumnRenamed("dst", "node")
    labelled = known.select("origin", "hour", F.col("node").alias("src"), F.col("key").alias("before"))
    while not (now := now.where("node <> origin")).isEmpty():
        back = now.join(e, ["hour", "node"]).join(labelled, _state("src")).where(F.col("before") + F.shiftleft("w", HOP_BITS) + 1 == F.col("key"))
        best = back.groupBy("origin", "hour", "target", "node", "key").agg(F.min(F.struct("src", "edge", "before")).alias("b"))
        best = written(best, "search-steps")
        step = best.select("origin", "hour", "target", F.struct("key", F.struct(F.col("b.edge").alias("edge"), "node", F.shiftright("key", HOP_BITS).alias("seconds")).alias("s")).alias("k"))
        steps = step if steps is None else steps.unionByName(step)
        now = best.select("origin", "hour", "target", F.col("b.src").alias("node"), F.col("b.before").alias("key"))
    none = F.array().cast(PATH)
    every = ends.select("origin", "hour", F.col("node").alias("target"))
    if steps is None:
        return every.withColumn("path", none)
    # Labels rise along a path, so that they order it.
    grown = steps.groupBy(*_state("target")).agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["s"]).cast(PATH).alias("path"))
    return every.join(grown, _state("target"), "left").withColumn("path", F.coalesce("path", none))


def relaxed_many(edges: DataFrame, asked: DataFrame, paths_too: bool = False) -> DataFrame:
    """one_to_many by relaxation, all origins and hours in one."""
    e = written(hourly(edges, asked), "search-open")
    asked = asked.withColumn("hour", F.coalesce("hour", F.lit(-1)))
    known = relaxed(e, asked)
    return answered(known, asked, (lambda ends: walked(e, known, ends)) if paths_too else None)


def answered(known: DataFrame, asked: DataFrame, walk: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The rows of one_to_many of all labels (origin, hour, node, key), where hour -1 is none; ``walk`` gives the
    paths (origin, hour, target, path) of ends (origin, hour, node, key)."""
    seconds = F.shiftright("key", HOP_BITS)
    ends = known.join(asked.select("origin", "hour", F.explode_outer("targets").alias("t")), _state()).where("t IS NULL OR t = node").drop("t")
    ends = written(ends.withColumn("seconds", seconds), "search-ends")
    got = ends.groupBy("origin", "hour").agg(F.max("seconds").alias("last"), F.count("*").alias("m"))
    far = asked.join(got, _state(), "left").select(*_state(F.when((F.size("targets") > F.coalesce("m", F.lit(0))) | F.col("targets").isNull(), None).otherwise(F.col("last")).alias("last")))
    settled = known.join(far, _state()).where(F.col("last").isNull() | (seconds <= F.col("last"))).groupBy("origin", "hour").agg(F.count("*").alias("settled"))
    out = ends.join(settled, _state())
    if walk is not None:
        out = out.join(walk(ends).withColumnRenamed("target", "node"), _state("node"))
    hour = F.nullif("hour", F.lit(-1)).alias("hour")
    return out.select("origin", hour, F.col("node").alias("target"), "seconds", "settled", *["path"] * (walk is not None))


def requests(members: DataFrame, places: DataFrame, hour: Column) -> DataFrame:
    """(origin, hour, targets): what the rooms ask for, each origin with the places of the rooms it is in."""
    rooms = places.where("node IS NOT NULL").groupBy("room_id").agg(F.collect_set("node").alias("targets"))
    return members.where("node IS NOT NULL").join(rooms, "room_id").select(F.col("node").alias("origin"), hour.cast("int").alias("hour"), "targets")


def matrix(found: DataFrame, members: DataFrame, places: DataFrame) -> DataFrame:
    """Cells (room_id, place_id, member_id, row, col, reachable, seconds, transfers, walk_m, summary, reason) of each room.

    ``members`` are (room_id, member_id, joined_at, node), ``places`` (room_id, place_id, created_at, node); rooms are capped
    at ten by thirty, so that a room's cells are few. ``found`` has (origin, target, seconds, transfers, walk_m,
    summary). A place or member without a node has reason NO_WALK_NETWORK, one that isn't reached UNREACHABLE. Columns
    stand in the order of joining, rows in that of creation.
    """
    m = members.select("room_id", "member_id", F.col("node").alias("origin"), F.row_number().over(W.partitionBy("room_id").orderBy("joined_at", "member_id")).alias("col"))
    p = places.select("room_id", "place_id", F.col("node").alias("target"), F.row_number().over(W.partitionBy("room_id").orderBy("created_at", "place_id")).alias("row"))
    out = m.join(p, "room_id").join(found, ["origin", "target"], "left")
    reason = F.when(F.col("origin").isNull() | F.col("target").isNull(), "NO_WALK_NETWORK").when(F.col("seconds").isNull(), "UNREACHABLE")
    return out.select("room_id", "place_id", "member_id", "row", "col", reason.isNull().alias("reachable"), "seconds", "transfers", "walk_m", "summary", reason.alias("reason"))


def matrix_stats(cells: DataFrame, found: DataFrame) -> DataFrame:
    """One row (origins, settled, unreachable): searches made, nodes settled in them, and cells without a way."""
    each = found.select("origin", "hour", "settled").distinct().agg(F.count("*").alias("origins"), F.coalesce(F.sum("settled"), F.lit(0)).alias("settled"))
    return each.crossJoin(F.broadcast(cells.agg(F.count_if(~F.col("reachable")).alias("unreachable"))))
