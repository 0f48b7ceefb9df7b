"""Searches on graphs beyond a broadcast: each part searches its own arrays, and parts exchange labels at their borders.

Nodes are dealt to parts of bounded size, neighbours together: by their places, or as clusters of the graph. A part's edges are files of their own, which
a task loads as arrays. In a round, the labels that improved at a part's nodes spread through the part, and those
that reach nodes of other parts are sent there; the smallest of each (origin, hour, node) counts, with the edge that it came by.
Rounds follow the borders that paths cross, and between rounds only labels at borders are kept. When none
improves any more, every part labels all its nodes from what is known at its borders. Paths are walked back within a part
until they leave it, again a round for each border.

Where a task can keep all parts (``HELD_EDGES``), or sums of labels alone are asked for (``reach``), nothing is exchanged: a task has origins of its own
and goes from part to part with their labels in memory, so that no label is shuffled or written. A part is entered again when labels at its nodes improve.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.operators.search import HOP_BITS, NAMES, NO_LABEL, NO_SERVICE, PATH, SUMS, Graph, _fan, answered, numbered, settle
from waymill.operators.spatial import blocks, placed
from waymill.scratch import cut, filesystem, scope, shared_dir, written

#: Nodes of a part, and labels that a task holds at once.
PART_NODES, STATES = 50_000, 1_000_000
#: Edges of the parts that a task keeps, some 60 bytes each, and labels of its origins in all parts, at least one origin's.
HELD_EDGES, HELD_STATES = 18_000_000, 4_000_000
#: Seconds by which a task's labels in a part may run ahead of those in other parts.
BAND = 300
ROW = ["part", "hour", "origin", "kind", "node", "key", "src", "edge", "target"]
SENT = "origin long, hour int, node long, part int, key long, src long, edge long"
LABELS = "origin long, hour int, node long, key long"
WALKED = "origin long, hour int, target long, at long, steps array<struct<edge:bigint,node:bigint,seconds:bigint>>, next long"
STEP = pa.struct([("edge", pa.int64()), ("node", pa.int64()), ("seconds", pa.int64())])
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Parts:
    """The folder of the parts' edges, the part of each node (node, part), and how many parts, nodes and edges there are."""

    folder: str
    owners: DataFrame
    count: int
    nodes: int
    edges: int


def clusters(edges: DataFrame, size: int, max_rounds: int = 60) -> DataFrame:
    """(node, cluster) of edges (src, dst): neighbours that many edges join are together, up to ``size`` nodes.

    In each round half of the clusters, by hash, offer themselves to a neighbour in the other half, the one with which they share
    most edges, and that one takes them in that order while there is room. Only the contracted edges go on to the next
    round, so that the work falls with the number of clusters; the end is a round in which hardly any find room.
    """
    one, other = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = written(edges.where("src <> dst").groupBy(one.alias("a"), other.alias("b")).agg(F.count("*").alias("w")), "cluster-pairs")
    sizes = written(edges.select(F.explode(F.array("src", "dst")).alias("c")).distinct().withColumn("n", F.lit(1)), "cluster-sizes")
    owners, count, quiet = sizes.select(F.col("c").alias("node"), F.col("c").alias("cluster")), sizes.count(), 0
    for k in range(max_rounds):
        takes = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where(~takes("a") & takes("b"))
        of = lambda c, n: sizes.select(F.col("c").alias(c), F.col("n").alias(n))
        fits = both.join(of("a", "m"), "a").join(of("b", "n"), "b").where(F.col("m") + F.col("n") <= size)
        offer = fits.groupBy("a", "m").agg(F.max(F.struct("w", (-F.col("n")).alias("n"), "b")).alias("o")).select("a", "m", "o.w", (-F.col("o.n")).alias("n"), "o.b")
        room = F.sum("m").over(W.partitionBy("b").orderBy(F.desc("w"), "m", "a"))
        moved = written(offer.withColumn("_sum", room).where(F.col("_sum") + F.col("n") <= size).select(F.col("a").alias("c"), F.col("b").alias("to")), "cluster-moves")
        n = moved.count()
        quiet = quiet + 1 if n * 20 < count else 0
        if quiet == 2 or not n and quiet:
            break
        if not n:
            continue
        count -= n
        now = lambda df, c: df.join(moved.select(F.col("c").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        owners = written(now(owners, "cluster"), "cluster-owners")
        sizes = written(now(sizes, "c").groupBy("c").agg(F.sum("n").cast("int").alias("n")), "cluster-sizes")
        met = now(now(pairs, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        pairs = written(met.groupBy("a", "b").agg(F.sum("w").alias("w")), "cluster-pairs")
    return owners


def divided(edges: DataFrame, places: DataFrame | None = None, size: int = PART_NODES, *, most: int | None = None) -> Parts:
    """The parts of a graph: neighbours by places (id, x, y), nodes without one dealt out by hash; or, where no places
    are given, clusters of the graph itself. The fewer edges leave a part, the fewer rounds a search takes. Parts grow from ``size`` up to
    ``PART_NODES`` where there would be more than ``most`` of them.

    Each node also has an edge to itself that never runs, so that every part knows all its nodes.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/parts-{uuid4().hex}"
    with scope(spark):
        e = numbered(edges)
        hours = [c for c in ("by_hour", "hops") if c in e.columns]
        nodes = written(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "part-nodes")
        total = nodes.count()
        if most is not None:
            size = max(size, min(PART_NODES, -(-total // most)))
        count = max(1, -(-total // size))
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(count)).cast("int").alias("part")
        if count == 1:
            owners = nodes.select("node", F.lit(0).alias("part"))
        elif places is None:
            owners = clusters(e, max(1, size // 2)).select("node", part("cluster"))
        else:
            at = placed(places.select(F.col("id").alias("node"), "x", "y"), "x", "y").join(nodes, "node", "left_semi")
            near = blocks(at.dropDuplicates(["node"]), "x", "y", size, "node").select("node", F.col("block").alias("_block"))
            owners = nodes.join(near, "node", "left").select("node", F.coalesce("_block", part("node")).alias("part"))
        owners.write.parquet(f"{folder}-owners")
    owners = spark.read.schema("node long, part int").parquet(f"{folder}-owners")
    of = lambda c, p: owners.select(F.col("node").alias(c), F.col("part").alias(p))
    rows = e.select("src", "dst", "edge", "weight_sec", *hours).join(of("src", "part"), "src").join(of("dst", "to_part"), "dst")
    still = owners.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(-1).cast("long").alias("edge"), F.lit(NO_SERVICE).cast("int").alias("weight_sec"), *[F.lit(1 if h == "hops" else None).cast(e.schema[h].dataType).alias(h) for h in hours], "part", F.col("part").alias("to_part"))
    whole = rows.select(*still.columns).unionByName(still)
    whole.repartition("part").write.partitionBy("part").parquet(folder)
    return Parts(folder, owners, int(owners.agg(F.max("part")).first()[0] or 0) + 1, total, e.count())


class Loaded:
    """A part's graph, with the part that each of its nodes belongs to."""

    def __init__(self, folder: str, part: int):
        system, root = filesystem(folder)
        found = system.get_file_info(fs.FileSelector(f"{root}/part={part}"))
        files = sorted(f.path for f in found if f.path.endswith(".parquet"))
        table = pa.concat_tables([pq.read_table(f, filesystem=system, partitioning=None) for f in files])
        self.part, self.graph = part, Graph.of(table)
        self.owner = np.full(len(self.graph.ids), part)
        self.owner[self.graph.index(table.column("dst").to_numpy())] = table.column("to_part").to_numpy()


@dataclass(frozen=True)
class Search:
    """The labels of some origins (origins, nodes of a part) of an hour, and the rows that they come from."""

    loaded: Loaded
    hour: int
    weight: np.ndarray
    origins: np.ndarray
    key: np.ndarray
    rows: dict[str, np.ndarray]
    who: np.ndarray  # the place in ``origins`` of each row


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of consecutive rows, never cut within an origin of a part and hour."""

    def columns(rows: pa.Table) -> dict[str, np.ndarray]:
        return {c: rows.column(c).fill_null(NONE).to_numpy() if c in ("src", "edge", "target") else rows.column(c).to_numpy() for c in ROW}

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        same = np.ones(held.num_rows, bool)
        for c in ("part", "hour", "origin"):
            values = held.column(c).to_numpy()
            same &= values == values[-1]
        whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if whole:
            yield columns(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None:
        yield columns(held)


def _searches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[Search]:
    loaded: Loaded | None = None
    for rows in _groups(batches):
        new = np.flatnonzero(np.append(True, (np.diff(rows["part"]) != 0) | (np.diff(rows["hour"]) != 0) | (np.diff(rows["origin"]) != 0)))
        ends = np.append(new[1:], len(rows["part"]))
        i = 0
        while i < len(new):
            part, hour = rows["part"][new[i]], rows["hour"][new[i]]
            if loaded is None or loaded.part != part:
                loaded = Loaded(folder, int(part))
            n = len(loaded.graph.ids)
            j = i + 1
            while j < len(new) and rows["part"][new[j]] == part and rows["hour"][new[j]] == hour and (j - i + 1) * n <= STATES:
                j += 1
            some = {c: v[new[i] : ends[j - 1]] for c, v in rows.items()}
            who = np.repeat(np.arange(j - i), ends[i:j] - new[i:j])
            key = np.full((j - i) * n, NO_LABEL)
            seeds = some["kind"] == 0
            at = who[seeds] * n + loaded.graph.index(some["node"][seeds])
            np.minimum.at(key, at, some["key"][seeds])
            weight = loaded.graph.weights(None if hour < 0 else int(hour))
            settle(loaded.graph, weight, key, np.unique(at))
            yield Search(loaded, int(hour), weight, some["origin"][np.append(0, np.flatnonzero(np.diff(who)) + 1)], key.reshape(j - i, n), some, who)
            i = j


def _tight(s: Search, who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, edge): the edge within the part that gives a node its label, from the smallest node, then of the smallest id."""
    g = s.loaded.graph
    slots, which = _fan(g.back_head, node)
    edges = g.back[slots]
    w, before = s.weight[edges], s.key[who[which], g.source[edges]]
    fits = (w >= 0) & (before != NO_LABEL)
    fits &= np.where(fits, before, 0) + g.added(s.weight, edges) == s.key[who, node][which]
    which, first = np.unique(which[fits], return_index=True)
    return which, edges[fits][first]


def _exchange(folder: str) -> Callable:
    """Labels that leave the part: the least of each origin and node outside, with the edge that it came by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _searches(batches, folder):
            g, outside = s.loaded.graph, np.flatnonzero(s.loaded.owner != s.loaded.part)
            who, j = np.nonzero(s.key[:, outside] != NO_LABEL)
            node = outside[j]
            which, edge = _tight(s, who, node)
            who, node = who[which], node[which]
            columns = [s.origins[who], np.full(len(who), s.hour, np.int32), g.ids[node], s.loaded.owner[node].astype(np.int32), s.key[who, node], g.ids[g.source[edge]], g.edge[edge]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in SENT.split(", ")])

    return run


def _labelled(folder: str) -> Callable:
    """The labels of all nodes of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _searches(batches, folder):
            inside = np.flatnonzero((s.loaded.owner == s.loaded.part) & (np.arange(len(s.loaded.owner)) >= s.loaded.graph.places))
            who, j = np.nonzero(s.key[:, inside] != NO_LABEL)
            columns = [s.origins[who], np.full(len(who), s.hour, np.int32), s.loaded.graph.ids[inside[j]], s.key[who, inside[j]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in LABELS.split(", ")])

    return run


def _walks(folder: str) -> Callable:
    """Paths walked back within the part: the steps, and the node outside where they go on, if they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _searches(batches, folder):
            g, n = s.loaded.graph, len(s.loaded.graph.ids)
            known = s.rows["kind"] == 0
            at = s.who[known] * n + g.index(s.rows["node"][known])
            valid = s.rows["key"][known] == s.key.reshape(-1)[at]
            came = {c: np.full(s.key.size, NONE) for c in ("src", "edge")}
            for c in came:
                came[c][at[valid]] = s.rows[c][known][valid]
            walker, target = s.who[~known], s.rows["target"][~known]
            node, who = g.index(s.rows["node"][~known]), np.arange(len(walker))
            start = s.key[walker, node]
            goes_on = np.full(len(walker), NONE)
            walked: list[tuple[np.ndarray, ...]] = []
            origin = g.index(s.origins)
            while True:
                moving = node != origin[walker[who]]
                node, who = node[moving], who[moving]
                if not len(who):
                    break
                mine = walker[who]
                src, edge, inner = np.full(len(who), NONE), np.full(len(who), NONE), np.full(len(who), -1)
                which, best = _tight(s, mine, node)
                src[which], edge[which], inner[which] = g.ids[g.source[best]], g.edge[best], g.source[best]
                other, by = came["src"][mine * n + node], came["edge"][mine * n + node]
                leaves = (other < src) | ((other == src) & (by < edge))
                edge = np.where(leaves, by, edge)
                walked.append((who, edge, g.ids[node], s.key[mine, node]))
                goes_on[who[leaves]] = other[leaves]
                node, who = inner[~leaves], who[~leaves]
            if not len(walker):
                continue
            steps: list[list[dict]] = [[] for _ in walker]
            for whose, edge, place, label in walked[::-1]:
                for i, e, v, k in zip(whose.tolist(), edge.tolist(), place.tolist(), label.tolist()):
                    steps[i].append({"edge": e, "node": v, "seconds": k >> HOP_BITS})
            columns = [pa.array(s.origins[walker]), pa.array(np.full(len(walker), s.hour, np.int32)), pa.array(target), pa.array(start), pa.array(steps, pa.list_(STEP)), pa.array(goes_on, mask=goes_on == NONE)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WALKED.split(", ")])

    return run


def _dealt(rows: DataFrame, parts: Parts, spread: int) -> DataFrame:
    """Rows of one part, hour and origin together, and the origins of a part over up to ``spread`` tasks."""
    tasks = max(1, min(parts.count * spread, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    batch = F.pmod(F.xxhash64("origin", "hour"), F.lit(spread))
    none = {c: F.lit(None).cast("long") for c in ("src", "edge", "target", "key")} | {"kind": F.lit(0)}
    full = rows.select(*[(F.col(c) if c in rows.columns else none[c]).alias(c) for c in ROW])
    return full.repartition(tasks, "part", batch).sortWithinPartitions("part", "hour", "origin", "kind")


def borders(parts: Parts, asked: DataFrame, spread: int, max_rounds: int = 10_000) -> DataFrame:
    """(origin, hour, node, part, key, src, edge): what is known where searches begin and enter parts."""
    state = ["origin", "hour", "node"]
    none = F.lit(None).cast("long")
    known = asked.select("origin", "hour", F.col("origin").alias("node")).join(parts.owners, "node").select(*state, "part", F.lit(0).cast("long").alias("key"), none.alias("src"), none.alias("edge"))
    front = known = cut(known)
    for _ in range(max_rounds):
        if front.isEmpty():
            return known
        sent = _dealt(front, parts, spread).mapInArrow(_exchange(parts.folder), SENT)
        sent = sent.groupBy(*state).agg(F.min(F.struct("key", "src", "edge")).alias("new"), F.first("part").alias("to"))
        old = F.struct("key", "src", "edge")
        # Null source and edge, of an origin itself, sort before others; a label that ties only changes the edge.
        both = known.join(sent, state, "full_outer").withColumn("old", F.when(F.col("key").isNotNull(), old))
        least = F.least("old", "new")
        nearer = F.col("new").isNotNull() & (F.col("key").isNull() | (F.col("new.key") < F.col("key")))
        both = cut(both.select(*state, F.coalesce("part", "to").alias("part"), least.alias("l"), nearer.alias("nearer")).select(*state, "part", "l.key", "l.src", "l.edge", "nearer"))
        known, front = both.drop("nearer"), both.where("nearer").drop("nearer", "src", "edge")
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def walked(parts: Parts, known: DataFrame, ends: DataFrame, spread: int) -> DataFrame:
    """(origin, hour, target, path) of ends (origin, hour, node)."""
    here = ["part", "hour", "origin"]
    every = ends.select("origin", "hour", F.col("node").alias("target"))
    now = every.withColumn("node", F.col("target")).where("node <> origin")
    segments, rounds = None, 0
    while not now.isEmpty():
        at = now.join(parts.owners, "node").withColumn("kind", F.lit(1))
        seeds = known.join(at.select(*here).distinct(), here, "left_semi").withColumn("kind", F.lit(0))
        found = _dealt(seeds.unionByName(at, allowMissingColumns=True), parts, spread).mapInArrow(_walks(parts.folder), WALKED)
        found = written(found.withColumn("before", F.lit(rounds)), "search-segments")
        rounds -= 1
        segments = found if segments is None else segments.unionByName(found)
        now = found.where("next IS NOT NULL").select("origin", "hour", "target", F.col("next").alias("node")).where("node <> origin")
    none = F.array().cast("array<struct<edge:bigint,node:bigint,seconds:bigint>>")
    if segments is None:
        return every.withColumn("path", none)
    # The way back is a segment a round; labels may be equal at both ends of an edge to a place.
    grown = segments.groupBy("origin", "hour", "target").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", "steps"))), lambda s: s["steps"])).alias("path"))
    return every.join(grown, ["origin", "hour", "target"], "left").withColumn("path", F.coalesce("path", none))


class Held:
    """The parts that a task's process has read, of which the longest unused are given up beyond ``HELD_EDGES``."""

    def __init__(self, folder: str):
        self.folder, self.parts = folder, OrderedDict()
        self._weights: dict[tuple[int, int], np.ndarray] = {}

    def __getitem__(self, part: int) -> Loaded:
        if part not in self.parts:
            self.parts[part] = Loaded(self.folder, part)
            while len(self.parts) > 1 and sum(len(p.graph.to) for p in self.parts.values()) > HELD_EDGES:
                gone, _ = self.parts.popitem(last=False)
                self._weights = {k: w for k, w in self._weights.items() if k[0] != gone}
        self.parts.move_to_end(part)
        return self.parts[part]

    def weights(self, part: int, hour: int) -> np.ndarray:
        g = self[part].graph
        if {h for _, h in self._weights} - {hour}:
            self._weights.clear()
        if (part, hour) not in self._weights:
            self._weights[part, hour] = g.weights(None if hour < 0 else hour)
        return self._weights[part, hour]


#: The parts of the graph that a task's process has searched last, by their folder.
_HELD: dict[str, Held] = {}


def _held(folder: str) -> Held:
    if folder not in _HELD:
        _HELD.clear()
        _HELD[folder] = Held(folder)
    return _HELD[folder]


def _spread(held: Held, hour: int, origins: np.ndarray, homes: np.ndarray) -> dict[int, np.ndarray]:
    """The labels (origins, nodes) of the parts that origins of an hour reach, from the parts that they are in.

    The part with the least label that is still to be spread is next, for ``BAND`` seconds from it; labels that improve at nodes of other parts
    wait there, and those beyond the band in the part.
    """
    k = len(origins)
    keys: dict[int, np.ndarray] = {}
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
    beyond: dict[int, np.ndarray] = {}

    def wait(who: np.ndarray, node: np.ndarray, label: np.ndarray, to: np.ndarray) -> None:
        for p in np.unique(to).tolist():
            there = to == p
            waiting.setdefault(p, []).append((who[there], node[there], label[there]))

    def least(p: int) -> int:
        mine = [int(label.min()) for _, _, label in waiting.get(p, ())]
        return min(mine + ([int(keys[p].reshape(-1)[beyond[p]].min())] if p in beyond else []))

    wait(np.arange(k), origins, np.zeros(k, np.int64), homes)
    first = {p: 0 for p in waiting}
    while first:
        part = min(first, key=first.__getitem__)
        until = (first.pop(part) >> HOP_BITS) + BAND
        loaded = held[part]
        g, n = loaded.graph, len(loaded.graph.ids)
        if part not in keys:
            keys[part] = np.full((k, n), NO_LABEL)
        key, outside = keys[part].reshape(-1), np.flatnonzero(loaded.owner != part)
        before = keys[part][:, outside]
        begin = [beyond.pop(part)] if part in beyond else []
        if part in waiting:
            who, node, label = (np.concatenate(c) for c in zip(*waiting.pop(part)))
            at = who * n + g.index(node)
            better = label < key[at]
            np.minimum.at(key, at[better], label[better])
            begin.append(at[better])
        start = np.unique(np.concatenate(begin))

        def stop(left: np.ndarray, high: int) -> np.ndarray:
            if high < until or not len(left):
                return left
            beyond[part] = left
            return left[:0]

        settle(g, held.weights(part, hour), key, start, stop)
        who, j = np.nonzero(keys[part][:, outside] < before)
        node = outside[j]
        wait(who, g.ids[node], keys[part][who, node], loaded.owner[node])
        first |= {p: least(p) for p in {part, *np.unique(loaded.owner[node]).tolist()} if p in waiting or p in beyond}
    return keys


def _own(held: Held, keys: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, labels) of the nodes that each part owns, places left out."""
    for part, key in keys.items():
        loaded = held[part]
        inside = np.flatnonzero((loaded.owner == part) & (np.arange(len(loaded.owner)) >= loaded.graph.places))
        yield loaded.graph.ids[inside], key[:, inside]


def _ways(held: Held, hour: int, keys: dict[int, np.ndarray], origins: np.ndarray, who: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """The steps from ``origins[who]`` to each of ``ends``. A node's last edge is sought in every part that has the node:
    the one from the smallest node, then of the smallest id, of those that give it its least label."""
    ids = np.concatenate([held[p].graph.ids for p in keys])
    part = np.concatenate([np.full(len(held[p].graph.ids), p) for p in keys])
    order = np.argsort(ids, kind="stable")
    ids, part = ids[order], part[order]
    out: list[list[dict]] = [[] for _ in ends]
    now, i = ends, np.arange(len(ends))
    while True:
        moving = now != origins[who[i]]
        now, i = now[moving], i[moving]
        if not len(now):
            return [steps[::-1] for steps in out]
        low = np.searchsorted(ids, now)
        size = np.searchsorted(ids, now, "right") - low
        which = np.repeat(np.arange(len(now)), size)
        there = part[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]]
        found: list[tuple[np.ndarray, ...]] = []
        for p in np.unique(there).tolist():
            mine = which[there == p]
            g, w = held[p].graph, who[i[mine]]
            v = g.index(now[mine])
            known = keys[p][w, v] != NO_LABEL
            mine, w, v = mine[known], w[known], v[known]
            row, edge = _tight(Search(held[p], hour, held.weights(p, hour), origins, keys[p], {}, w), w, v)
            found.append((mine[row], keys[p][w[row], v[row]], g.ids[g.source[edge]], g.edge[edge]))
        mine, label, src, edge = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((edge, src, label, mine))
        mine, first = np.unique(mine[order], return_index=True)
        best = order[first]
        for j, e, v, s in zip(i[mine].tolist(), edge[best].tolist(), now[mine].tolist(), (label[best] >> HOP_BITS).tolist()):
            out[j].append({"edge": e, "node": v, "seconds": s})
        now, i = src[best], i[mine]


def _asked(batches: Iterator[pa.RecordBatch], folder: str, nodes: int) -> Iterator[tuple[Held, int, list, np.ndarray, dict[int, np.ndarray]]]:
    """(parts, hour, requests, origins, labels) of requests (origin, hour, targets, part), as many at once as labels may be held."""
    for batch in batches:
        rows = sorted(batch.to_pylist(), key=lambda r: (r["hour"], r["part"], r["origin"]))
        i = 0
        while i < len(rows):
            some = [r for r in rows[i : i + max(1, HELD_STATES // max(1, nodes))] if r["hour"] == rows[i]["hour"]]
            origins = np.array([r["origin"] for r in some], np.int64)
            held = _held(folder)
            yield held, some[0]["hour"], some, origins, _spread(held, some[0]["hour"], origins, np.array([r["part"] for r in some]))
            i += len(some)


def _reach(folder: str, nodes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, hour, some, origins, keys in _asked(batches, folder, nodes):
            reached, total, most = (np.zeros(len(some), np.int64) for _ in range(3))
            for _, key in _own(held, keys):
                there = key != NO_LABEL
                seconds = np.where(there, key >> HOP_BITS, 0)
                reached += there.sum(1)
                total += seconds.sum(1)
                most = np.maximum(most, seconds.max(1, initial=0))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (origins, np.full(len(some), hour, np.int32), reached, total, most)], SUMS)

    return run


def _answers(folder: str, nodes: int, paths_too: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, hour, some, origins, keys in _asked(batches, folder, nodes):
            own = list(_own(held, keys))
            ids, key = np.concatenate([i for i, _ in own]), np.concatenate([k for _, k in own], axis=1)
            for i, row in enumerate(some):
                reached = np.flatnonzero(key[i] != NO_LABEL)
                seconds = key[i][reached] >> HOP_BITS
                wanted = None if row["targets"] is None else np.array(row["targets"], np.int64)
                at = np.arange(len(reached)) if wanted is None else np.flatnonzero(np.isin(ids[reached], wanted))
                whole = wanted is None or len(at) < len(wanted)
                last = seconds[slice(None) if whole else at].max(initial=0)
                ends, m = ids[reached[at]], len(at)
                columns = [pa.array(np.full(m, row["origin"])), pa.nulls(m, pa.int32()) if hour < 0 else pa.array(np.full(m, hour, np.int32)), pa.array(ends), pa.array(seconds[at]), pa.array(np.full(m, int((seconds <= last).sum())))]
                if paths_too:
                    columns.append(pa.array(_ways(held, hour, keys, origins, np.full(m, i), ends), pa.list_(STEP)))
                yield pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])

    return run


def _homes(parts: Parts, asked: DataFrame) -> DataFrame:
    """Requests (origin, hour, targets) with the part of their origin, dealt out over the cores."""
    at = asked.select("origin", F.coalesce("hour", F.lit(-1)).alias("hour"), "targets").join(parts.owners.withColumnRenamed("node", "origin"), "origin")
    tasks = max(1, min(asked.count(), 4 * asked.sparkSession.sparkContext.defaultParallelism))
    return at.repartition(tasks, "origin", "hour")


def reach(parts: Parts, asked: DataFrame) -> DataFrame:
    """(origin, hour, reached, total, most): how many nodes each origin reaches, their seconds in all and the most, of written requests
    (origin, hour, targets), whose targets don't count. Only these sums leave a task, whatever the number of labels."""
    sums = _homes(parts, asked).mapInArrow(_reach(parts.folder, parts.nodes), "origin long, hour int, reached long, total long, most long")
    return sums.select("origin", F.nullif("hour", F.lit(-1)).alias("hour"), "reached", "total", "most")


def searched(parts: Parts, asked: DataFrame, paths_too: bool = False) -> DataFrame:
    """one_to_many of written requests (origin, hour, targets) by parts. Each origin's whole reach is searched: by tasks with
    origins of their own if they can keep all parts, else in rounds, where each task has a part."""
    if parts.edges <= HELD_EDGES:
        schema = "origin long, hour int, target long, seconds long, settled long" + f", path {PATH}" * paths_too
        return _homes(parts, asked).mapInArrow(_answers(parts.folder, parts.nodes, paths_too), schema)
    return in_rounds(parts, asked, paths_too)


def in_rounds(parts: Parts, asked: DataFrame, paths_too: bool = False) -> DataFrame:
    """``searched`` by rounds in which parts exchange labels at their borders."""
    asked = asked.withColumn("hour", F.coalesce("hour", F.lit(-1)))
    spread = max(1, min(64, asked.count() // 16))
    known = borders(parts, asked, spread)
    labels = written(_dealt(known, parts, spread).mapInArrow(_labelled(parts.folder), LABELS), "search-labels")
    return answered(labels, asked, (lambda ends: walked(parts, known, ends, spread)) if paths_too else None)
