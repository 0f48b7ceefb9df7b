"""Nodes and edges of the multimodal graph.

Nodes: id, kind (WALK, STOP, PLATFORM), mode, source_id, line, name, x, y. Edges: edge, src, dst, kind, mode, line,
weight_sec, by_hour (24 weights or null), distance_m. Ids are hashes of what they name, so that edges can be
built without a round trip through numbered tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.functions.crs import planar
from waymill.functions.scalars import NO_SERVICE, base_line, board_wait, is_branch, number_of, representative, shifted_hours, walk_seconds
from waymill.operators.search import WALKED
from waymill.operators.spatial import nearest, within
from waymill.scratch import only, written

ACCESS_METRES, TRANSFER_FALLBACK, SAME_LINE, BUS_ALIGHT = 1000.0, 180, 30, 1
#: Bounds of a bus section's seconds.
BUS_RUN = (1, 3600)
#: Kinds of bus routes that the graph leaves out, by name as the register has them (fixed values).
EXCLUDED_ROUTES = ("경기", "인천", "광역")
#: Bits of ids, and of those that name a block in running sums.
ID_BITS, BLOCK_BITS = 60, 12


def node_id(kind: str, mode: Column, source_id: Column, line: Column) -> Column:
    return number_of(F.lit(kind), mode, source_id, F.coalesce(line, F.lit("")))


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, mode: Column, weight: Column, line: Column | None = None, by_hour: Column | None = None, distance: Column | None = None) -> DataFrame:
    out = df.select(
        src.alias("src"),
        dst.alias("dst"),
        F.lit(kind).alias("kind"),
        mode.alias("mode"),
        (F.lit(None) if line is None else line).cast("string").alias("line"),
        weight.cast("int").alias("weight_sec"),
        (F.lit(None) if by_hour is None else by_hour).cast("array<short>").alias("by_hour"),
        (F.lit(None) if distance is None else distance).cast("double").alias("distance_m"),
    )
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src", "dst", "kind", "line", "weight_sec")]
    return out.select(number_of(*text).alias("edge"), "*")


def walk_nodes(nodes: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    sid = F.col("id").cast("string")
    return nodes.select(node_id("WALK", F.lit("WALK"), sid, F.lit("")).alias("id"), F.lit("WALK").alias("kind"), F.lit("WALK").alias("mode"), sid.alias("source_id"), none.alias("line"), none.alias("name"), "x", "y")


def walk_edges(edges: DataFrame, named: bool = False) -> DataFrame:
    """WALK edges (src, dst, length in metres), as given; ``named`` if src and dst are node ids already."""
    at = lambda c: F.col(c) if named else node_id("WALK", F.lit("WALK"), F.col(c).cast("string"), F.lit(""))
    return _edge(edges, at("src"), at("dst"), "WALK", F.lit("WALK"), walk_seconds(F.col("length")), distance=F.col("length"))


def walks_within(nodes: DataFrame, metres: float) -> DataFrame:
    """WALK edges between every two WALK nodes (id, x, y) no further apart than ``metres``.

    Places meet, and then the nodes at them, so that distances are computed once for all nodes that share their places.
    """
    at = nodes.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "x", "y").groupBy("x", "y").agg(F.collect_list("id").alias("ids"))
    pairs = within(at.select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("ids").alias("a")), at.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("ids").alias("b")), metres)
    each = pairs.select("a", "distance", F.explode("b").alias("dst")).select(F.explode("a").alias("src"), "dst", F.col("distance").alias("length"))
    return walk_edges(each.where("src <> dst"), named=True)


def places_in_reach(nodes: DataFrame, metres: float) -> DataFrame:
    """(lx, ly, rx, ry, distance) of every two places of nodes (id, x, y) no further apart than ``metres``, each with itself too."""
    at = nodes.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "x", "y").select("x", "y").distinct()
    return within(at.select(F.col("x").alias("lx"), F.col("y").alias("ly")), at.select(F.col("x").alias("rx"), F.col("y").alias("ry")), metres).select("lx", "ly", "rx", "ry", "distance")


def walks_between(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """The WALK edges of ``walks_within`` from the places in reach of each other (``places_in_reach``) and the nodes (id, x, y) at them."""
    at = nodes.groupBy("x", "y").agg(F.collect_list("id").alias("ids"))
    both = places.join(at.toDF("lx", "ly", "a"), ["lx", "ly"]).join(at.toDF("rx", "ry", "b"), ["rx", "ry"])
    spread = both.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "lx", "ly", "rx", "ry")
    each = spread.select("a", "distance", F.explode("b").alias("dst")).select(F.explode("a").alias("src"), "dst", F.col("distance").alias("length"))
    return walk_edges(each.where("src <> dst"), named=True)


def walks_on(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The WALK edges of ``walks_within`` that lie on found paths (origin, path): those between WALK nodes (id, x, y) that follow each other."""
    pair = F.transform("path", lambda s, i: F.struct(F.coalesce(F.get("path", i - 1)["node"], F.col("origin")).alias("src"), s["node"].alias("dst")))
    pairs = found.select(F.explode(pair).alias("p")).select("p.*").distinct()
    at = only(nodes.select("id", "x", "y"), "id", pairs.select(F.explode(F.array("src", "dst")).alias("id")))
    both = pairs.join(at.toDF("src", "lx", "ly"), "src").join(at.toDF("dst", "rx", "ry"), "dst")
    return walk_edges(both.select("src", "dst", planar(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")).alias("length")), named=True)


def walks_by_place(nodes: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """(edges for searches, the (id, x, y) of the nodes among them that stand for places): the ways of ``walks_within``, but of
    places and not of the nodes at them.

    A place of several nodes has one node where they all go out and one where they all come in, with negative ids; from and to
    its own nodes no time passes and no edge is counted (``hops`` 0). So edges grow with the places in reach and the nodes, not with the square of
    the nodes at a place. Walk edges have the id ``search.WALKED``; ``search.resolved`` gives those of a path theirs.
    """
    at = nodes.where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.collect_set("id").alias("ids"))
    # Minus zero is the place of zero.
    of = lambda k: -(number_of(F.lit("PLACE"), *[(F.col(c) + 0.0).cast("string") for c in ("x", "y")]) * 2 + k)
    one = F.size("ids") == 1
    end = lambda k: F.when(one, F.get("ids", F.lit(0))).otherwise(of(k))
    at = written(at.select("x", "y", "ids", end(1).alias("out"), end(2).alias("into")), "walk-places")
    # Few bytes that much work follows from.
    spread = at.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "x", "y")
    pairs = within(spread.select(F.col("x").alias("lx"), F.col("y").alias("ly"), "out"), at.select(F.col("x").alias("rx"), F.col("y").alias("ry"), "into"), metres)
    edge = lambda df, src, dst, seconds, hops: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(WALKED).cast("long").alias("edge"), seconds.cast("int").alias("weight_sec"), F.lit(None).cast("array<short>").alias("by_hour"), F.lit(hops).cast("byte").alias("hops"))
    several = at.where(~one)
    each = several.select("out", "into", F.explode("ids").alias("id"))
    edges = edge(pairs.where("out <> into"), "out", "into", walk_seconds(F.col("distance")), 1).unionByName(edge(each, "id", "out", F.lit(0), 0)).unionByName(edge(each, "into", "id", F.lit(0), 0))
    return edges, several.select(F.explode(F.array("out", "into")).alias("id"), "x", "y")


def walk_sums(nodes: DataFrame, metres: float, places: DataFrame | None = None) -> DataFrame:
    """(src, degree, seconds, most, metres) of the WALK nodes (id, x, y) that ``walks_within`` gives edges: their number and the
    sums of their weights and lengths, and the largest weight.

    Places are joined and never the nodes at them, so that the work grows with the places in reach and not with the edges. An id is at one place.
    Where the ``places_in_reach`` are known they may be given.
    """
    own = nodes.groupBy("id", "x", "y").agg(F.count("*").alias("times"))
    at = own.groupBy("x", "y").agg(F.sum("times").alias("n"))
    to = at.select(F.col("x").alias("rx"), F.col("y").alias("ry"), "n")
    pairs = within(at.select(F.col("x").alias("lx"), F.col("y").alias("ly")), to, metres) if places is None else places.join(to, ["rx", "ry"])
    sec = walk_seconds(F.col("distance")).cast("long")
    place = pairs.groupBy(F.col("lx").alias("x"), F.col("ly").alias("y")).agg(F.sum("n").alias("all"), F.sum(sec * F.col("n")).alias("every"), F.max(sec).alias("most"), F.sum(F.col("distance") * F.col("n")).alias("far"))
    t = F.col("times")
    sums = own.join(place, ["x", "y"]).where("all > times")
    return sums.select(F.col("id").alias("src"), (t * (F.col("all") - t)).alias("degree"), (t * (F.col("every") - t * walk_seconds(F.lit(0.0)).cast("long"))).alias("seconds"), "most", (t * F.col("far")).alias("metres"))


def stop_nodes(stops: DataFrame, mode: str) -> DataFrame:
    """STOP nodes of (source_id, name, x, y), the mean place of each.

    A stop of several names is called by its source_id with the other names in brackets behind it.
    """
    names = F.array_sort(F.collect_set("name"))
    others = F.array_join(F.filter("names", lambda n: n != F.col("source_id")), ",")
    mean = stops.groupBy("source_id").agg(names.alias("names"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    name = F.when(F.size("names") > 1, F.concat("source_id", F.lit("("), others, F.lit(")"))).otherwise(F.get("names", F.lit(0)))
    return mean.select(node_id("STOP", F.lit(mode), F.col("source_id"), F.lit("")).alias("id"), F.lit("STOP").alias("kind"), F.lit(mode).alias("mode"), "source_id", F.lit(None).cast("string").alias("line"), name.alias("name"), "x", "y")


def platform_nodes(served: DataFrame, stops: DataFrame, mode: str) -> DataFrame:
    """PLATFORM nodes of each (source_id, line) served, where its STOP node is."""
    at = stops.select("source_id", "name", "x", "y")
    return served.select("source_id", "line").distinct().join(at, "source_id").select(node_id("PLATFORM", F.lit(mode), F.col("source_id"), F.col("line")).alias("id"), F.lit("PLATFORM").alias("kind"), F.lit(mode).alias("mode"), "source_id", "line", "name", "x", "y")


def ride_edges(legs: DataFrame, mode: str) -> DataFrame:
    """RIDE edges of (line, a, b, seconds) or (line, a, b, by_hour); the median over equal pairs, no loops.

    Hours of sections are clipped to the bounds of a run; a section that never runs has no edge.
    """
    at = lambda c: node_id("PLATFORM", F.lit(mode), F.col(c), F.col("line"))
    legs = legs.where("a <> b")
    if "by_hour" in legs.columns:
        clipped = F.transform("by_hour", lambda h: F.when(h == NO_SERVICE, h).otherwise(F.greatest(F.lit(BUS_RUN[0]), F.least(F.lit(BUS_RUN[1]), h))))
        return _edge(legs.withColumn("by_hour", clipped), at("a"), at("b"), "RIDE", F.lit(mode), representative(F.col("by_hour")), F.col("line"), F.col("by_hour")).where("weight_sec >= 0")
    one = legs.groupBy("line", "a", "b").agg(F.bround(F.percentile("seconds", F.lit(0.5))).cast("int").alias("seconds"))
    return _edge(one.where("seconds IS NOT NULL"), at("a"), at("b"), "RIDE", F.lit(mode), F.col("seconds"), F.col("line"))


def priced_platforms(waits: DataFrame, walks: DataFrame | None) -> DataFrame:
    """Platforms (source_id, line, by_hour) with the seconds of their ``walk``, none without one."""
    w = waits if walks is None else waits.join(walks.select("source_id", "line", F.col("sec").alias("walk")), ["source_id", "line"], "left")
    return w.withColumn("walk", F.coalesce("walk", F.lit(0)) if "walk" in w.columns else F.lit(0))


def board_edges(waits: DataFrame, walks: DataFrame | None, mode: str) -> tuple[DataFrame, DataFrame]:
    """(BOARD, ALIGHT) edges of platforms (source_id, line, by_hour of waits or null).

    Boarding is the platform walk plus the hour's wait; platforms without waits get no BOARD.
    Alighting is the walk, one second without one.
    """
    w = priced_platforms(waits, walks)
    stop, platform = node_id("STOP", F.lit(mode), F.col("source_id"), F.lit("")), node_id("PLATFORM", F.lit(mode), F.col("source_id"), F.col("line"))
    hours, wait = shifted_hours(F.col("by_hour"), F.col("walk").cast("short")), representative(F.col("by_hour"))
    board = _edge(w.where("by_hour IS NOT NULL").where(wait >= 0), stop, platform, "BOARD", F.lit(mode), F.col("walk") + wait, F.col("line"), hours)
    return board, _edge(w, platform, stop, "ALIGHT", F.lit(mode), F.greatest(F.lit(BUS_ALIGHT), F.col("walk")), F.col("line"))


def transfer_seconds(platforms: DataFrame, measured: DataFrame) -> DataFrame:
    """(station, line_a, line_b, sec, fallback) of every two platforms of a station.

    A branch takes the fallback, lines of the same base little, then comes the measured time of the base lines, then
    the fallback. Pairs are joined within a station alone.
    """
    a = platforms.select("station", F.col("line").alias("line_a"), base_line(F.col("line")).alias("_a"))
    b = platforms.select("station", F.col("line").alias("line_b"), base_line(F.col("line")).alias("_b"))
    known = measured.select("station", F.col("line_a").alias("_a"), F.col("line_b").alias("_b"), F.col("sec").alias("known"))
    pairs = a.join(b, "station").where("line_a <> line_b").join(known, ["station", "_a", "_b"], "left")
    branch = is_branch(F.col("line_a")) | is_branch(F.col("line_b"))
    same = F.col("_a") == F.col("_b")
    sec = F.when(branch, TRANSFER_FALLBACK).when(same, SAME_LINE).otherwise(F.coalesce("known", F.lit(TRANSFER_FALLBACK)))
    fallback = branch | (~same & F.col("known").isNull())
    return pairs.select("station", "line_a", "line_b", sec.cast("int").alias("sec"), fallback.alias("fallback"))


def transfer_edges(seconds: DataFrame, waits: DataFrame, mode: str) -> DataFrame:
    """TRANSFER edges: the walk between platforms and the wait for the line boarded; lines without waits get none."""
    w = waits.where("by_hour IS NOT NULL").select(F.col("source_id").alias("station"), F.col("line").alias("line_b"), "by_hour")
    t = seconds.join(w, ["station", "line_b"])
    at = lambda c: node_id("PLATFORM", F.lit(mode), F.col("station"), F.col(c))
    hours, wait = shifted_hours(F.col("by_hour"), F.col("sec").cast("short")), representative(F.col("by_hour"))
    return _edge(t.where(wait >= 0), at("line_a"), at("line_b"), "TRANSFER", F.lit(mode), F.col("sec") + wait, F.col("line_b"), hours)


def fallback_ratio(seconds: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (fallbacks, transfers, ratio): fallback transfers against TRANSFER edges, none without edges."""
    f = seconds.agg(F.count_if("fallback").alias("fallbacks"))
    t = edges.agg(F.count_if(F.col("kind") == "TRANSFER").alias("transfers"))
    return f.crossJoin(F.broadcast(t)).select("fallbacks", "transfers", F.when(F.col("transfers") > 0, F.bround(F.col("fallbacks") / F.col("transfers"), 4)).otherwise(0.0).alias("ratio"))


def access_edges(stops: DataFrame, walk: DataFrame, metres: float = ACCESS_METRES) -> tuple[DataFrame, DataFrame]:
    """(ACCESS edges both ways between each stop and its nearest walk node in reach, stops without one)."""
    near = nearest(stops.select(F.col("id").alias("stop"), F.col("x").alias("lx"), F.col("y").alias("ly")), walk.select(F.col("id").alias("node"), F.col("x").alias("rx"), F.col("y").alias("ry")), metres, "stop", "node")
    near = near.join(stops.select(F.col("id").alias("stop"), "mode"), "stop")
    ways = near.select("distance", "mode", F.explode(F.array(F.struct(F.col("stop").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("stop").alias("b")))).alias("w"))
    edges = _edge(ways, F.col("w.a"), F.col("w.b"), "ACCESS", F.col("mode"), walk_seconds(F.col("distance")), distance=F.col("distance"))
    return edges, stops.join(near.select(F.col("stop").alias("id")), "id", "left_anti")


@dataclass(frozen=True)
class Part:
    """Nodes and edges of one mode. Where ``places`` in reach are given, the edges between the WALK nodes at them aren't in ``edges``, but
    follow from them (``walks_between``)."""

    nodes: DataFrame
    edges: DataFrame
    places: DataFrame | None = None


def joined(*parts: Part) -> Part:
    nodes, edges = parts[0].nodes, parts[0].edges
    for p in parts[1:]:
        nodes, edges = nodes.unionByName(p.nodes), edges.unionByName(p.edges)
    return Part(nodes, edges)


def subway(stations: DataFrame, served: DataFrame, legs: DataFrame, waits: DataFrame, walks: DataFrame | None, transfers: DataFrame) -> tuple[Part, DataFrame]:
    """(the subway's part, transfer seconds) of stations (source_id, name, x, y), platforms served (source_id, line),
    legs (line, a, b, seconds), waits (source_id, line, by_hour), platform walks (source_id, line, sec) and transfers.

    What several kinds of edges are made from is written once: stops, platforms with their prices, transfer seconds.
    """
    stops = written(stop_nodes(stations, "SUBWAY"), "subway-stops")
    platforms = written(platform_nodes(served, stops, "SUBWAY"), "subway-platforms")
    here = platforms.select("source_id", "line")
    priced = written(priced_platforms(here.join(waits.select("source_id", "line", "by_hour"), ["source_id", "line"], "left"), walks), "subway-prices")
    board, alight = board_edges(priced, None, "SUBWAY")
    seconds = written(transfer_seconds(here.withColumnRenamed("source_id", "station"), transfers), "transfer-seconds")
    known = legs.join(here.select("line", F.col("source_id").alias("a")), ["line", "a"], "left_semi").join(here.select("line", F.col("source_id").alias("b")), ["line", "b"], "left_semi")
    edges = board.unionByName(alight).unionByName(ride_edges(known, "SUBWAY")).unionByName(transfer_edges(seconds, priced, "SUBWAY"))
    return Part(stops.unionByName(platforms), edges), seconds


def city_routes(routes: DataFrame) -> DataFrame:
    """Bus routes (route, name, type) without the excluded types; a route without a type stays."""
    return routes.where(F.col("type").isNull() | ~F.col("type").isin(*EXCLUDED_ROUTES))


def route_headways(by_number: DataFrame, numbers: DataFrame) -> DataFrame:
    """(route, seconds) of headways (number, minutes) through the register (number, route) of route ids; of a route that
    comes again the last by ``ord`` counts, and without a headway over zero there is none."""
    sec = F.col("minutes").try_cast("double") * 60
    both = by_number.join(numbers, "number").withColumn("seconds", sec.cast("int")).where(sec > 0)
    return both.groupBy("route").agg(F.max_by("seconds", "ord").alias("seconds"))


def sheet_headways(headways: DataFrame, routes: DataFrame) -> DataFrame:
    """(route, seconds) of a day type's sheet of headways and the sheet of route ids, as ``sources.sheets.sheet`` reads them."""
    by_number = headways.select(F.trim("노선번호").alias("number"), F.col("배차간격").alias("minutes"))
    return route_headways(by_number, routes.select(F.trim("노선명").alias("number"), F.trim("ROUTEID").alias("route"), F.col("_row").alias("ord")))


def bus(sections: DataFrame, stops: DataFrame, headways: DataFrame) -> Part:
    """The buses' part of sections (route, a, b, by_hour), stops (source_id, name, x, y) and headways (route, seconds).

    A stop is on the street: boarding is the wait alone, alighting a second, and there are no transfers but
    by boarding again. Routes without a headway and sections with a stop without a place are left out.
    """
    located = stops.where("x IS NOT NULL AND y IS NOT NULL")
    at = located.select("source_id").distinct()
    known = sections.join(headways.select("route"), "route", "left_semi").join(at.withColumnRenamed("source_id", "a"), "a", "left_semi").join(at.withColumnRenamed("source_id", "b"), "b", "left_semi")
    legs = written(known.withColumnRenamed("route", "line"), "bus-legs")
    served = legs.select("line", F.explode(F.array("a", "b")).alias("source_id")).distinct()
    used = written(stop_nodes(located.join(served.select("source_id").distinct(), "source_id", "left_semi"), "BUS"), "bus-stops")
    platforms = written(platform_nodes(served, used, "BUS"), "bus-platforms")
    served = platforms.select("line", "source_id")
    waits = served.join(headways.withColumnRenamed("route", "line"), "line").withColumn("wait", board_wait(F.col("seconds")))
    stop, platform = node_id("STOP", F.lit("BUS"), F.col("source_id"), F.lit("")), node_id("PLATFORM", F.lit("BUS"), F.col("source_id"), F.col("line"))
    board = _edge(waits, stop, platform, "BOARD", F.lit("BUS"), F.col("wait"), F.col("line"))
    alight = _edge(waits, platform, stop, "ALIGHT", F.lit("BUS"), F.lit(BUS_ALIGHT), F.col("line"))
    return Part(used.unionByName(platforms), board.unionByName(alight).unionByName(ride_edges(legs, "BUS")))


def isolated(nodes: DataFrame, edges: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """Nodes that no edge touches, those of ``walks`` (src, as ``walk_sums``) included."""
    touched = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    if walks is not None:
        touched = touched.union(walks.select(F.col("src").alias("id"))).distinct()
    return nodes.join(touched, "id", "left_anti")


def counts(nodes: DataFrame, edges: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """(what, kind, mode, count) of nodes and edges; an edge has the mode of the stop that it serves, else WALK.
    Walk edges may be given by their sums (``walk_sums``)."""
    both = nodes.select(F.lit("NODE").alias("what"), "kind", "mode").unionByName(edges.select(F.lit("EDGE").alias("what"), "kind", "mode"))
    out = both.groupBy("what", "kind", "mode").agg(F.count("*").alias("count"))
    if walks is None:
        return out
    more = walks.agg(F.sum("degree").alias("count")).where("count > 0").select(F.lit("EDGE").alias("what"), F.lit("WALK").alias("kind"), F.lit("WALK").alias("mode"), "count")
    return out.unionByName(more).groupBy("what", "kind", "mode").agg(F.sum("count").alias("count"))


def heads(edges: DataFrame, walks: DataFrame | None = None) -> DataFrame:
    """(node, degree, head): where each node's edges begin in an array sorted by source. Walk edges may be given by their sums.

    Sums run over the 4,096 ranges of ids first and inside each range then, so that no task has all nodes.
    """
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    if walks is not None:
        degree = degree.unionByName(walks.select(F.col("src").alias("node"), "degree")).groupBy("node").agg(F.sum("degree").alias("degree"))
    degree = degree.withColumn("block", F.shiftright("node", ID_BITS - BLOCK_BITS))
    blocks = degree.groupBy("block").agg(F.sum("degree").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("degree").over(W.partitionBy("block").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return degree.join(F.broadcast(blocks.select("block", "before")), "block").select("node", "degree", (F.col("before") + inside).alias("head"))


def open_edges(edges: DataFrame, hour: int | None) -> DataFrame:
    """(src, dst, w) of the edges that run in an hour."""
    w = F.col("weight_sec") if hour is None else F.coalesce(F.get("by_hour", F.lit(hour)), F.col("weight_sec"))
    return edges.select("src", "dst", w.cast("long").alias("w")).where("w >= 0")


def walk_speed(nodes: DataFrame, metres: float) -> DataFrame:
    """One row (speed, n) of the walk edges that ``walks_within`` makes of WALK nodes (id, x, y), as ``max_speed`` has it of edges.

    Places are joined and never the nodes at them. An id is at one place; one that comes again stands at both ends of its edges as often.
    """
    own = nodes.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "x", "y").groupBy("x", "y", "id").agg((F.count("*") * F.count("*")).alias("t"))
    at = own.groupBy("x", "y").agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t")).alias("loops"))
    pairs = within(at.select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("n").alias("a"), "loops"), at.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("n").alias("b")), metres)
    here = (F.col("lx") == F.col("rx")) & (F.col("ly") == F.col("ry"))
    made = pairs.withColumn("n", F.col("a") * F.col("b") - F.when(here, F.col("loops")).otherwise(0)).where("n > 0")
    return made.agg(F.max(F.col("distance") / walk_seconds(F.col("distance"))).alias("speed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def max_speed(nodes: DataFrame, edges: DataFrame, hour: int | None, walks: DataFrame | None = None) -> DataFrame:
    """One row (speed, n): the fastest of the n edges that run in an hour and take time, in metres a second between their ends.
    Walk edges may be given by their own row (``walk_speed``)."""
    p = nodes.select("id", "x", "y")
    both = open_edges(edges, hour).where("w > 0").join(p.toDF("src", "ax", "ay"), "src").join(p.toDF("dst", "bx", "by"), "dst")
    out = both.agg(F.max(planar(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) / F.col("w")).alias("speed"), F.count("*").alias("n"))
    return out if walks is None else out.unionByName(walks).agg(F.max("speed").alias("speed"), F.sum("n").alias("n"))


def repaired(stops: DataFrame, fixes: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """(stops with the coordinates of known bad ones replaced, how many fixes applied, fixes whose stop isn't there)."""
    f = fixes.select("source_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    joined_ = stops.join(F.broadcast(f), "source_id", "left")
    out = joined_.select(*[F.coalesce("_" + c, c).alias(c) if c in ("x", "y") else F.col(c) for c in stops.columns])
    return out, fixes.join(stops, "source_id", "left_semi").count(), fixes.join(stops, "source_id", "left_anti")
