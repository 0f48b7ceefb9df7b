"""Distance joins over points in metres, by grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions.crs import planar
from waymill.scratch import written

MAX_RADIUS, DEFAULT_RADIUS, MAX_LIMIT, DEFAULT_LIMIT = 10_000, 2_000, 200, 50

#: Points of a block, boxes that are sent to all tasks (160 kB), and what rounding may add to a square.
BLOCK, BOXES, SLACK = 256, 4096, 1 + 1e-9


def clamped(radius: int | None, limit: int | None) -> tuple[int, int]:
    """Search parameters in their allowed ranges; zero and none take the defaults."""
    return min(radius or DEFAULT_RADIUS, MAX_RADIUS), min(limit or DEFAULT_LIMIT, MAX_LIMIT)


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def _apart(v: Column) -> Column:
    """The bits of a number below 2**26 with a gap before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def placed(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with finite coordinates."""
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")  # noqa: E731 - false for infinity and, since NaN is the largest, for NaN
    return df.where(finite(x) & finite(y))


def blocks(df: DataFrame, x: str, y: str, size: int, order: str) -> DataFrame:
    """Rows with finite coordinates with ``block``, a number of neighbours: about ``size`` rows each, in the order of a
    curve that passes through squares of squares (ties by ``order``). The table is written, so that blocks stay what they are."""
    box = df.agg(F.count("*").alias("n"), F.min(x).alias("x"), F.max(x).alias("x1"), F.min(y).alias("y"), F.max(y).alias("y1")).first()
    side = max(box.x1 - box.x, box.y1 - box.y, 1e-9) if box.n else 1.0
    steps = lambda c, least: F.least(F.floor((F.col(c) - F.lit(least or 0.0)) / side * float(1 << 26)).cast("long"), F.lit((1 << 26) - 1))
    code = F.shiftleft(_apart(steps(y, box.y)), 1).bitwiseOR(_apart(steps(x, box.x)))
    ranged = df.withColumn("_code", code).repartitionByRange(max(1, -(-box.n // size)), "_code", order)
    return written(ranged.withColumn("block", F.spark_partition_id()).drop("_code"), "blocks")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (lx, ly, ...) and right (rx, ry, ...) no further apart than the radius, with ``distance``.

    The cell of a point is its square of the radius' size. Each left row meets the nine cells
    around it, so that the join is on equal cells and neither side is broadcast unless Spark finds it small.
    """
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = left.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    spread = spread.withColumn("_cx", cell(F.col("lx"), radius) + F.col("_dx")).withColumn("_cy", cell(F.col("ly"), radius) + F.col("_dy")).drop("_dx", "_dy")
    celled = right.withColumn("_cx", cell(F.col("rx"), radius)).withColumn("_cy", cell(F.col("ry"), radius))
    joined = spread.join(celled, ["_cx", "_cy"]).withColumn("distance", planar(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")))
    return joined.where(F.col("distance") <= radius).drop("_cx", "_cy")


def places(right: DataFrame, right_key: str) -> DataFrame:
    """(rx, ry, smallest key) of right rows: of those at one place no other can be the nearest."""
    return right.where(F.col(right_key).isNotNull()).groupBy("rx", "ry").agg(F.min(right_key).alias(right_key))


def distinct_places(left: DataFrame) -> DataFrame:
    """(lx, ly) of left rows once each, in as many tasks as there are cores: few bytes that much work follows from."""
    return left.select("lx", "ly").repartition(2 * left.sparkSession.sparkContext.defaultParallelism, "lx", "ly").distinct()


def nearest(left: DataFrame, right: DataFrame, radius: float, left_key: str, right_key: str) -> DataFrame:
    """For each left row with one in reach the nearest right row; of equals the smallest key.

    A place is searched once, however many rows of either side are there: the work follows the places, and rows meet
    what their place has found by equal coordinates.
    """
    given = left.select(left_key, F.col("lx").cast("double").alias("lx"), F.col("ly").cast("double").alias("ly"))
    pairs = within(distinct_places(given), places(right, right_key), radius)
    best = pairs.groupBy("lx", "ly").agg(F.min_by(F.struct(right_key, "distance"), F.struct("distance", right_key)).alias("_b"))
    return _shared(given, best, left_key, right_key)


def sums_within(left: DataFrame, right: DataFrame, radius: float, left_key: str) -> DataFrame:
    """(left key, n, mean): how many right rows (rx, ry) each left row has in reach, and how far they are on average. Rows without one are left out.

    Places meet, those of right rows with their number of rows, so that the work follows the places and not the pairs of rows.
    """
    there = right.groupBy("rx", "ry").agg(F.count("*").alias("_n"))
    pairs = within(distinct_places(left), there, radius)
    sums = pairs.groupBy("lx", "ly").agg(F.sum("_n").alias("n"), F.sum(F.col("distance") * F.col("_n")).alias("_far"))
    return left.join(sums, ["lx", "ly"]).select(left_key, "n", (F.col("_far") / F.col("n")).alias("mean"))


def _shared(left: DataFrame, best: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left key, right key, distance) of left rows by the best ``_b`` of their place (lx, ly), the nearest of a repeated key's."""
    every = left.join(best, ["lx", "ly"])
    every = every.groupBy(left_key).agg(F.min_by("_b", F.struct("_b.distance", f"_b.{right_key}")).alias("_b"))
    return every.select(left_key, F.col(f"_b.{right_key}").alias(right_key), F.col("_b.distance").alias("distance"))


def _box(columns: tuple[str, str, str, str]) -> list[Column]:
    """The box around what a group has: least and greatest x and y."""
    return [f(c).alias(a) for f, c, a in zip((F.min, F.max, F.min, F.max), columns, ("x0", "x1", "y0", "y1"))]


def _spans(over, x, y, x0, x1, y0, y1):
    """(least, surely): squares of distances between points and boxes whose four sides are each touched by a point.

    Nothing in a box is nearer than the first, and something is as near as the second: a point on the nearer of two
    opposite sides, wherever it is on that side. ``over`` has ``least``, ``greatest`` and ``abs`` of arrays or Columns.
    """
    ax, bx, ay, by = over.abs(x - x0), over.abs(x - x1), over.abs(y - y0), over.abs(y - y1)
    out_x, out_y = over.greatest(over.greatest(x0 - x, x - x1), 0 * ax), over.greatest(over.greatest(y0 - y, y - y1), 0 * ay)
    side_x = over.least(ax, bx) * over.least(ax, bx) + over.greatest(ay, by) * over.greatest(ay, by)
    side_y = over.least(ay, by) * over.least(ay, by) + over.greatest(ax, bx) * over.greatest(ax, bx)
    return out_x * out_x + out_y * out_y, over.least(side_x, side_y)


class _Arrays:
    least, greatest, abs = np.minimum, np.maximum, np.abs


def _in_reach(left: DataFrame, boxes: DataFrame) -> DataFrame:
    """``left`` with ``_big``, a row for each of at most BOXES boxes that may hold the nearest point."""
    given = boxes.toPandas()
    shared = left.sparkSession.sparkContext.broadcast([given[c].to_numpy() for c in ("_big", "x0", "x1", "y0", "y1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, *sides = shared.value
        step = max(1, 4_000_000 // max(1, len(number)))
        for batch in batches:
            for i in range(0, batch.num_rows if len(number) else 0, step):
                some = batch.slice(i, step)
                x, y = (some.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("lx", "ly"))
                least, surely = _spans(_Arrays, x, y, *sides)
                row, box = np.nonzero(least <= surely.min(axis=1, keepdims=True) * SLACK)
                taken = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(number[box].astype(np.int64))], [*some.schema.names, "_big"])

    return left.mapInArrow(run, T.StructType([*left.schema.fields, T.StructField("_big", T.LongType())]))


def nearest_any(left: DataFrame, right: DataFrame, left_key: str, right_key: str, size: int = BLOCK) -> DataFrame:
    """The nearest right row however far, of equals the smallest key.

    Right points are dealt to blocks of neighbours of about ``size``, and those to at most BOXES groups. From the boxes around
    groups each left row gets those that may hold its nearest point, from the boxes around their blocks likewise, and
    meets the points of those blocks alone: joins on keys at any distance, none of all with all. As many blocks as there may be
    groups are their own groups, and a place is searched once, however many rows are there. Rows with a null, NaN or
    infinite coordinate or a null key have no nearest row and are none; without right rows there is no row.
    """
    fine = blocks(places(placed(right, "rx", "ry"), right_key), "rx", "ry", size, right_key)
    last = fine.agg(F.max("block")).first()[0]
    per = 1 if last is None else -(-(last + 1) // BOXES)
    boxes = written(fine.groupBy("block").agg(*_box(("rx", "rx", "ry", "ry"))).withColumn("_big", F.expr(f"block div {per}")), "boxes")
    big = boxes.groupBy("_big").agg(*_box(("x0", "x1", "y0", "y1")))
    given = placed(left, "lx", "ly").where(F.col(left_key).isNotNull()).select(left_key, F.col("lx").cast("double").alias("lx"), F.col("ly").cast("double").alias("ly"))
    near = _in_reach(distinct_places(given), big)
    if per == 1:
        near = near.select("lx", "ly", F.col("_big").alias("block"))
    else:
        least, surely = _spans(F, *(F.col(c) for c in ("lx", "ly", "x0", "x1", "y0", "y1")))
        met = near.join(boxes, "_big").select("lx", "ly", "block", least.alias("least"), surely.alias("surely"))
        met = met.groupBy("lx", "ly").agg(F.min("surely").alias("surely"), F.collect_list(F.struct("least", "block")).alias("b"))
        near = met.select("lx", "ly", F.explode(F.filter("b", lambda b: b["least"] <= F.col("surely") * SLACK)).alias("b")).select("lx", "ly", "b.block")
    pairs = near.join(fine, "block").withColumn("distance", planar(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")))
    best = pairs.groupBy("lx", "ly").agg(F.min_by(F.struct(right_key, "distance"), F.struct("distance", right_key)).alias("_b"))
    return _shared(given, best, left_key, right_key)


def around(points: DataFrame, x: float, y: float, radius: int | None = None, limit: int | None = None) -> DataFrame:
    """The nearest points (x, y, id) about one place: a box the scan can use, then the exact distance."""
    radius, limit = clamped(radius, limit)
    box = points.where(F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius))
    out = box.withColumn("distance", planar(F.col("x"), F.col("y"), F.lit(float(x)), F.lit(float(y))))
    return out.where(F.col("distance") <= radius).orderBy("distance", "id").limit(limit)


def in_box(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a point is in the box; null coordinates give null."""
    return x.between(west, east) & y.between(south, north)


