"""Rooms, members and bookmarks: capped arrivals, folds of events, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.operators import spatial

MEMBERS, BOOKMARKS, DAILY = 10, 30, 50_000


def capped(arrivals: DataFrame, key: str | list[str], order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` arrivals of each key, in order; the rest is turned away.

    Arrivals are cut to the cap within salted parts first, so that a busy key is never sorted in one task.
    """
    keys = [key] if isinstance(key, str) else key
    by = W.partitionBy(*keys, "_part").orderBy(*order)
    parts = arrivals.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(32))).withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= cap)
    return parts.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= cap).drop("_part", "_k")


def daily_cap(rows: DataFrame, ts: str, order: str, cap: int = DAILY, zone: str = "Asia/Seoul") -> DataFrame:
    """At most ``cap`` rows for each local day."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    return capped(rows.withColumn("local_day", day), "local_day", [ts, order], cap)


def next_owner(members: DataFrame, leaving: DataFrame) -> DataFrame:
    """(room_id, user_id) of the earliest member who stays, for each room whose owner left; none: no row."""
    rest = members.join(leaving, ["room_id", "user_id"], "left_anti")
    return rest.groupBy("room_id").agg(F.min_by("user_id", F.struct("joined_at", "user_id")).alias("user_id"))


def left(rooms: DataFrame, members: DataFrame, bookmarks: DataFrame, leaving: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rooms, members and bookmarks after members (room_id, user_id) left at once.

    A room that nobody stays in goes with its bookmarks; one whose owner left gets the earliest member
    who stays. Bookmarks of those who left stay with the room.
    """
    stay = members.join(leaving, ["room_id", "user_id"], "left_anti")
    gone = members.select("room_id").distinct().join(stay.select("room_id").distinct(), "room_id", "left_anti")
    heirs = next_owner(members, leaving).withColumnRenamed("user_id", "_heir")
    lost = leaving.select("room_id", F.col("user_id").alias("owner_id")).distinct().withColumn("_lost", F.lit(True))
    kept = rooms.join(gone, "room_id", "left_anti").join(lost, ["room_id", "owner_id"], "left").join(heirs, "room_id", "left")
    owner = F.when(F.col("_lost"), F.col("_heir")).otherwise(F.col("owner_id")).alias("owner_id")
    return kept.select(*[owner if c == "owner_id" else F.col(c) for c in rooms.columns]), stay, bookmarks.join(gone, "room_id", "left_anti")


#: What an event did: (room_id, seq, outcome, owner_id, members after it in the order of joining).
FOLDED = "outcome string, owner_id long, members array<long>"


def happened(members: list[int], owner: int | None, open_: bool, user: int, action: str, cap: int) -> tuple[str, list[int], int | None, bool]:
    """(outcome, members, owner, whether the room is there) after one event in a room."""
    if not open_:
        return "NOT_FOUND", members, owner, open_
    if action == "JOIN":
        if user in members:
            return "AGAIN", members, owner, open_
        if len(members) >= cap:
            return "FULL", members, owner, open_
        return ("CREATED" if owner is None else "JOINED"), [*members, user], user if owner is None else owner, open_
    if user not in members:
        return "NOT_A_MEMBER", members, owner, open_
    rest = [m for m in members if m != user]
    if not rest:
        return "DELETED", rest, None, False
    if user == owner:
        return "HANDED_OVER", rest, rest[0], open_
    return "LEFT", rest, owner, open_


def folded(events: DataFrame, cap: int = MEMBERS) -> DataFrame:
    """Events (room_id, seq, user_id, action JOIN or LEAVE, ...) with what each did: outcome, owner_id and members after it.

    Events of a room take effect in the order of ``seq``, then user_id and action. The first to join opens the room
    and owns it; a member who joins again changes nothing; a full room turns others away, and a seat that was left is free again.
    An owner who leaves hands over to whoever has been in the room longest; with the last member the room goes, for
    good. Leaving a room one isn't in does nothing. Events without a room, user, place or known action are left out.

    Rows stream by in order, and a task holds one room's members, at most ``cap``: a busy room is long, but never large.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(FOLDED).fields
    known = events.where("room_id IS NOT NULL AND seq IS NOT NULL AND user_id IS NOT NULL AND action IN ('JOIN', 'LEAVE')")
    packed = known.select(F.col("room_id").cast("long").alias("room"), "seq", F.col("user_id").cast("long").alias("user"), "action", F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("row"))

    def run(batches):
        room, members, owner, open_ = None, [], None, True
        for batch in batches:
            out = []
            for r, user, action in zip(*(batch.column(c).to_pylist() for c in ("room", "user", "action"))):
                if r != room:
                    room, members, owner, open_ = r, [], None, True
                outcome, members, owner, open_ = happened(members, owner, open_, user, action, cap)
                out.append((outcome, owner, members))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int64())))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *[f.name for f in fields]])

    dealt = packed.repartition("room").sortWithinPartitions("room", "seq", "user", "action")
    out = dealt.mapInArrow(run, T.StructType([packed.schema["row"], *fields]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in events.columns if c not in {f.name for f in fields}], *[f.name for f in fields])


def standing(outcomes: DataFrame) -> DataFrame:
    """(room_id, owner_id, members) of the rooms that are there after folded events; deleted ones have no row."""
    last = outcomes.where("outcome <> 'NOT_FOUND'").groupBy("room_id").agg(F.max_by(F.struct("owner_id", "members"), F.struct("seq", "user_id", "action")).alias("l"))
    return last.select("room_id", "l.*").where("size(members) > 0")


def resnapped(members: DataFrame, nodes: DataFrame, build_id: int, radius: float = 2000.0) -> DataFrame:
    """Members whose origin (x, y) belongs to another build get the nearest node (id, x, y) of this one.

    Node ids of different builds mean different places, so that the build decides and not whether the id
    exists. Without a node in reach the origin is of this build and has no node.
    """
    stale = F.col("x").isNotNull() & ~F.col("origin_build_id").eqNullSafe(F.lit(build_id))
    at = members.where(stale).select("user_id", "room_id", F.col("x").alias("lx"), F.col("y").alias("ly"))
    at = at.withColumn("_member", F.struct("room_id", "user_id"))
    found = spatial.nearest(at, nodes.select(F.col("id").alias("node"), F.col("x").alias("rx"), F.col("y").alias("ry")), radius, "_member", "node")
    new = found.select("_member.room_id", "_member.user_id", "node", F.col("distance").alias("_snap"))
    joined = members.join(new, ["room_id", "user_id"], "left").withColumn("_stale", stale)
    changed = {"origin_node_id": F.col("node"), "origin_snap_m": F.col("_snap"), "origin_build_id": F.lit(build_id)}
    return joined.select(*[F.when(F.col("_stale"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in members.columns])


def last_activity(rooms: DataFrame, members: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(room_id, at): the latest of what happened in each room; what didn't happen is skipped."""
    m = members.groupBy("room_id").agg(F.max(F.greatest("joined_at", "origin_set_at")).alias("m"))
    b = bookmarks.groupBy("room_id").agg(F.max("created_at").alias("b"))
    return rooms.join(m, "room_id", "left").join(b, "room_id", "left").select("room_id", F.greatest("created_at", "m", "b").alias("at"))


def room_view(members: DataFrame, bookmarks: DataFrame, build_id: int) -> DataFrame:
    """(room_id, members, origins, stale, bookmarks, ready): origins of another build are stale."""
    m = members.groupBy("room_id").agg(F.count("*").alias("members"), F.count("origin_node_id").alias("origins"), F.count_if(F.col("origin_build_id") != build_id).alias("stale"))
    b = bookmarks.groupBy("room_id").agg(F.count("*").alias("bookmarks"))
    out = m.join(b, "room_id", "left").withColumn("bookmarks", F.coalesce("bookmarks", F.lit(0)))
    return out.withColumn("ready", (F.col("origins") > 0) & (F.col("bookmarks") > 0))


def deletable(bookmarks: DataFrame, rooms: DataFrame, user: Column) -> DataFrame:
    """Bookmarks that a user may delete: their own, and all of their rooms."""
    owners = rooms.select("room_id", "owner_id")
    return bookmarks.join(owners, "room_id").where((F.col("added_by") == user) | (F.col("owner_id") == user)).drop("owner_id")


def frozen(bookmarks: DataFrame, places: DataFrame) -> DataFrame:
    """New bookmarks with the place's name and coordinates as they are now; later changes don't reach them."""
    at = places.select(F.col("id").alias("poi_id"), F.col("name"), F.col("x"), F.col("y"))
    return bookmarks.join(at, "poi_id")


def anonymised(users: DataFrame, gone: DataFrame) -> DataFrame:
    """Users with the names of those who left removed."""
    left = gone.select("user_id", F.lit(True).alias("_gone"))
    j = users.join(left, "user_id", "left")
    name = F.when(F.col("_gone"), F.concat(F.lit("withdrawn "), F.col("user_id").cast("string"))).otherwise(F.col("name"))
    return j.withColumn("name", name).drop("_gone")


def limited(requests: DataFrame, key: str, ts: str, limit: int, window_s: int) -> DataFrame:
    """Requests with ``allowed``: fixed windows that begin at a key's first request outside the one before.

    A request without a time is in no window: it isn't allowed, and counts for nothing. Requests without a key are one key.

    A window's end depends on where the one before ended, so that rows of a key are folded in order as
    they stream by; only the state of one key is held.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun, n = object(), None, 0
        for batch in batches:
            out = []
            for k, t, refused in zip(batch.column("_k").to_pylist(), batch.column("_t").to_pylist(), batch.column("_uncounted").to_pylist()):
                if t is None:
                    out.append(False)
                    continue
                if k != at or t >= begun + window_s:
                    at, begun, n = k, t, 0
                out.append(n < limit)
                n += not refused and n < limit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], [*batch.schema.names, "allowed"])

    uncounted = F.col("uncounted") if "uncounted" in requests.columns else F.lit(False)
    rows = requests.withColumn("_k", F.col(key).cast("string")).withColumn("_t", F.unix_seconds(F.col(ts).cast("timestamp"))).withColumn("_uncounted", uncounted)
    rows = rows.repartition("_k").sortWithinPartitions("_k", "_t", *[c for c in requests.columns if c != key and c != ts])
    from pyspark.sql.types import BooleanType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("allowed", BooleanType())])).drop("_k", "_t", "_uncounted")
