"""Queries of rooms, members and bookmarks, made of orders and events."""

from uuid import uuid4

from pyspark.sql import functions as F

from waymill.operators import rooms as op
from waymill.plans.derived import points, points_sql
from waymill.plans.registry import SQL, query, table
from waymill.scratch import shared_dir

_MEMBERS = "SELECT user_id % 40 AS room_id, user_id, min(ts) AS joined_at, max(CASE WHEN event_type = 'click' THEN ts END) AS origin_set_at, max(CASE WHEN event_type = 'purchase' THEN event_id % 900 END) AS origin_node_id, max(CASE WHEN event_type = 'purchase' THEN event_id % 3 END) AS origin_build_id FROM events GROUP BY ALL"
_BOOKMARKS = "SELECT event_id AS id, user_id % 40 AS room_id, user_id AS added_by, event_id % 500 AS poi_id, ts AS created_at FROM events WHERE event_type = 'view'"
_ROOMS = "SELECT user_id % 40 AS room_id, min(user_id) AS owner_id, min(ts) AS created_at FROM events GROUP BY 1"


def _second():
    """``ts`` to the nearest second, of two the even one, as a cast of its epoch to whole seconds gives it in the SQL."""
    return F.timestamp_seconds(F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))


def _members(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    buys = F.col("event_type") == "purchase"
    return e.groupBy((F.col("user_id") % 40).alias("room_id"), "user_id").agg(
        F.min("ts").alias("joined_at"),
        F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("origin_set_at"),
        F.max(F.when(buys, F.col("event_id") % 900)).alias("origin_node_id"),
        F.max(F.when(buys, F.col("event_id") % 3)).alias("origin_build_id"),
    )


def _bookmarks(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.selectExpr("event_id AS id", "user_id % 40 AS room_id", "user_id AS added_by", "event_id % 500 AS poi_id", "ts AS created_at")


def _rooms(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("room_id")).agg(F.min("user_id").alias("owner_id"), F.min("ts").alias("created_at"))


@query(f"SELECT room_id, id FROM (SELECT room_id, id, row_number() OVER (PARTITION BY room_id ORDER BY created_at, id) AS k FROM ({_BOOKMARKS})) WHERE k <= 30")
def room_capacity(spark, sf_dir):
    return op.capped(_bookmarks(spark, sf_dir), "room_id", ["created_at", "id"], op.BOOKMARKS).select("room_id", "id")


@query(f"SELECT m.*, coalesce(b.bookmarks, 0) AS bookmarks, m.origins > 0 AND coalesce(b.bookmarks, 0) > 0 AS ready FROM (SELECT room_id, count(*) AS members, count(origin_node_id) AS origins, count(*) FILTER (origin_build_id <> 2) AS stale FROM ({_MEMBERS}) GROUP BY 1) m LEFT JOIN (SELECT room_id, count(*) AS bookmarks FROM ({_BOOKMARKS}) GROUP BY 1) b USING (room_id)")
def room_view(spark, sf_dir):
    return op.room_view(_members(spark, sf_dir), _bookmarks(spark, sf_dir), 2)


@query(f"SELECT r.room_id, r.owner_id, m.user_id, r.owner_id = m.user_id AS is_mine, n.members FROM ({_ROOMS}) r JOIN ({_MEMBERS}) m USING (room_id) JOIN (SELECT room_id, count(*) AS members FROM ({_MEMBERS}) GROUP BY 1) n USING (room_id)")
def my_rooms(spark, sf_dir):
    m = _members(spark, sf_dir).select("room_id", "user_id")
    n = m.groupBy("room_id").agg(F.count("*").alias("members"))
    out = _rooms(spark, sf_dir).join(m, "room_id").join(n, "room_id")
    return out.select("room_id", "owner_id", "user_id", (F.col("owner_id") == F.col("user_id")).alias("is_mine"), "members")


@query(f"SELECT room_id, user_id FROM (SELECT room_id, user_id, row_number() OVER (PARTITION BY room_id ORDER BY joined_at, user_id) AS k FROM ({_MEMBERS}) m WHERE (room_id, user_id) NOT IN (SELECT (room_id, owner_id) FROM ({_ROOMS}))) WHERE k = 1")
def next_owner(spark, sf_dir):
    return op.next_owner(_members(spark, sf_dir), _rooms(spark, sf_dir).select("room_id", F.col("owner_id").alias("user_id")))


@query(f"SELECT room_id, greatest(r.created_at, m.m, b.b) AS at FROM ({_ROOMS}) r LEFT JOIN (SELECT room_id, max(greatest(joined_at, origin_set_at)) AS m FROM ({_MEMBERS}) GROUP BY 1) m USING (room_id) LEFT JOIN (SELECT room_id, max(created_at) AS b FROM ({_BOOKMARKS}) GROUP BY 1) b USING (room_id)")
def last_activity(spark, sf_dir):
    return op.last_activity(_rooms(spark, sf_dir), _members(spark, sf_dir), _bookmarks(spark, sf_dir))


@query("SELECT local_day, event_id FROM (SELECT (ts + INTERVAL 9 HOUR)::DATE AS local_day, event_id, row_number() OVER (PARTITION BY (ts + INTERVAL 9 HOUR)::DATE ORDER BY ts, event_id) AS k FROM events) WHERE k <= 50")
def daily_cap(spark, sf_dir):
    return op.daily_cap(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id", 50).select("local_day", "event_id")


@query(f"SELECT b.id, b.room_id FROM ({_BOOKMARKS}) b JOIN ({_ROOMS}) r USING (room_id) WHERE b.added_by = 7 OR r.owner_id = 7 OR r.owner_id = 7")
def bookmark_permission(spark, sf_dir):
    return op.deletable(_bookmarks(spark, sf_dir), _rooms(spark, sf_dir), F.lit(7)).select("id", "room_id")


@query(f"SELECT b.id, b.poi_id, p_name AS name, (p_partkey * 7919 % 60000 + 170000)::DOUBLE AS x FROM ({_BOOKMARKS}) b JOIN part ON p_partkey = b.poi_id")
def bookmark_snapshot(spark, sf_dir):
    from waymill.plans.derived import points

    return op.frozen(_bookmarks(spark, sf_dir), points(spark, sf_dir, "part")).select("id", "poi_id", "name", "x")


@query("SELECT c_custkey AS user_id, CASE WHEN c_acctbal < 0 THEN 'withdrawn ' || c_custkey ELSE c_name END AS name FROM customer")
def anonymised_users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return op.anonymised(c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, t AS begun, 1 AS n, true AS allowed FROM e WHERE k = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t >= r.begun + 86400 THEN e.t ELSE r.begun END, CASE WHEN e.t >= r.begun + 86400 THEN 1 ELSE least(3, r.n + 1) END, e.t >= r.begun + 86400 OR r.n < 3 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, allowed FROM r""")
def rate_limit_fixed_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", _second().alias("ts"), "event_id")
    return op.limited(e, "user_id", "ts", 3, 86_400).select("user_id", "event_id", "allowed")


@query(f"""WITH m AS ({_MEMBERS}), r AS ({_ROOMS}), b AS ({_BOOKMARKS}), stay AS (SELECT * FROM m WHERE NOT (user_id % 3 = 0 OR room_id % 7 = 0)),
heirs AS (SELECT room_id, arg_min(user_id, (joined_at, user_id)) AS heir, count(*) AS members FROM stay GROUP BY 1), n AS (SELECT room_id, count(*) AS bookmarks FROM b GROUP BY 1)
SELECT room_id, CASE WHEN owner_id % 3 = 0 OR room_id % 7 = 0 THEN heir ELSE owner_id END AS owner_id, members, coalesce(bookmarks, 0) AS bookmarks FROM r JOIN heirs USING (room_id) LEFT JOIN n USING (room_id)""")
def rooms_left(spark, sf_dir):
    m = _members(spark, sf_dir)
    rooms, stay, marks = op.left(_rooms(spark, sf_dir), m, _bookmarks(spark, sf_dir), m.where("user_id % 3 = 0 OR room_id % 7 = 0").select("room_id", "user_id"))
    members = stay.groupBy("room_id").agg(F.count("*").alias("members"))
    marked = marks.groupBy("room_id").agg(F.count("*").alias("bookmarks"))
    return rooms.join(members, "room_id").join(marked, "room_id", "left").select("room_id", "owner_id", "members", F.coalesce("bookmarks", F.lit(0)).alias("bookmarks"))


@query(f"""WITH m AS (SELECT c_nationkey::BIGINT AS room_id, id AS user_id, x, y, id % 3 AS build, CASE WHEN id % 3 > 0 THEN id % 50 END AS node FROM {points_sql('customer')} JOIN customer ON c_custkey = id),
p AS (SELECT user_id, s.id AS node, sqrt((s.x - m.x) * (s.x - m.x) + (s.y - m.y) * (s.y - m.y)) AS d FROM m JOIN {points_sql('supplier')} s ON sqrt((s.x - m.x) * (s.x - m.x) + (s.y - m.y) * (s.y - m.y)) <= 2000),
n AS (SELECT user_id, arg_min(node, (d, node)) AS node, min(d) AS d FROM p GROUP BY 1)
SELECT room_id, user_id, CASE WHEN build = 2 THEN m.node ELSE n.node END AS origin_node_id, CASE WHEN build <> 2 THEN round(d, 6) END AS origin_snap_m, 2::BIGINT AS origin_build_id FROM m LEFT JOIN n USING (user_id)""")
def resnapped_origins(spark, sf_dir):
    c = points(spark, sf_dir, "customer").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), "id")
    m = c.select(F.col("c_nationkey").cast("long").alias("room_id"), F.col("id").alias("user_id"), "x", "y", F.expr("CASE WHEN id % 3 > 0 THEN id % 50 END").alias("origin_node_id"), F.lit(None).cast("double").alias("origin_snap_m"), F.expr("id % 3").alias("origin_build_id"))
    out = op.resnapped(m, points(spark, sf_dir, "supplier"), 2)
    return out.select("room_id", "user_id", "origin_node_id", F.round("origin_snap_m", 6).alias("origin_snap_m"), "origin_build_id")


#: Members come and go: an event of a user in a room is joining or leaving by its kind.
_COMES = ["event_id % 40 AS room_id", "event_id AS seq", "user_id % 23 AS user_id", "CASE WHEN event_type IN ('purchase', 'error') THEN 'LEAVE' ELSE 'JOIN' END AS action"]
_EVENTS_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY seq) AS k FROM (SELECT {', '.join(_COMES)} FROM events)),
f(room_id, k, members, owner, there, outcome) AS (SELECT DISTINCT room_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, true, '' FROM e UNION ALL
  SELECT room_id, k, CASE outcome WHEN 'CREATED' THEN list_append(members, user_id) WHEN 'JOINED' THEN list_append(members, user_id) WHEN 'LEFT' THEN rest WHEN 'HANDED_OVER' THEN rest WHEN 'DELETED' THEN rest ELSE members END,
    CASE outcome WHEN 'CREATED' THEN user_id WHEN 'HANDED_OVER' THEN rest[1] WHEN 'DELETED' THEN NULL ELSE owner END, there AND outcome <> 'DELETED', outcome
  FROM (SELECT e.room_id, e.k, members, owner, there, user_id, list_filter(members, lambda m: m <> user_id) AS rest, CASE WHEN NOT there THEN 'NOT_FOUND'
    WHEN action = 'JOIN' THEN CASE WHEN list_contains(members, user_id) THEN 'AGAIN' WHEN len(members) >= 10 THEN 'FULL' WHEN owner IS NULL THEN 'CREATED' ELSE 'JOINED' END
    WHEN NOT list_contains(members, user_id) THEN 'NOT_A_MEMBER' WHEN len(members) = 1 THEN 'DELETED' WHEN owner = user_id THEN 'HANDED_OVER' ELSE 'LEFT' END AS outcome FROM f JOIN e ON e.room_id = f.room_id AND e.k = f.k + 1))"""


def _comings(spark, sf_dir):
    return op.folded(table(spark, sf_dir, "events").selectExpr(*_COMES))


@query(f"{_EVENTS_SQL} SELECT e.room_id, seq, user_id, action, outcome, owner AS owner_id, members FROM f JOIN e ON e.room_id = f.room_id AND e.k = f.k")
def room_events(spark, sf_dir):
    """What each coming and going did, in the order of events."""
    return _comings(spark, sf_dir)


@query(f"{_EVENTS_SQL} SELECT room_id, owner AS owner_id, members FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY k DESC) AS last FROM f WHERE outcome <> 'NOT_FOUND') WHERE last = 1 AND len(members) > 0")
def rooms_standing(spark, sf_dir):
    return op.standing(_comings(spark, sf_dir))


@query(SQL["rate_limit_fixed_window"])
def rate_limit_stream(spark, sf_dir):
    """The same by a stream: events are dropped as files week by week, and each drop goes on where the last one ended."""
    from waymill.streaming.limits import drained, limited_stream

    place = f"{shared_dir(spark)}/requests-{uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), _second().alias("ts"), F.col("event_id").alias("id"))
    weeks = e.agg(F.collect_set(F.date_trunc("week", "ts")).alias("w")).first().w
    for week in sorted(weeks):
        e.where(F.date_trunc("week", "ts") == F.lit(week)).write.mode("append").parquet(f"{place}/in")
        drained(spark, lambda s: limited_stream(s, 3, 86_400), e.schema, f"{place}/in", f"{place}/out", f"{place}/checkpoint", spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{place}/out").select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"), "allowed")


@query(SQL["daily_cap"])
def daily_cap_stream(spark, sf_dir):
    """The daily cap by a stream over drops of two weeks each; a day that two drops share is counted on."""
    from waymill.streaming.limits import capped_stream, drained

    place = f"{shared_dir(spark)}/capped-{uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    fortnight = F.floor(F.unix_seconds("ts") / (14 * 86_400))
    for k in sorted(e.agg(F.collect_set(fortnight).alias("k")).first().k):
        e.where(fortnight == k).write.mode("append").parquet(f"{place}/in")
        drained(spark, lambda s: capped_stream(s, 50), e.schema, f"{place}/in", f"{place}/out", f"{place}/checkpoint", spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{place}/out").where("kept").select(F.to_date("local_day").alias("local_day"), F.col("id").alias("event_id"))
