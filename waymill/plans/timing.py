"""Queries of leg times, headways, boarding weights and transfers."""

from pyspark.sql import functions as F

from waymill.operators import stations, timing, transfers
from waymill.plans.derived import RAISED_SQL, STOPS_SQL, TRANSFERS_SQL, calibrated, stops, transfer_files
from waymill.plans.registry import query, table

_GAPS = f"""g AS (SELECT line, station, direction, (arrive // 3600) % 24 AS hour, arrive - lag(arrive) OVER (PARTITION BY line, station, direction, day ORDER BY arrive, id) AS gap FROM {STOPS_SQL}),
h AS (SELECT line, station, direction, hour::INTEGER AS hour, median(gap)::DOUBLE AS seconds, count(*) AS samples FROM g WHERE gap BETWEEN 1 AND 3600 GROUP BY ALL)"""


@query(f"""SELECT line, a, b, median(run)::DOUBLE AS seconds, count(*) AS samples FROM (SELECT line, station AS a, lead(station) OVER w AS b, lead(depart) OVER w - depart AS run FROM {STOPS_SQL}
  WINDOW w AS (PARTITION BY line, direction, train, day ORDER BY arrive, id)) WHERE run BETWEEN 1 AND 1800 AND a <> b GROUP BY ALL""")
def leg_times(spark, sf_dir):
    return timing.leg_times(stops(spark, sf_dir), "day")


@query(f"WITH {_GAPS} SELECT * FROM h")
def headways_by_hour(spark, sf_dir):
    return timing.headways(stops(spark, sf_dir), "day")


@query(f"SELECT line, station, list_sort(list_distinct(list(((arrive // 3600) % 24)::INTEGER))) AS hours FROM {STOPS_SQL} GROUP BY ALL")
def service_hours(spark, sf_dir):
    return timing.service_hours(stops(spark, sf_dir))


@query(f"""WITH {_GAPS}, s AS (SELECT DISTINCT line, station, ((arrive // 3600) % 24)::INTEGER AS hour FROM {STOPS_SQL} WHERE arrive % 4 <> 0), w AS (SELECT line, station, hour, greatest(1, round_even(median(seconds) / 2, 0))::INTEGER AS wait FROM h GROUP BY ALL),
p AS (SELECT line, station, unnest(range(24))::INTEGER AS hour FROM (SELECT DISTINCT line, station FROM w) SEMI JOIN s USING (line, station)),
f AS (SELECT p.line, p.station, p.hour, last_value(wait IGNORE NULLS) OVER (PARTITION BY p.line, p.station ORDER BY p.hour ROWS UNBOUNDED PRECEDING) AS b, first_value(wait IGNORE NULLS) OVER (PARTITION BY p.line, p.station ORDER BY p.hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM p LEFT JOIN w USING (line, station, hour))
SELECT line, station, f.hour::BIGINT AS hour, CASE WHEN s.hour IS NULL THEN -1 ELSE coalesce(b, a) END::INTEGER AS weight FROM f LEFT JOIN s USING (line, station, hour)""")
def board_weights(spark, sf_dir):
    s = stops(spark, sf_dir)
    w = timing.board_weights(timing.headways(s, "day"), timing.service_hours(s.where("arrive % 4 <> 0")))
    return w.select("line", "station", F.posexplode("by_hour").alias("hour", "weight")).select("line", "station", F.col("hour").cast("long").alias("hour"), F.col("weight").cast("int").alias("weight"))


_PLACES = "['시청', '종각', '동대문', '강남', '사당', '서울역']"


@query(f"""WITH {_GAPS}, p AS (SELECT *, {_PLACES}[1 + (length(station) + line::INTEGER) % 6] AS place, line || CASE WHEN line = '9' THEN '급행' ELSE '' END AS key FROM h WHERE hour = 8), r AS (SELECT * FROM (VALUES ('1', 3.0), ('2', 2.5), ('3', 3.0), ('4', 2.5), ('5', 2.5), ('6', 4.0), ('7', 2.5), ('8', 4.5)) v(key, reference)),
i AS (SELECT *, key NOT IN ('1', '4') OR key = '1' AND place IN ('시청', '종각', '동대문', '서울역') OR key = '4' AND place IN ('동대문', '사당', '서울역') AS inside FROM p WHERE key NOT LIKE '%급행'),
m AS (SELECT key, coalesce(median(seconds) FILTER (inside), median(seconds)) / 60 AS minutes FROM i GROUP BY key)
SELECT key AS line, round_even(minutes, 1) AS computed_min, reference::DOUBLE AS reference_rh_min, round_even(minutes / reference::DOUBLE, 2) AS ratio, key IN ('1', '4') AS scoped, coalesce(minutes / reference::DOUBLE <= 2, true) AS ok FROM m LEFT JOIN r USING (key)""")
def headway_reference_check(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("시청", "종각", "동대문", "강남", "사당", "서울역")])
    gaps = timing.headways(stops(spark, sf_dir), "day")
    at = F.get(names, (F.length("station") + F.col("line").cast("int")) % 6)
    line = F.concat("line", F.when(F.col("line") == "9", "급행").otherwise(""))
    return timing.reference_check(gaps.select(line.alias("line"), at.alias("station"), "hour", "seconds"))


@query(f"WITH {_GAPS} SELECT count(seconds) AS n, median(seconds) AS median, round(quantile_cont(seconds, 0.95), 6) AS p95, max(seconds) AS most, count(*) FILTER (seconds > 1800) AS n_over FROM h")
def headway_quantiles(spark, sf_dir):
    q = timing.quantiles(timing.headways(stops(spark, sf_dir), "day"), F.col("seconds"), 1800)
    return q.withColumn("p95", F.round("p95", 6))


@query("SELECT DISTINCT 'R' || (l_suppkey % 40) AS route FROM lineitem WHERE 'R' || (l_suppkey % 40) NOT IN (SELECT 'R' || s_suppkey FROM supplier WHERE s_acctbal > 2000)")
def routes_without_headway(spark, sf_dir):
    sections = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("R"), F.col("l_suppkey") % 40).alias("route"))
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.concat(F.lit("R"), "s_suppkey").alias("route"))
    return timing.known_headways(sections, known)[1]


@query(f"WITH {TRANSFERS_SQL} SELECT * FROM c")
def transfer_calibration(spark, sf_dir):
    return transfers.calibrated(*transfer_files(spark, sf_dir))


@query(f"WITH {TRANSFERS_SQL} SELECT station, st.sec, nw.sec AS network FROM st, nw")
def station_traverse(spark, sf_dir):
    t = calibrated(spark, sf_dir)
    return transfers.station_traverse(t).crossJoin(F.broadcast(transfers.network_traverse(t).withColumnRenamed("sec", "network")))


@query(f"WITH RECURSIVE {TRANSFERS_SQL}, {RAISED_SQL} SELECT * FROM rz")
def traverse_fixpoint(spark, sf_dir):
    """Platform walks raised pair by pair in a fixed order."""
    t = calibrated(spark, sf_dir)
    return transfers.raised(t, transfers.station_traverse(t))


_STATION = "CASE WHEN l_suppkey % 11 = 0 THEN '이수' WHEN l_suppkey % 11 = 1 THEN '총신대입구(이수)' ELSE 'station ' || (l_suppkey % 20) END"
_TIME = "CASE WHEN l_quantity % 13 = 0 THEN '10:00' WHEN l_quantity % 17 = 0 THEN 'none' ELSE '0' || cast(l_partkey % 9 as {s}) || ':' || lpad(cast(l_suppkey % 60 as {s}), 2, '0') END"
_NAME_SQL = "replace(regexp_replace({c}, '\\(.*?\\)', '', 'g'), ' ', '')"
_KEY_SQL = "CASE WHEN {n} = '이수' THEN '총신대입구' ELSE {n} END"
_SECONDS_SQL = "CASE WHEN l_quantity % 13 = 0 THEN 600 WHEN l_quantity % 17 = 0 OR (l_partkey % 9 = 0 AND l_suppkey % 60 = 0) THEN NULL ELSE (l_partkey % 9) * 60 + l_suppkey % 60 END"


def _station_sql(c: str) -> str:
    return _KEY_SQL.format(n=_NAME_SQL.format(c=c))


@query(f"""WITH x AS (SELECT {_station_sql(_STATION)} AS station, l_linenumber::VARCHAR AS line_a, CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 7 + 1)::VARCHAR END AS line_b, {_SECONDS_SQL} AS sec, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
y AS (SELECT * FROM x WHERE line_b IS NOT NULL AND sec IS NOT NULL AND line_a <> line_b), z AS (SELECT station, line_a, line_b, sec, 0 AS turned, ord FROM y UNION ALL SELECT station, line_b, line_a, sec, 1, ord FROM y)
SELECT station, line_a, line_b, arg_min(sec, (turned, ord, sec))::INTEGER AS sec FROM z GROUP BY ALL""")
def transfers_by_distance(spark, sf_dir):
    """A file of walking distances as it comes, with lines of other operators and malformed times."""
    line = F.when(F.col("l_partkey") % 4 > 0, F.concat((F.col("l_partkey") % 7 + 1).cast("string"), F.lit("호선"))).otherwise("공항철도")
    raw = table(spark, sf_dir, "lineitem").select(F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("호선"), line.alias("환승노선"), F.expr(_STATION).alias("환승역명"), F.expr(_TIME.format(s="string")).alias("환승소요시간"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return transfers.from_distance(raw)


@query(f"""WITH x AS (SELECT {_station_sql(_STATION)} AS station, CASE WHEN l_partkey % 9 = 0 THEN '이수' ELSE {_STATION} END AS other, l_linenumber::VARCHAR AS line_a, CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 7 + 1)::VARCHAR ELSE '신림' END AS line_b, {_SECONDS_SQL} AS sec FROM lineitem),
y AS (SELECT *, {_station_sql('other')} AS second FROM x)
SELECT station, line_a, line_b, round_even(median(sec), 0)::INTEGER AS sec FROM y WHERE station = second AND line_b <> '신림' AND line_a <> line_b AND sec IS NOT NULL AND sec <> 600 GROUP BY ALL""")
def transfers_measured(spark, sf_dir):
    """A file of measured transfers as it comes, with placeholders, other stations and lines without a number."""
    other = F.expr(f"CASE WHEN l_partkey % 9 = 0 THEN '이수' ELSE {_STATION} END")
    line = F.when(F.col("l_partkey") % 4 > 0, (F.col("l_partkey") % 7 + 1).cast("string")).otherwise("신림")
    raw = table(spark, sf_dir, "lineitem").select(F.expr(_STATION).alias("환승시작역"), other.alias("환승종료역"), F.col("l_linenumber").cast("string").alias("환승시작 호선"), line.alias("환승종료 호선"), F.expr(_TIME.format(s="string")).alias("소요시간"))
    return transfers.from_measurements(raw)


@query("""WITH master AS (SELECT CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 9 + 1)::VARCHAR END AS line, 'stop ' || (s_suppkey % 30) || CASE WHEN s_suppkey % 2 = 0 THEN '(x)' ELSE '' END AS station, 37.0 + s_suppkey % 97 / 1000.0 AS lat, 127.0 + s_suppkey % 89 / 1000.0 AS lon, s_suppkey AS place, 'stop' || (s_suppkey % 30) AS name FROM supplier),
wanted AS (SELECT DISTINCT (c_custkey % 9 + 1)::VARCHAR AS line, 'stop ' || (c_custkey % 36) AS station, 'stop' || (c_custkey % 36) AS name FROM customer),
l AS (SELECT line, name, arg_min(lat, place) AS lat, arg_min(lon, place) AS lon FROM master WHERE line IS NOT NULL GROUP BY ALL), n AS (SELECT name, arg_min(lat, place) AS lat, arg_min(lon, place) AS lon FROM master GROUP BY ALL)
SELECT w.line, w.station, coalesce(l.lat, n.lat)::DOUBLE AS lat, coalesce(l.lon, n.lon)::DOUBLE AS lon FROM wanted w LEFT JOIN l USING (line, name) LEFT JOIN n USING (name) WHERE coalesce(l.lat, n.lat) IS NOT NULL""")
def station_lookup(spark, sf_dir):
    k = F.col("s_suppkey")
    master = table(spark, sf_dir, "supplier").select(
        F.when(k % 4 > 0, (k % 9 + 1).cast("string")).alias("line"),
        F.concat(F.lit("stop "), (k % 30).cast("string"), F.when(k % 2 == 0, "(x)").otherwise("")).alias("station"),
        (37.0 + k % 97 / 1000.0).alias("lat"),
        (127.0 + k % 89 / 1000.0).alias("lon"),
        k.alias("place"),
    )
    c = F.col("c_custkey")
    wanted = table(spark, sf_dir, "customer").select((c % 9 + 1).cast("string").alias("line"), F.concat(F.lit("stop "), (c % 36).cast("string")).alias("station")).distinct()
    return stations.located(wanted, master)[0]
