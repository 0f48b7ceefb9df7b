"""Queries of the scalar functions."""

from pyspark.sql import functions as F

from waymill.functions import crs, scalars
from waymill.plans.derived import points, points_sql
from waymill.plans.registry import query, table

# Text in the shapes that registers have, made of keys with the same arithmetic in both engines.
_DATES = "CASE o_orderkey % 11 WHEN 0 THEN d WHEN 1 THEN replace(d, '-', '') WHEN 2 THEN d || ' 09:31:22' WHEN 3 THEN '  ' || d || '  ' WHEN 4 THEN '없음' WHEN 5 THEN '2012-13-45' WHEN 6 THEN y || '-' || m || '-' || x WHEN 7 THEN y || '-' || m || '-' || x || ' 7:05:09' WHEN 8 THEN replace(d, '-', '') || '093122' WHEN 9 THEN y || '-' || m || '-' || x || ' 07:05' ELSE '2013-2-30' END"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 11 IN (0, 1, 2, 3, 6, 7, 8) OR o_orderkey % 11 = 9 AND length(m || x) > 2 THEN d::DATE END AS parsed
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, month(o_orderdate)::VARCHAR AS m, day(o_orderdate)::VARCHAR AS x FROM orders)""")
def parse_dates(spark, sf_dir):
    """Dates padded or not, with a time or not. With one digit each for month and day and no seconds the text is no date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.year("o_orderdate").cast("string").alias("y"), F.month("o_orderdate").cast("string").alias("m"), F.dayofmonth("o_orderdate").cast("string").alias("x"))
    return o.select("o_orderkey", scalars.parse_date(F.expr(_DATES)).alias("parsed"))


_HMS = "CASE WHEN event_id % 7 = 0 THEN '00:00:00' WHEN event_id % 11 = 0 THEN 'ab:cd:ef' WHEN event_id % 13 = 0 THEN '12:30' ELSE lpad(cast(event_id % 27 as {s}), 2, '0') || ':' || lpad(cast(event_id % 60 as {s}), 2, '0') || ':' || lpad(cast(event_id % 59 as {s}), 2, '0') END"


@query(f"""SELECT event_id, CASE WHEN NOT regexp_matches(t, '^[0-9]+:[0-9]+:[0-9]+$') OR t = '00:00:00' THEN NULL
  ELSE split_part(t, ':', 1)::INTEGER * 3600 + split_part(t, ':', 2)::INTEGER * 60 + split_part(t, ':', 3)::INTEGER END AS seconds
  FROM (SELECT event_id, {_HMS.format(s="varchar")} AS t FROM events)""")
def parse_hms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scalars.parse_hms(F.expr(_HMS.format(s="string"))).alias("seconds"))


_TEXTS = "CASE p_partkey % 6 WHEN 0 THEN ' 한식 · 분식 ' WHEN 1 THEN '  ' WHEN 2 THEN p_name WHEN 3 THEN '강남(2) 역' WHEN 4 THEN '이수' ELSE cast(p_size % 9 + 1 as {s}) || '호선 ' END"


@query(f"""SELECT p_partkey, nullif(translate(trim(t), ' ·', ''), '') AS category, nullif(regexp_extract(t, '^\\s*(\\d)\\s*호선\\s*$', 1), '') AS line,
  CASE WHEN replace(regexp_replace(t, '\\(.*?\\)', '', 'g'), ' ', '') = '이수' THEN '총신대입구' ELSE replace(regexp_replace(t, '\\(.*?\\)', '', 'g'), ' ', '') END AS station
  FROM (SELECT p_partkey, {_TEXTS.format(s="varchar")} AS t FROM part)""")
def normalize_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEXTS.format(s="string")).alias("t"))
    return p.select("p_partkey", scalars.normalize_category(F.col("t")).alias("category"), scalars.normalize_line(F.col("t")).alias("line"), scalars.station_key(F.col("t")).alias("station"))


_START, _STOP = ("CASE {k} % 5 WHEN 0 THEN '신설동' WHEN 1 THEN '까치산' WHEN 2 THEN '도림천' WHEN 3 THEN '시청' ELSE '성수' END".format(k=k) for k in ("l_suppkey", "l_partkey"))
_FLAG = "CASE WHEN l_quantity % 7 = 0 THEN NULL WHEN l_quantity % 5 = 0 THEN '1' ELSE '0' END"


@query(f"""WITH branch AS (SELECT * FROM (VALUES ('2', '신설동', '성수지선'), ('2', '까치산', '신정지선'), ('2', '도림천', '신정지선')) v(line, stop, name)),
x AS (SELECT l_linenumber::VARCHAR AS line, {_FLAG} AS express, {_START} AS a, {_STOP} AS b FROM lineitem),
k AS (SELECT CASE WHEN express IS DISTINCT FROM '0' THEN x.line || '급행' ELSE x.line || coalesce(s.name, t.name, '') END AS key FROM x LEFT JOIN branch s ON s.line = x.line AND s.stop = a LEFT JOIN branch t ON t.line = x.line AND t.stop = b)
SELECT key, regexp_replace(key, '(급행|성수지선|신정지선)$', '') AS base, regexp_replace(key, '(급행|성수지선|신정지선)$', '') || '호선' || CASE WHEN key LIKE '%급행' THEN ' 급행' WHEN key LIKE '%지선' THEN ' ' || substr(key, 2) ELSE '' END AS name, key LIKE '%급행' AS express, key LIKE '%지선' AS branch, count(*) AS n FROM k GROUP BY ALL""")
def line_key(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("line"), F.expr(_FLAG).alias("express"), F.expr(_START).alias("a"), F.expr(_STOP).alias("b"))
    key = F.col("key")
    x = x.select(scalars.line_key(F.col("line"), F.col("express"), F.col("a"), F.col("b")).alias("key"))
    return x.groupBy("key", scalars.base_line(key).alias("base"), scalars.line_name(key).alias("name"), scalars.is_express(key).alias("express"), scalars.is_branch(key).alias("branch")).agg(F.count("*").alias("n"))


_CODES = "CASE WHEN c_custkey % 5 = 0 THEN 'oil-u23k' WHEN c_custkey % 7 = 0 THEN 'too short' ELSE lower(substr(md5(cast(c_custkey as {s})), 1, 4)) || ' - ' || upper(substr(md5(cast(c_custkey as {s})), 5, 4)) END"


@query(f"""WITH c AS (SELECT c_custkey, regexp_replace(translate(upper({_CODES.format(s="varchar")}), 'OILU-', '011V'), '\\s|[^0-9A-Z]', '', 'g') AS k FROM customer)
  SELECT c_custkey, CASE WHEN regexp_matches(k, '^[0-9A-HJKMNP-TV-Z]{{8}}$') THEN k END AS code, CASE WHEN regexp_matches(k, '^[0-9A-HJKMNP-TV-Z]{{8}}$') THEN substr(k, 1, 4) || '-' || substr(k, 5, 4) END AS shown FROM c""")
def invite_code(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", scalars.invite_code(F.expr(_CODES.format(s="string"))).alias("code"))
    return c.withColumn("shown", scalars.shown_invite_code(F.col("code")))


@query("""SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n, to_json({'type': event_type, 'k': (props::JSON ->> 'k')::BIGINT})::VARCHAR AS detail FROM events GROUP BY ALL""")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))
    return e.withColumn("detail", F.to_json(F.struct(F.col("event_type").alias("type"), "k")))


@query("""SELECT CASE WHEN isodow(o_orderdate) <= 5 THEN 'DAY' WHEN isodow(o_orderdate) = 6 THEN 'SAT' ELSE 'END' END AS bucket, count(*) AS n, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY 1""")
def weekday_bucket(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.groupBy(scalars.weekday_bucket(day).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct(day).alias("days"))


@query("""SELECT l_orderkey, l_linenumber, greatest(1, round_even(l_extendedprice / 1.2, 0))::INTEGER AS walk, greatest(1, round_even(l_quantity / 2, 0))::INTEGER AS wait,
  ((l_partkey * 37 // 3600) % 24)::INTEGER AS hour, floor(l_extendedprice / 7 * 10 + 0.5) / 10 AS rounded FROM lineitem""")
def rounding_rules(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_orderkey", "l_linenumber", scalars.walk_seconds(F.col("l_extendedprice")).alias("walk"), scalars.board_wait(F.col("l_quantity")).alias("wait"), scalars.service_hour(F.col("l_partkey") * 37).alias("hour"), scalars.round_half_up(F.col("l_extendedprice") / 7).alias("rounded"))


@query("""SELECT p_partkey, printf('%d분 %d초 · 환승 %d · 도보 %.0fm · %s', p_partkey // 60, p_partkey % 60, p_size % 4, p_size * 10.0, p_brand || ' → ' || p_type) AS summary FROM part""")
def route_summary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalars.route_summary(F.col("p_partkey"), F.col("p_size") % 4, F.col("p_size") * F.lit(10.0).cast("double"), F.array("p_brand", "p_type")).alias("summary"))


_LOTS = "'신천동 ' || cast(c_custkey % 400 as {s}) || CASE WHEN c_custkey % 2 = 0 THEN '-3' ELSE '' END"


@query(f"""SELECT count(*) FILTER (WHERE regexp_matches(a, '신천동 29(\\D|$)')) AS hits, count(*) AS n FROM (SELECT {_LOTS.format(s="varchar")} AS a FROM customer)""")
def lot_number_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.expr(_LOTS.format(s="string")).alias("a"))
    return c.agg(F.count_if(scalars.lot_matches(F.col("a"), "신천동 29")).alias("hits"), F.count("*").alias("n"))


_TYPED = "CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE ' 127.' || cast(s_suppkey % 100 as {s}) || ', 37.' || cast(s_suppkey % 77 as {s}) END"


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN trim(split_part(t, ',', 1))::DOUBLE END AS lng, CASE WHEN s_suppkey % 3 <> 0 THEN trim(split_part(t, ',', 2))::DOUBLE END AS lat FROM (SELECT s_suppkey, {_TYPED.format(s="varchar")} AS t FROM supplier)""")
def typed_coordinate(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", scalars.coordinate(F.expr(_TYPED.format(s="string"))).alias("c"))
    return s.select("s_suppkey", "c.lng", "c.lat")


_IDS = "CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '_') WHEN 2 THEN ' ' || replace(c_name, '#', '_') WHEN 3 THEN 'Ab' || c_custkey % 50 WHEN 4 THEN replace(c_name, '#', '_') || '_and_more' ELSE '   ' END"


@query(f"""WITH x AS (SELECT c_custkey, {_IDS} AS t FROM customer) SELECT c_custkey, CASE WHEN regexp_full_match(t, '[A-Za-z0-9_]{{4,20}}') THEN lower(t) END AS login_id,
  CASE WHEN trim(t) <> '' AND length(t) BETWEEN 2 AND 20 THEN trim(t) END AS nickname, trim(t) <> '' AND length(t) BETWEEN 8 AND 64 AND c_custkey % 4 > 0 AS password FROM x""")
def login_id(spark, sf_dir):
    """What a sign-up form takes: blanks around an id aren't forgiven, around a nickname they are removed."""
    x = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_IDS).alias("t"))
    t = F.col("t")
    return x.select("c_custkey", scalars.login_id(t).alias("login_id"), scalars.nickname(t).alias("nickname"), scalars.password_fits(t, F.when(F.col("c_custkey") % 4 > 0, t).otherwise("x")).alias("password"))


_HEADERS = "CASE s_suppkey % 5 WHEN 0 THEN 'attachment; filename=' || char(34) || s_name || '.csv' || char(34) WHEN 1 THEN 'attachment; filename=x.csv; FileName*=UTF-8' || char(39) || char(39) || '%EC%9D%8C%EC%8B%9D+' || s_suppkey || '%20a.csv' WHEN 2 THEN 'inline' WHEN 3 THEN 'attachment; filename=a=b; x=y' END"


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name || '.csv' WHEN 1 THEN '음식+' || s_suppkey || ' a.csv' WHEN 3 THEN 'a=b' END AS name FROM supplier")
def attachment_names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.attachment_name(F.expr(_HEADERS)).alias("name"))


# Degrees around a city made of the points' metres.
_DEG_SQL = "(SELECT id, 37 + (y - 520000) / 100000 AS lat, 126.5 + (x - 170000) / 80000 AS lon FROM {p})"


def _degrees(df):
    return df.select("id", (37 + (F.col("y") - 520000) / 100000).alias("lat"), (126.5 + (F.col("x") - 170000) / 80000).alias("lon"))


@query(f"""SELECT c.id, round(2 * 6371008.8 * asin(sqrt(power(sin(radians(37.5 - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(37.5)) * power(sin(radians(127.0 - c.lon) / 2), 2))), 3) AS haversine,
  round(6371000.0 * sqrt(power(radians(127.0 - c.lon) * cos(radians((c.lat + 37.5) / 2)), 2) + power(radians(37.5 - c.lat), 2)), 3) AS flat FROM {_DEG_SQL.format(p=points_sql("customer"))} c""")
def globe_distances(spark, sf_dir):
    c = _degrees(points(spark, sf_dir, "customer"))
    to = (F.col("lat"), F.col("lon"), F.lit(37.5), F.lit(127.0))
    return c.select("id", F.round(crs.haversine(*to), 3).alias("haversine"), F.round(crs.equirectangular(*to), 3).alias("flat"))


@query(f"""SELECT count(*) AS n, round(avg((lat BETWEEN 37.4 AND 37.7 AND lon BETWEEN 126.7 AND 127.2)::INTEGER), 9) AS ratio FROM {_DEG_SQL.format(p=points_sql("customer"))}""")
def bbox_ratio(spark, sf_dir):
    c = _degrees(points(spark, sf_dir, "customer"))
    inside = F.col("lat").between(37.4, 37.7) & F.col("lon").between(126.7, 127.2)
    return c.agg(F.count("*").alias("n"), F.round(F.avg(inside.cast("int")), 9).alias("ratio"))


def _arc_sql(e: crs.Ellipsoid, lat: str) -> str:
    q = e.e2
    return f"{e.a} * ({1 - q / 4 - 3 * q**2 / 64 - 5 * q**3 / 256} * {lat} - {3 * q / 8 + 3 * q**2 / 32 + 45 * q**3 / 1024} * sin(2 * {lat}) + {15 * q**2 / 256 + 45 * q**3 / 1024} * sin(4 * {lat}) - {35 * q**3 / 3072} * sin(6 * {lat}))"


def _to_5186_sql(points_: str) -> str:
    """The whole chain from 5174 in SQL: inverse projection, datum step, forward projection."""
    p, o, d = crs.EPSG_5174, crs.EPSG_5186, crs.KOREAN_1985
    b, g = p.ellipsoid, o.ellipsoid
    q, ep = b.e2, b.e2 / (1 - b.e2)
    e1 = (1 - (1 - q) ** 0.5) / (1 + (1 - q) ** 0.5)
    gq, gp = g.e2, g.e2 / (1 - g.e2)
    rx, ry, rz = (v / 3600 * 3.141592653589793 / 180 for v in d.r)
    k = 1 + d.ppm * 1e-6
    lat0 = f"radians({p.lat0})"
    n = f"{b.a} / sqrt(1 - {q} * sin(phi) * sin(phi))"
    turn = "".join(f", t{i + 1} AS (SELECT *, atan2(z + {gq * g.a} * sin(o{i}) / sqrt(1 - {gq} * sin(o{i}) * sin(o{i})), flat) AS o{i + 1} FROM {'g' if i == 0 else f't{i}'})" for i in range(4))
    return f"""WITH a AS (SELECT id, x, (y - {p.north} + {_arc_sql(b, lat0)}) / {b.a * (1 - q / 4 - 3 * q**2 / 64 - 5 * q**3 / 256)} AS mu FROM {points_}),
b AS (SELECT *, mu + {3 * e1 / 2 - 27 * e1**3 / 32} * sin(2 * mu) + {21 * e1**2 / 16 - 55 * e1**4 / 32} * sin(4 * mu) + {151 * e1**3 / 96} * sin(6 * mu) + {1097 * e1**4 / 512} * sin(8 * mu) AS f FROM a),
c AS (SELECT *, {ep} * cos(f) * cos(f) AS k, tan(f) * tan(f) AS t, 1 - {q} * sin(f) * sin(f) AS q FROM b), e AS (SELECT *, {b.a} / sqrt(q) AS n, (x - {p.east}) / ({b.a} / sqrt(q)) AS d FROM c),
l AS (SELECT id, f - (n * tan(f) * q * sqrt(q) / {b.a * (1 - q)}) * d * d * (0.5 - d * d * ((5 + 3 * t + 10 * k - 4 * k * k - {9 * ep}) / 24 - (61 + 90 * t + 298 * k + 45 * t * t - {252 * ep} - 3 * k * k) * d * d / 720)) AS phi,
  radians({p.lon0}) + d * (1 - d * d * ((1 + 2 * t + k) / 6 - (5 - 2 * k + 28 * t - 3 * k * k + {8 * ep} + 24 * t * t) * d * d / 120)) / cos(f) AS lam FROM e),
u AS (SELECT id, {n} * cos(phi) * cos(lam) - {d.pivot[0]} AS u, {n} * cos(phi) * sin(lam) - {d.pivot[1]} AS v, {n} * {1 - q} * sin(phi) - {d.pivot[2]} AS w FROM l),
m AS (SELECT id, {k} * (u + {rz} * v - {ry} * w) + {d.pivot[0] + d.t[0]} AS x, {k} * (v - {rz} * u + {rx} * w) + {d.pivot[1] + d.t[1]} AS y, {k} * (w + {ry} * u - {rx} * v) + {d.pivot[2] + d.t[2]} AS z FROM u),
g AS (SELECT *, sqrt(x * x + y * y) AS flat, atan2(z, sqrt(x * x + y * y) * {1 - gq}) AS o0 FROM m){turn},
h AS (SELECT id, o4 AS phi, (atan2(y, x) - radians({o.lon0})) * cos(o4) AS a, {g.a} / sqrt(1 - {gq} * sin(o4) * sin(o4)) AS n, tan(o4) * tan(o4) AS t, {gp} * cos(o4) * cos(o4) AS k FROM t4)
SELECT id, round({o.east} + n * a * (1 + a * a * ((1 - t + k) / 6 + (5 - 18 * t + t * t + 72 * k - {58 * gp}) * a * a / 120)), 3) AS east,
  round({o.north} + {_arc_sql(g, 'phi')} - {_arc_sql(g, lat0)} + n * tan(phi) * a * a * (0.5 + a * a * ((5 - t + 9 * k + 4 * k * k) / 24 + (61 - 58 * t + t * t + 600 * k - {330 * gp}) * a * a / 720)), 3) AS north FROM h"""


@query(_to_5186_sql(points_sql("customer")))
def crs_5174_to_5186(spark, sf_dir):
    """Register coordinates in the map's system; the chain of series is also tested against known points."""
    p = crs.to_5186(points(spark, sf_dir, "customer"), "x", "y", "east", "north")
    return p.select("id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))
