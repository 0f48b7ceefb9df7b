"""Queries that judge coordinate systems, over a register made of customers at known lots."""

from pyspark.sql import functions as F

from waymill.functions import crs
from waymill.operators import spatial, verdicts
from waymill.plans.derived import points, points_sql
from waymill.plans.registry import query, table
from waymill.plans.scalars import _arc_sql
from waymill.scratch import written

#: Where the anchors' lots are in EPSG:5174, to the metre.
_RAW = [(209010, 445647), (205191, 445477), (197341, 450270), (200355, 444743), (194626, 446387), (193345, 446976), (197978, 451558), (206393, 445888)]
_case = lambda values, rest: "CASE c_custkey % 9 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {rest} END"
_LOT = _case([f"'{a.lot}'" for a in verdicts.ANCHORS], "'중구 무교동 1'")
_SUFFIX = "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-3' WHEN 2 THEN ' 지하 1층' WHEN 3 THEN '7' ELSE '번지' END"
_REGISTER = [
    "c_custkey AS id",
    f"'서울특별시 ' || {_LOT} || {_SUFFIX} AS jibun",
    f"CASE WHEN c_custkey % 13 > 0 THEN cast({_case([x for x, _ in _RAW], 'c_custkey * 7919 % 60000 + 170000')} + c_custkey * 37 % 201 - 100 AS double) END AS x",
    f"cast({_case([y for _, y in _RAW], 'c_custkey * 104729 % 60000 + 420000')} + c_custkey * 53 % 201 - 100 AS double) AS y",
]
_REGISTER_SQL = f"(SELECT {', '.join(_REGISTER)} FROM customer)"


def register(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*_REGISTER)


def degrees_sql(source: str, p: crs.Projection, d: crs.Datum | None) -> str:
    """(id, jibun, lat, lon) of rows (id, jibun, x, y): inverse projection, and the datum step if there is one."""
    b, g = p.ellipsoid, crs.GRS80
    q, ep, gq = b.e2, b.e2 / (1 - b.e2), g.e2
    e1 = (1 - (1 - q) ** 0.5) / (1 + (1 - q) ** 0.5)
    inverse = f"""a AS (SELECT id, jibun, x, (y - {p.north} + {_arc_sql(b, f'radians({p.lat0})')}) / {b.a * (1 - q / 4 - 3 * q**2 / 64 - 5 * q**3 / 256)} AS mu FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
b AS (SELECT *, mu + {3 * e1 / 2 - 27 * e1**3 / 32} * sin(2 * mu) + {21 * e1**2 / 16 - 55 * e1**4 / 32} * sin(4 * mu) + {151 * e1**3 / 96} * sin(6 * mu) + {1097 * e1**4 / 512} * sin(8 * mu) AS f FROM a),
c AS (SELECT *, {ep} * cos(f) * cos(f) AS k, tan(f) * tan(f) AS t, 1 - {q} * sin(f) * sin(f) AS q FROM b), e AS (SELECT *, {b.a} / sqrt(q) AS n, (x - {p.east}) / ({b.a} / sqrt(q)) AS d FROM c),
l AS (SELECT id, jibun, f - (n * tan(f) * q * sqrt(q) / {b.a * (1 - q)}) * d * d * (0.5 - d * d * ((5 + 3 * t + 10 * k - 4 * k * k - {9 * ep}) / 24 - (61 + 90 * t + 298 * k + 45 * t * t - {252 * ep} - 3 * k * k) * d * d / 720)) AS phi,
  radians({p.lon0}) + d * (1 - d * d * ((1 + 2 * t + k) / 6 - (5 - 2 * k + 28 * t - 3 * k * k + {8 * ep} + 24 * t * t) * d * d / 120)) / cos(f) AS lam FROM e)"""
    if d is None:
        return f"(WITH {inverse} SELECT id, jibun, degrees(phi) AS lat, degrees(lam) AS lon FROM l)"
    rx, ry, rz = (v / 3600 * 3.141592653589793 / 180 for v in d.r)
    k, n = 1 + d.ppm * 1e-6, f"{b.a} / sqrt(1 - {q} * sin(phi) * sin(phi))"
    turn = "".join(f", t{i + 1} AS (SELECT *, atan2(z + {gq * g.a} * sin(o{i}) / sqrt(1 - {gq} * sin(o{i}) * sin(o{i})), flat) AS o{i + 1} FROM {'g' if i == 0 else f't{i}'})" for i in range(4))
    return f"""(WITH {inverse},
u AS (SELECT id, jibun, {n} * cos(phi) * cos(lam) - {d.pivot[0]} AS u, {n} * cos(phi) * sin(lam) - {d.pivot[1]} AS v, {n} * {1 - q} * sin(phi) - {d.pivot[2]} AS w FROM l),
m AS (SELECT id, jibun, {k} * (u + {rz} * v - {ry} * w) + {d.pivot[0] + d.t[0]} AS x, {k} * (v - {rz} * u + {rx} * w) + {d.pivot[1] + d.t[1]} AS y, {k} * (w + {ry} * u - {rx} * v) + {d.pivot[2] + d.t[2]} AS z FROM u),
g AS (SELECT *, sqrt(x * x + y * y) AS flat, atan2(z, sqrt(x * x + y * y) * {1 - gq}) AS o0 FROM m){turn}
SELECT id, jibun, degrees(o4) AS lat, degrees(atan2(y, x)) AS lon FROM t4)"""


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))"


def _all_sql(source: str) -> str:
    return "al AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS candidate, * FROM {degrees_sql(source, c.projection, c.datum)}" for i, c in enumerate(verdicts.CANDIDATES)) + ")"


_NAMES = "cs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c.label}', {c.control})" for i, c in enumerate(verdicts.CANDIDATES)) + ") v(candidate, label, control))"
_ANCHORS = "an AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a.label}', '{a.lot}', {a.lat}, {a.lon})" for i, a in enumerate(verdicts.ANCHORS)) + ") v(anchor, name, lot, alat, alon))"
_W, _S, _E, _N = verdicts.CITY
_JUDGED = f"""WITH rg AS MATERIALIZED {_REGISTER_SQL}, {_all_sql('rg')}, {_NAMES}, {_ANCHORS},
bx AS (SELECT candidate, round_even(avg((lon BETWEEN {_W} AND {_E} AND lat BETWEEN {_S} AND {_N})::INTEGER), 4) AS inside FROM al GROUP BY 1),
er AS MATERIALIZED (SELECT candidate, anchor, {_haversine('alat', 'alon', 'lat', 'lon')} AS d FROM al JOIN an ON regexp_matches(jibun, lot || '(\\D|$)')),
md AS (SELECT candidate, count(*) AS samples, median(d) AS m FROM er GROUP BY 1), pa AS (SELECT candidate, anchor, count(*) AS samples, median(d) AS m FROM er GROUP BY ALL)"""


@query(f"""{_JUDGED} SELECT row_number() OVER (ORDER BY round_even(m, 1) NULLS LAST, candidate)::INTEGER AS place, label, inside, round_even(m, 1) AS median_m, coalesce(samples, 0) AS samples,
  CASE WHEN m IS NULL THEN 'NO_DATA' WHEN m < 150 THEN 'PASS' WHEN m < 300 THEN 'WARN' ELSE 'FAIL' END AS verdict,
  candidate = (SELECT arg_min(candidate, (round_even(m, 1), candidate)) FROM md JOIN cs USING (candidate) WHERE NOT control) AS best FROM cs LEFT JOIN md USING (candidate) LEFT JOIN bx USING (candidate)""")
def crs_candidate_verdict(spark, sf_dir):
    """Which system the register is in: candidates by their median distance from the anchors, the nearest first."""
    return verdicts.judged(verdicts.anchor_errors(register(spark, sf_dir))).drop("anchors")


@query(f"{_JUDGED} SELECT label, name, coalesce(samples, 0) AS samples, round_even(m, 1) AS median_m FROM cs CROSS JOIN an LEFT JOIN pa USING (candidate, anchor)")
def crs_anchor_errors(spark, sf_dir):
    out = verdicts.judged(verdicts.anchor_errors(register(spark, sf_dir)))
    return out.select("label", F.explode("anchors").alias("a")).select("label", "a.*")


@query(f"""WITH rg AS MATERIALIZED (SELECT * FROM {_REGISTER_SQL} WHERE x IS NOT NULL ORDER BY md5(id::VARCHAR), id LIMIT 5000), {_all_sql('rg')}, {_NAMES}
SELECT a.label AS a, b.label AS b, count(*) AS n, round_even(median(d), 1) AS median_m, round_even(max(d), 1) AS max_m FROM (SELECT p.candidate AS i, q.candidate AS j, {_haversine('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS d FROM al p JOIN al q ON p.id = q.id AND p.candidate < q.candidate) JOIN cs a ON a.candidate = i JOIN cs b ON b.candidate = j GROUP BY ALL""")
def crs_spread(spark, sf_dir):
    """How far apart each two candidates put the same places."""
    return verdicts.spread(register(spark, sf_dir), "id")


_TM = crs.EPSG_5186


@query(f"SELECT count(*) AS n, 0.0::DOUBLE AS max_mm, 0.0::DOUBLE AS median_mm, 0.0::DOUBLE AS mean_mm, true AS agrees FROM {points_sql('part')}")
def crs_agreement(spark, sf_dir):
    """Map metres to degrees and back against the metres themselves, to a tenth of a millimetre."""
    p = points(spark, sf_dir, "part")
    back = crs.forward(crs.to_degrees(p.select("id", "x", "y"), "x", "y", "lat", "lon", _TM, None), _TM, "lat", "lon", "x", "y")
    out = verdicts.agreement(p, back, "id")
    return out.select("n", *[F.abs(F.round(F.col(f"{c}_m") * 1000, 1)).alias(f"{c}_mm") for c in ("max", "median", "mean")], "agrees")


@query(f"""WITH rg AS MATERIALIZED {_REGISTER_SQL}, {_all_sql('rg')}, {_NAMES},
xy AS (SELECT candidate, 6371000.0 * radians(lon - 127.0) * cos(radians(37.5)) AS x, 6371000.0 * radians(lat - 37.5) AS y FROM al),
st AS (SELECT 6371000.0 * radians(lon - 127.0) * cos(radians(37.5)) AS x, 6371000.0 * radians(lat - 37.5) AS y FROM (SELECT s_suppkey, 37.4 + s_suppkey * 7919 % 32000 / 100000.0 AS lat, 126.73 + s_suppkey * 104729 % 54000 / 100000.0 AS lon FROM supplier)),
nd AS (SELECT candidate, (SELECT min(sqrt((st.x - xy.x) * (st.x - xy.x) + (st.y - xy.y) * (st.y - xy.y))) FROM st) AS d FROM xy)
SELECT label, count(*) AS n, round_even(median(d), 1) AS median_m, round_even(quantile_cont(d, 0.95), 1) AS p95_m, round_even(avg((d < 1000)::INTEGER), 4) AS near FROM nd JOIN cs USING (candidate) GROUP BY 1""")
def crs_alignment(spark, sf_dir):
    """By each candidate, how far the register's places are from the nearest of stops that are known in degrees."""
    flat = lambda lat, lon: (6371000.0 * F.radians(lon - 127.0) * F.cos(F.radians(F.lit(37.5))), 6371000.0 * F.radians(lat - 37.5))
    lat, lon = F.expr("37.4 + s_suppkey * 7919 % 32000 / 100000.0d"), F.expr("126.73 + s_suppkey * 104729 % 54000 / 100000.0d")
    x, y = flat(lat, lon)
    stops = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stop"), x.alias("rx"), y.alias("ry"))
    at = written(verdicts.placed(register(spark, sf_dir), verdicts.CANDIDATES), "placed")
    x, y = flat(F.col("lat"), F.col("lon"))
    rows = at.select(F.struct("candidate", "id").alias("key"), x.alias("lx"), y.alias("ly"))
    d = spatial.nearest_any(rows, stops, "key", "stop")
    label = F.array(*[F.lit(c.label) for c in verdicts.CANDIDATES])[F.col("key.candidate")]
    return d.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.bround(F.percentile("distance", F.lit(0.5)), 1).alias("median_m"), F.bround(F.percentile("distance", F.lit(0.95)), 1).alias("p95_m"), verdicts.ratio(F.col("distance") < 1000).alias("near"))
