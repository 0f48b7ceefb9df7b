"""Queries of reports."""

from pyspark.sql import functions as F

from waymill.operators import builds, reports
from waymill.plans.registry import query, table

_RUNS = "SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 11 = 0 THEN 'NOT_COMPUTABLE' ELSE 'SUCCESS' END AS status, CASE WHEN event_id % 4 = 0 THEN 'DB' ELSE 'CACHE' END AS source, floor(value * 100)::BIGINT AS elapsed_ms, event_id % 3 AS unreachable FROM events"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "ts AS created_at", "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 11 = 0 THEN 'NOT_COMPUTABLE' ELSE 'SUCCESS' END AS status", "CASE WHEN event_id % 4 = 0 THEN 'DB' ELSE 'CACHE' END AS source", "CAST(floor(value * 100) AS BIGINT) AS elapsed_ms", "event_id % 3 AS unreachable")


@query(f"""SELECT (created_at + INTERVAL 9 HOUR)::DATE AS day, count(*) FILTER (status <> 'NOT_COMPUTABLE') AS runs, count(*) FILTER (status = 'ERROR') AS failures,
  round_even(quantile_cont(elapsed_ms, 0.5) FILTER (status = 'SUCCESS' AND source = 'CACHE'), 0)::BIGINT AS median_ms, round_even(quantile_cont(elapsed_ms, 0.95) FILTER (status = 'SUCCESS' AND source = 'CACHE'), 0)::BIGINT AS p95_ms,
  coalesce(sum(unreachable), 0)::BIGINT AS unreachable FROM ({_RUNS}) GROUP BY 1""")
def matrix_daily(spark, sf_dir):
    return reports.matrix_daily(_runs(spark, sf_dir))


@query("SELECT l_shipmode AS source, l_linestatus AS severity, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, l_linestatus FROM lineitem) GROUP BY ROLLUP (1, 2)")
def severity_rollup(spark, sf_dir):
    return reports.by_severity(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("severity")))


@query(f"SELECT id, created_at, status FROM ({_RUNS}) WHERE created_at >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY ORDER BY created_at DESC, id LIMIT 40")
def latest_runs(spark, sf_dir):
    young = reports.expired(_runs(spark, sf_dir), "created_at", "2024-01-20", 10)
    return young.orderBy(F.desc("created_at"), "id").limit(40).select("id", "created_at", "status")


@query("SELECT id, status FROM (SELECT event_id AS id, event_type AS status FROM events WHERE event_type = 'click') ORDER BY status, id LIMIT 25 OFFSET 50")
def validation_page(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("event_id AS id", "event_type AS status")
    return reports.page(e, ["status", "id"], 2, 25)


@query("SELECT n_name AS source, count(*) AS rooms, count(*) FILTER (c_acctbal < 0) AS closed, coalesce(sum(CASE WHEN c_acctbal > 9000 THEN 1 END), 0)::BIGINT AS large FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def status_counts(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("source")).agg(F.count("*").alias("rooms"), F.count_if(F.col("c_acctbal") < 0).alias("closed"), F.coalesce(F.sum(F.when(F.col("c_acctbal") > 9000, 1)), F.lit(0)).alias("large"))


@query("""SELECT to_json(list({'what': what, 'kind': kind, 'count': n} ORDER BY what, kind))::VARCHAR AS counts FROM (SELECT 'NODE' AS what, r_name AS kind, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 2
  UNION ALL SELECT 'EDGE', o_orderpriority, count(*) FROM orders GROUP BY 2)""")
def build_counts(spark, sf_dir):
    """Counts of a build as one JSON document, in order."""
    r, n, o = (table(spark, sf_dir, t) for t in ("region", "nation", "orders"))
    a = r.join(n, n.n_regionkey == r.r_regionkey).groupBy(F.lit("NODE").alias("what"), F.col("r_name").alias("kind")).agg(F.count("*").alias("count"))
    b = o.groupBy(F.lit("EDGE").alias("what"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("count"))
    return builds.counts_json(a.unionByName(b)).select("counts")


@query("SELECT 'x' || h AS sample FROM (SELECT md5(c_custkey::VARCHAR) AS h FROM customer) ORDER BY h LIMIT 25")
def deterministic_sample(spark, sf_dir):
    """A sample that is the same on every run: the least hashes."""
    return table(spark, sf_dir, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("h")).orderBy("h").limit(25).select(F.concat(F.lit("x"), "h").alias("sample"))


@query("""SELECT region, u AS ord, a, b FROM (SELECT n_regionkey AS region, unnest(range(1, count(*) + 1)) AS u, unnest(list(n_name ORDER BY n_nationkey)) AS a, unnest(list(n_nationkey ORDER BY n_nationkey)) AS b FROM nation GROUP BY 1)""")
def arrays_in_order(spark, sf_dir):
    """Each region's nations as two parallel arrays, unnested with their ordinal."""
    n = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    two = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(n.alias("n"))
    two = two.select("region", F.transform("n", lambda x: x["n_name"]).alias("a"), F.transform("n", lambda x: x["n_nationkey"]).alias("b"))
    return reports.unnested(two, ["a", "b"])
