"""Queries of staging, rules and table maintenance, over two runs made of orders."""

from uuid import uuid4

from pyspark.sql import functions as F

from waymill.functions.scalars import is_active
from waymill.operators import ingest, rules, runs
from waymill.plans.derived import points, points_sql, run, run_sql, runs_with
from waymill.plans.registry import query, table
from waymill.scratch import shared_dir
from waymill.sources import readers

_WITH = f"WITH {runs_with()}"
_RULES_SQL = {
    "NAME_MISSING": "SELECT source_id, to_json({'name': name})::VARCHAR AS detail FROM cur WHERE coalesce(trim(name), '') = ''",
    "COORD_MISSING": "SELECT source_id, to_json({'name': name})::VARCHAR AS detail FROM cur WHERE x_5186 IS NULL",
    "STATUS_DATE_CONFLICT": "SELECT source_id, coalesce(biz_status_name, '-') || '/' || coalesce(closed_date::VARCHAR, '-') AS detail FROM cur WHERE (biz_status_name NOT IN ('영업/정상', '영업') AND closed_date IS NULL) OR (biz_status_name IN ('영업/정상', '영업') AND closed_date IS NOT NULL)",
    "DATE_LOGIC_ERROR": "SELECT source_id, to_json({'licensed_date': licensed_date::VARCHAR, 'closed_date': closed_date::VARCHAR})::VARCHAR AS detail FROM cur WHERE licensed_date > closed_date",
    "DUPLICATE_NAME_ADDR": "SELECT source_id, to_json({'name': name, 'jibun': jibun_address, 'group_size': n})::VARCHAR AS detail FROM (SELECT *, count(*) OVER (PARTITION BY name, jibun_address) AS n FROM cur WHERE name IS NOT NULL) WHERE n > 1",
}


@query(f"{_WITH} {_RULES_SQL['NAME_MISSING']}")
def rule_name_missing(spark, sf_dir):
    return rules.name_missing(run(spark, sf_dir, True), None)


@query(f"{_WITH} {_RULES_SQL['COORD_MISSING']}")
def rule_coord_missing(spark, sf_dir):
    return rules.coord_missing(run(spark, sf_dir, True), None)


@query(f"{_WITH} {_RULES_SQL['STATUS_DATE_CONFLICT']}")
def rule_status_conflict(spark, sf_dir):
    found = rules.status_date_conflict(run(spark, sf_dir, True), None)
    field = lambda c: F.coalesce(F.get_json_object("detail", f"$.{c}"), F.lit("-"))
    return found.select("source_id", F.concat(field("status"), F.lit("/"), field("closed_date")).alias("detail"))


@query(f"{_WITH} {_RULES_SQL['DATE_LOGIC_ERROR']}")
def rule_date_logic(spark, sf_dir):
    return rules.date_logic(run(spark, sf_dir, True), None)


@query(f"{_WITH} {_RULES_SQL['DUPLICATE_NAME_ADDR']}")
def rule_duplicate(spark, sf_dir):
    return rules.duplicate_name_address(run(spark, sf_dir, True), None)


@query(f"{_WITH} SELECT c.source_id, to_json({{'moved_m': round(sqrt((c.x_5186 - p.x_5186) * (c.x_5186 - p.x_5186) + (c.y_5186 - p.y_5186) * (c.y_5186 - p.y_5186)), 1)}})::VARCHAR AS detail FROM cur c JOIN prev p USING (source_id) WHERE sqrt((c.x_5186 - p.x_5186) * (c.x_5186 - p.x_5186) + (c.y_5186 - p.y_5186) * (c.y_5186 - p.y_5186)) > 10")
def rule_moved(spark, sf_dir):
    return rules.coord_moved(run(spark, sf_dir, True), run(spark, sf_dir, False))


_ALL_SQL = " UNION ALL ".join(f"SELECT '{code}' AS rule_code, source_id FROM ({sql})" for code, sql in _RULES_SQL.items())
_MOVED_SQL = "SELECT 'COORD_MOVED', c.source_id FROM cur c JOIN prev p USING (source_id) WHERE sqrt((c.x_5186 - p.x_5186) * (c.x_5186 - p.x_5186) + (c.y_5186 - p.y_5186) * (c.y_5186 - p.y_5186)) > 10"


@query(f"{_WITH} SELECT rule_code, CASE WHEN rule_code IN ('NAME_MISSING', 'COORD_MISSING') THEN 'ERROR' ELSE 'WARN' END AS severity, count(*) AS n FROM ({_ALL_SQL} UNION ALL {_MOVED_SQL}) GROUP BY ALL")
def rule_summary(spark, sf_dir):
    return rules.summary(rules.findings(run(spark, sf_dir, True), run(spark, sf_dir, False), 2))


@query(f"{_WITH} SELECT source_id, NOT (coalesce(trim(name), '') = '' OR x_5186 IS NULL) AS is_valid FROM cur")
def rule_apply(spark, sf_dir):
    cur = run(spark, sf_dir, True)
    return rules.apply(cur, rules.findings(cur)).select("source_id", "is_valid")


@query(f"{_WITH}, j AS (SELECT p.source_id AS p, c.source_id AS c, p.biz_status_name IN ('영업/정상', '영업') AS pa, c.biz_status_name IN ('영업/정상', '영업') AS ca FROM prev p FULL OUTER JOIN cur c USING (source_id)) SELECT count(*) FILTER (p IS NULL) AS n_new, count(*) FILTER (p IS NOT NULL AND c IS NOT NULL) AS n_kept, count(*) FILTER (c IS NULL) AS n_vanished, count(*) FILTER (pa AND NOT ca) AS n_closed FROM j")
def run_diff(spark, sf_dir):
    active = F.col("biz_status_name").isin("영업/정상", "영업")
    return ingest.run_diff(run(spark, sf_dir, False), run(spark, sf_dir, True), active)


def _serving(df):
    status = F.when(is_active(F.col("biz_status_name")), "ACTIVE").otherwise("CLOSED")
    return df.where("x_5186 IS NOT NULL AND trim(name) <> ''").select(F.lit("A").alias("source"), "source_id", "name", F.coalesce("road_address", "jibun_address").alias("address"), status.alias("status"))


def _served(spark, sf_dir):
    old = _serving(run(spark, sf_dir, False)).withColumn("first_seen", F.lit(1)).withColumn("last_seen", F.lit(1))
    return ingest.upsert(old, _serving(run(spark, sf_dir, True)), ["source", "source_id"], 2)


_SERVING = "SELECT 'A' AS source, source_id, name, coalesce(road_address, jibun_address) AS address, CASE WHEN coalesce(biz_status_name, '') IN ('영업/정상', '영업') THEN 'ACTIVE' ELSE 'CLOSED' END AS status FROM {t} WHERE x_5186 IS NOT NULL AND trim(name) <> ''"
_UPSERT = f"{_WITH}, o AS ({_SERVING.format(t='prev')}), n AS ({_SERVING.format(t='cur')}), u AS (SELECT source, source_id, coalesce(n.name, o.name) AS name, coalesce(n.address, o.address) AS address, coalesce(n.status, o.status) AS status, CASE WHEN o.source_id IS NULL THEN 2 ELSE 1 END AS first_seen, CASE WHEN n.source_id IS NULL THEN 1 ELSE 2 END AS last_seen FROM o FULL OUTER JOIN n USING (source, source_id))"


@query(f"{_UPSERT} SELECT * FROM u")
def upsert_serving(spark, sf_dir):
    return _served(spark, sf_dir)


@query(f"{_UPSERT} SELECT status, last_seen, count(*) AS n FROM (SELECT CASE WHEN status = 'ACTIVE' AND last_seen < 2 THEN 'CLOSED' ELSE status END AS status, last_seen FROM u) GROUP BY ALL")
def vanished_closed(spark, sf_dir):
    return ingest.close_vanished(_served(spark, sf_dir), 2).groupBy("status", "last_seen").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT p_brand AS raw, min(p_type) AS category FROM part WHERE p_size < 10 GROUP BY 1), f AS (SELECT p_brand AS raw, max(p_type) AS category FROM part GROUP BY 1) SELECT * FROM k UNION ALL SELECT * FROM f WHERE raw NOT IN (SELECT raw FROM k)")
def dict_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.where("p_size < 10").groupBy(F.col("p_brand").alias("raw")).agg(F.min("p_type").alias("category"))
    return ingest.insert_absent(known, p.groupBy(F.col("p_brand").alias("raw")).agg(F.max("p_type").alias("category")), "raw")


_RUNS = "SELECT event_type AS source, event_id % 11 + (event_id % 11) // 2 AS run_id, value FROM events"


@query(f"WITH r AS ({_RUNS}), d AS (SELECT DISTINCT source, run_id FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_id DESC) AS k FROM d) SELECT source, run_id, count(*) AS n FROM r WHERE (source, run_id) NOT IN (SELECT (source, run_id) FROM k WHERE k > 7) GROUP BY ALL")
def retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS source", "event_id % 11 + (event_id % 11) div 2 AS run_id", "value")
    return ingest.prune(rows, 7).groupBy("source", "run_id").agg(F.count("*").alias("n"))


@query(f"WITH r AS ({_RUNS}), d AS (SELECT DISTINCT source, run_id FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_id DESC) AS k FROM d) SELECT source, run_id, count(*) AS n FROM r WHERE (source, run_id) NOT IN (SELECT (source, run_id) FROM k WHERE k > 7) GROUP BY ALL")
def retention_by_partition(spark, sf_dir):
    """The same by folders: runs are partitions of a written table, and expired ones are removed whole."""
    folder = f"{shared_dir(spark)}/runs-{uuid4().hex}"
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS source", "event_id % 11 + (event_id % 11) div 2 AS run_id", "value")
    readers.write_runs(rows.repartition("source", "run_id"), folder, "source", "run_id")
    ingest.expire_partitions(spark, folder, 7)
    return spark.read.parquet(folder).groupBy("source", F.col("run_id").cast("long").alias("run_id")).agg(F.count("*").alias("n"))


_LEDGER = "SELECT event_type AS source, event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'FAILED' WHEN event_id % 7 = 0 THEN 'SKIPPED' ELSE 'SUCCESS' END AS status, floor(value * 10)::BIGINT AS rows_valid FROM events"
_LEDGER_SPARK = ["event_type AS source", "event_id AS id", "CASE WHEN event_id % 5 = 0 THEN 'FAILED' WHEN event_id % 7 = 0 THEN 'SKIPPED' ELSE 'SUCCESS' END AS status", "CAST(floor(value * 10) AS BIGINT) AS rows_valid"]


@query(f"SELECT *, coalesce(rows_valid < 0.7 * before, false) AS dropped FROM (SELECT source, id, status, rows_valid, lag(rows_valid) OVER (PARTITION BY source ORDER BY id) AS before FROM ({_LEDGER}) WHERE status = 'SUCCESS')")
def valid_drop(spark, sf_dir):
    return ingest.valid_drop(table(spark, sf_dir, "events").selectExpr(*_LEDGER_SPARK))


@query(f"SELECT source, max(id) AS id FROM ({_LEDGER}) WHERE status = 'SUCCESS' AND source = 'click' GROUP BY source")
def last_success(spark, sf_dir):
    return ingest.last_success(table(spark, sf_dir, "events").selectExpr(*_LEDGER_SPARK), "click").select("source", "id")


@query("SELECT * EXCLUDE k FROM (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(spark, sf_dir):
    return ingest.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT * EXCLUDE k FROM (SELECT conv_id, turn, role, length(text)::BIGINT AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def keep_first(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    return ingest.keep_first(c, "conv_id", "turn")


@query("WITH f AS (SELECT l_returnflag AS source, l_suppkey % 9 AS run_id, l_linestatus AS rule FROM lineitem WHERE l_suppkey % 9 <> 8 OR l_returnflag = 'N') SELECT source, run_id, rule, count(*) AS n FROM f JOIN (SELECT source, max(run_id) AS run_id FROM f GROUP BY 1) USING (source, run_id) GROUP BY ALL")
def validation_summary(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS source", "l_suppkey % 9 AS run_id", "l_linestatus AS rule").where("run_id <> 8 OR source = 'N'")
    return ingest.latest_with_findings(f).groupBy("source", "run_id", "rule").agg(F.count("*").alias("n"))


@query(f"SELECT count(x) AS located, count(*) FILTER (NOT (x BETWEEN 150000 AND 228000 AND y BETWEEN 500000 AND 600000)) AS outside, count(*) FILTER (NOT (x BETWEEN 150000 AND 228000 AND y BETWEEN 500000 AND 600000)) / count(x) AS ratio, count(*) FILTER (NOT (x BETWEEN 150000 AND 228000 AND y BETWEEN 500000 AND 600000)) / count(x) > 0.01 AS alarm FROM {points_sql('part')}")
def out_of_box(spark, sf_dir):
    return ingest.out_of_box(points(spark, sf_dir, "part"), "x", "y", (150_000.0, 500_000.0, 228_000.0, 600_000.0))


# --- from files ------------------------------------------------------------------------------------

#: A register as its publisher has it: every 29th place stands twice, the last line counts; every 31st line is broken.
_LINES = [
    "CASE WHEN cast(source_id AS bigint) % 29 = 0 THEN array(concat(name, ' old'), name) ELSE array(name) END AS names",
    "date_format(licensed_date, CASE WHEN cast(source_id AS bigint) % 2 = 0 THEN 'yyyyMMdd' ELSE 'yyyy-MM-dd' END) AS licensed",
    "date_format(closed_date, 'yyyy-MM-dd HH:mm:ss') AS closed",
    "cast(x_5186 AS string) AS x",
    "cast(y_5186 AS string) AS y",
]
_FIELDS = {"mgmt_no": "source_id", "biz_name": "n", "biz_type_name": "category_raw", "road_address": "road_address", "jibun_address": "jibun_address", "biz_status_name": "biz_status_name", "license_date": "licensed", "closed_date": "closed", "coord_x": "x", "coord_y": "y"}


def _register_files(spark, sf_dir, current, path):
    rows = run(spark, sf_dir, current).selectExpr("*", *_LINES).selectExpr("*", "posexplode(names) AS (k, n)")
    fields = [F.coalesce(F.col(_FIELDS[c]), F.lit("")) if c in _FIELDS else F.lit("") for c in readers.LICENCE_COLUMNS]
    line = F.concat_ws(",", *fields)
    lines = F.when(F.col("source_id").cast("long") % 31 == 0, F.array(line, F.concat(line, F.lit(",too,many")))).otherwise(F.array(line))
    readers.write_lines(rows.select(F.explode(lines).alias("line")), path, ",".join(readers.LICENCE_COLUMNS))


def _ingested(spark, sf_dir):
    """(folder, ledger) of four runs from files: new, the same again, changed, and one whose files are gone."""
    folder = f"{shared_dir(spark)}/ingest-{uuid4().hex}"
    with readers.legacy(spark):
        return folder, _runs(spark, sf_dir, folder)


def _runs(spark, sf_dir, folder):
    for name, current in (("before", False), ("now", True)):
        _register_files(spark, sf_dir, current, f"{folder}/files/{name}")
    for name in ("before", "before", "now", "gone"):
        source = readers.Source("FOOD", "places", f"{folder}/files/{name}")
        gone = name == "gone"
        found = [] if gone else readers.against(spark, source.path, None, readers.LICENCE_COLUMNS)
        if found:
            raise ValueError(f"{source.path}: {found}")
        digest = "none" if gone else readers.contents_sha256(spark, source.path)
        ledger = runs.run_all(spark, folder, [runs.Input(source.code, digest, lambda source=source: readers.licences(spark, source))])
    return ledger


_VALID = "x_5186 IS NOT NULL AND trim(name) <> ''"
_ROWS = "(SELECT sum(CASE WHEN source_id::BIGINT % 29 = 0 THEN 2 ELSE 1 END)::BIGINT FROM {t})"


@query(f"""{_WITH}, j AS (SELECT p.source_id AS p, c.source_id AS c, p.biz_status_name IN ('영업/정상', '영업') AS pa, c.biz_status_name IN ('영업/정상', '영업') AS ca FROM prev p FULL OUTER JOIN cur c USING (source_id)),
o AS (SELECT coalesce(pa, false) AS pa, coalesce(ca, false) AS ca, p, c FROM j)
SELECT 1::BIGINT AS id, 'SUCCESS' AS status, {_ROWS.format(t='prev')} AS rows_raw, (SELECT count(*) FROM prev WHERE {_VALID}) AS rows_valid, (SELECT count(*) FROM prev) AS n_new, 0::BIGINT AS n_kept, 0::BIGINT AS n_vanished, 0::BIGINT AS n_closed
UNION ALL SELECT 2, 'SKIPPED', 0, 0, 0, 0, 0, 0
UNION ALL SELECT 3, 'SUCCESS', {_ROWS.format(t='cur')}, (SELECT count(*) FROM cur WHERE {_VALID}), count(*) FILTER (p IS NULL), count(*) FILTER (p IS NOT NULL AND c IS NOT NULL), count(*) FILTER (c IS NULL), count(*) FILTER (p IS NOT NULL AND c IS NOT NULL AND pa AND NOT ca) FROM o
UNION ALL SELECT 4, 'FAILED', NULL, NULL, NULL, NULL, NULL, NULL""")
def ingest_ledger(spark, sf_dir):
    """The ledger of four runs of a register in files of the legacy encoding, with broken and repeated lines."""
    return _ingested(spark, sf_dir)[1].select("id", "status", "rows_raw", "rows_valid", "n_new", "n_kept", "n_vanished", "n_closed")


_SERVED_FILES = "SELECT source_id, trim(name) AS name, category_raw, licensed_date, closed_date, CASE WHEN coalesce(biz_status_name, '') IN ('영업/정상', '영업') THEN 'ACTIVE' ELSE 'CLOSED' END AS status FROM {t} WHERE " + _VALID


@query(f"""{_WITH}, o AS ({_SERVED_FILES.format(t='prev')}), n AS ({_SERVED_FILES.format(t='cur')})
SELECT source_id, coalesce(n.name, o.name) AS name, coalesce(n.category_raw, o.category_raw) AS category_raw, CASE WHEN n.source_id IS NULL THEN o.licensed_date ELSE n.licensed_date END AS licensed_date, CASE WHEN n.source_id IS NULL THEN o.closed_date ELSE n.closed_date END AS closed_date,
  CASE WHEN n.source_id IS NULL THEN 'CLOSED' ELSE n.status END AS status, CASE WHEN o.source_id IS NULL THEN 3 ELSE 1 END::BIGINT AS first_seen, CASE WHEN n.source_id IS NULL THEN 1 ELSE 3 END::BIGINT AS last_seen FROM o FULL OUTER JOIN n USING (source_id)""")
def ingest_serving(spark, sf_dir):
    """What those runs serve in the end; the failed one has changed nothing."""
    folder, _ = _ingested(spark, sf_dir)
    return runs.served(spark, folder, "FOOD").select("source_id", "name", "category_raw", "licensed_date", "closed_date", "status", "first_seen", "last_seen")
