"""Places: by distance, by name, and one by one with where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.functions.crs import planar
from waymill.functions.scalars import round_half_up
from waymill.operators.spatial import around, clamped

#: Findings that a place's detail lists.
FINDINGS = 50


def kept(places: DataFrame, closed: bool = False, category: str | None = None) -> DataFrame:
    """Open places, the closed ones too if asked, of one category if one is given; a blank category is none."""
    out = places if closed else places.where("status = 'ACTIVE'")
    return out.where(F.col("category") == category) if category and category.strip() else out


def nearby(places: DataFrame, x: float, y: float, radius: int | None = None, limit: int | None = None, closed: bool = False, category: str | None = None) -> DataFrame:
    """Places (id, x, y, status, category, ...) about a point in metres, the nearest first, with ``distance_m`` to a tenth."""
    out = around(kept(places, closed, category), x, y, radius, limit)
    return out.withColumn("distance_m", round_half_up(F.col("distance"), 1)).drop("distance")


def search(places: DataFrame, text: str, at: tuple[float, float] | None = None, radius: int | None = None, limit: int | None = None, closed: bool = False, category: str | None = None) -> DataFrame:
    """Places whose name holds a text as LIKE has it: the nearest first where there is a point, else by name.

    A radius counts with a point only, and only if it is over zero. Ties go by id.
    """
    radius_, limit_ = clamped(radius, limit)
    out = kept(places, closed, category).where(F.col("name").like("%" + text.replace("\\", "\\\\") + "%"))
    if at is None:
        return out.withColumn("distance_m", F.lit(None).cast("double")).orderBy("name", "id").limit(limit_)
    x, y = (F.lit(float(v)) for v in at)
    if radius and radius > 0:
        out = out.where(F.col("x").between(x - radius_, x + radius_) & F.col("y").between(y - radius_, y + radius_))
    out = out.withColumn("_d", planar(F.col("x"), F.col("y"), x, y))
    if radius and radius > 0:
        out = out.where(F.col("_d") <= radius_)
    return out.orderBy(F.asc_nulls_last("_d"), "id").limit(limit_).withColumn("distance_m", round_half_up(F.col("_d"), 1)).drop("_d")


def details(places: DataFrame, runs: DataFrame, findings: DataFrame, limit: int = FINDINGS) -> DataFrame:
    """Places with the dates of the runs that saw them first and last, and their latest findings.

    ``places`` are (id, source, source_id, first_seen, last_seen, ...), ``runs`` (id, source, snapshot_date), findings (run_id, target_id,
    rule_code, severity, detail). A source_id means a place only together with its source: findings are those of runs of
    the place's own source, by run (latest first), severity and rule, ``limit`` at most. Without any the list is empty.
    """
    dated = lambda name: runs.select(F.col("id").alias(f"{name}_seen"), F.col("snapshot_date").alias(f"{name}_date"))
    sourced = findings.join(runs.select(F.col("id").alias("run_id"), "source"), "run_id")
    order = W.partitionBy("source", "target_id").orderBy(F.desc("run_id"), "severity", "rule_code", "detail")
    latest = sourced.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit)
    listed = latest.groupBy("source", F.col("target_id").alias("source_id")).agg(F.array_sort(F.collect_list(F.struct("k", "run_id", "rule_code", "severity", "detail"))).alias("_f"))
    out = places.join(dated("first"), "first_seen", "left").join(dated("last"), "last_seen", "left").join(listed, ["source", "source_id"], "left")
    none = F.array().cast("array<struct<run_id:bigint,rule_code:string,severity:string,detail:string>>")
    rows = F.transform("_f", lambda f: F.struct(f["run_id"].cast("long").alias("run_id"), f["rule_code"].alias("rule_code"), f["severity"].alias("severity"), f["detail"].alias("detail")))
    return out.select(*places.columns, "first_date", "last_date", F.coalesce(rows, none).alias("findings"))
