"""Validation rules: each finds rows of a staged run and says why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.crs import planar
from waymill.functions.scalars import ACTIVE_STATES

Rule = Callable[[DataFrame, "DataFrame | None"], "DataFrame | None"]
ERROR, WARN = "ERROR", "WARN"


def name_missing(cur: DataFrame, prev: DataFrame | None) -> DataFrame:
    return cur.where(F.coalesce(F.trim("name"), F.lit("")) == "").select("source_id", F.to_json(F.struct("name")).alias("detail"))


def coord_missing(cur: DataFrame, prev: DataFrame | None) -> DataFrame:
    return cur.where("x_5186 IS NULL OR y_5186 IS NULL").select("source_id", F.to_json(F.struct("name")).alias("detail"))


def status_date_conflict(cur: DataFrame, prev: DataFrame | None) -> DataFrame:
    """Closed without a date, or open with one; a null status never fires."""
    active = F.col("biz_status_name").isin(*ACTIVE_STATES)
    hit = (~active & F.col("closed_date").isNull()) | (active & F.col("closed_date").isNotNull())
    return cur.where(hit).select("source_id", F.to_json(F.struct(F.col("biz_status_name").alias("status"), "closed_date")).alias("detail"))


def date_logic(cur: DataFrame, prev: DataFrame | None) -> DataFrame:
    return cur.where("licensed_date > closed_date").select("source_id", F.to_json(F.struct("licensed_date", "closed_date")).alias("detail"))


def duplicate_name_address(cur: DataFrame, prev: DataFrame | None) -> DataFrame:
    """Rows that share name and lot address; sizes are counted before rows are joined to them."""
    named = cur.where("name IS NOT NULL AND jibun_address IS NOT NULL")
    sizes = named.groupBy("name", "jibun_address").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return named.join(sizes, ["name", "jibun_address"]).select("source_id", F.to_json(F.struct("name", F.col("jibun_address").alias("jibun"), "group_size")).alias("detail"))


def coord_moved(cur: DataFrame, prev: DataFrame | None, metres: float = 10.0) -> DataFrame | None:
    """Further than ``metres`` from the run before; nothing on a first run."""
    if prev is None:
        return None
    old = prev.select("source_id", F.col("x_5186").alias("px"), F.col("y_5186").alias("py"))
    moved = cur.join(old, "source_id").withColumn("moved", planar(F.col("x_5186"), F.col("y_5186"), F.col("px"), F.col("py")))
    return moved.where(F.col("moved") > metres).select("source_id", F.to_json(F.struct(F.round("moved", 1).alias("moved_m"))).alias("detail"))


RULES: dict[str, tuple[str, Rule]] = {
    "NAME_MISSING": (ERROR, name_missing),
    "COORD_MISSING": (ERROR, coord_missing),
    "STATUS_DATE_CONFLICT": (WARN, status_date_conflict),
    "DATE_LOGIC_ERROR": (WARN, date_logic),
    "DUPLICATE_NAME_ADDR": (WARN, duplicate_name_address),
    "COORD_MOVED": (WARN, coord_moved),
}


def findings(cur: DataFrame, prev: DataFrame | None = None, run_id: int = 0) -> DataFrame:
    """(run_id, rule_code, severity, target_id, detail) of all rules."""
    out = None
    for code, (severity, rule) in RULES.items():
        found = rule(cur, prev)
        if found is None:
            continue
        found = found.select(F.lit(run_id).cast("long").alias("run_id"), F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), F.col("source_id").cast("string").alias("target_id"), "detail")
        out = found if out is None else out.unionByName(found)
    return out


def apply(cur: DataFrame, found: DataFrame) -> DataFrame:
    """The run with is_valid: false where a rule of severity ERROR fired."""
    bad = found.where(F.col("severity") == ERROR).select(F.col("target_id").alias("_t")).distinct().withColumn("_bad", F.lit(True))
    joined = cur.join(bad, cur.source_id.cast("string") == F.col("_t"), "left")
    return joined.select(*[cur[c] for c in cur.columns], F.col("_bad").isNull().alias("is_valid"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_code", "severity").agg(F.count("*").alias("n"))


