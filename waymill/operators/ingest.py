"""From raw register rows to the serving table, one run at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.functions import crs, scalars

#: The box that register coordinates should lie in (metres), and the alarm ratio of those outside.
BOX = (150_000.0, 500_000.0, 250_000.0, 600_000.0)
ALARM = 0.01


def staging(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows, the last of each key; one row of out-of-box gauges) of raw register rows with raw_id."""
    x, y = F.col("coord_x").try_cast("double"), F.col("coord_y").try_cast("double")
    named = raw.select(
        "raw_id",
        scalars.strip(F.col("mgmt_no")).alias("source_id"),
        scalars.strip(F.col("biz_name")).alias("name"),
        scalars.strip(F.col("biz_type_name")).alias("category_raw"),
        scalars.strip(F.col("road_address")).alias("road_address"),
        scalars.strip(F.col("jibun_address")).alias("jibun_address"),
        scalars.strip(F.col("phone")).alias("phone"),
        scalars.strip(F.col("biz_status_name")).alias("biz_status_name"),
        scalars.parse_date(F.col("license_date")).alias("licensed_date"),
        scalars.parse_date(F.col("closed_date")).alias("closed_date"),
        x.alias("coord_x_raw"),
        y.alias("coord_y_raw"),
    ).where("source_id IS NOT NULL")
    typed = crs.to_5186(named, "coord_x_raw", "coord_y_raw", "x_5186", "y_5186")
    return keep_last(typed, "source_id", "raw_id"), out_of_box(typed)


def out_of_box(df: DataFrame, x: str = "x_5186", y: str = "y_5186", box: tuple = BOX) -> DataFrame:
    """located, outside, ratio, alarm: rows without coordinates count in neither."""
    inside = F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])
    out = df.agg(F.count(x).alias("located"), F.count_if(~inside).alias("outside"))
    ratio = F.coalesce(F.try_divide("outside", "located"), F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("alarm", ratio > ALARM)


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest order of each key. The aggregate combines before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_r"))
    return best.select("_r.*")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    best = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_r"))
    return best.select("_r.*")


def run_diff(previous: DataFrame | None, current: DataFrame, active: Column) -> DataFrame:
    """One row of n_new, n_kept, n_vanished, n_closed between staging runs (source_id, biz_status_name).

    Without a previous run all rows are new. Closed needs both sides, and a status that isn't null.
    """
    if previous is None:
        zero = F.lit(0).cast("long")
        return current.agg(F.count("*").alias("n_new"), zero.alias("n_kept"), zero.alias("n_vanished"), zero.alias("n_closed"))
    p = previous.select(F.col("source_id").alias("p_id"), active.alias("p_active"))
    c = current.select(F.col("source_id").alias("c_id"), active.alias("c_active"))
    both = p.join(c, F.col("p_id") == F.col("c_id"), "full_outer")
    return both.agg(
        F.count_if(F.col("p_id").isNull()).alias("n_new"),
        F.count_if(F.col("p_id").isNotNull() & F.col("c_id").isNotNull()).alias("n_kept"),
        F.count_if(F.col("c_id").isNull()).alias("n_vanished"),
        F.count_if(F.col("p_active") & ~F.col("c_active")).alias("n_closed"),
    )


def upsert(serving: DataFrame, fresh: DataFrame, key: list[str], run_id: int) -> DataFrame:
    """The serving table with fresh rows in: first_seen stays, everything else is theirs, last_seen is the run."""
    rest = [c for c in serving.columns if c not in (*key, "first_seen", "last_seen")]
    f = fresh.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_fresh"))
    joined = serving.join(f, key, "full_outer")
    new = F.coalesce("_fresh", F.lit(False))
    return joined.select(
        *key,
        *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest],
        F.coalesce("first_seen", F.lit(run_id)).alias("first_seen"),
        F.when(new, F.lit(run_id)).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def insert_absent(known: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The dictionary with fresh keys added; known entries win."""
    return known.unionByName(fresh.join(known.select(key), key, "left_anti"))


def overwrite(known: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """A dictionary in which fresh entries replace known ones of the same key, whole."""
    return fresh.unionByName(known.join(fresh.select(*key), key, "left_anti").select(*fresh.columns))


def close_vanished(serving: DataFrame, run_id: int) -> DataFrame:
    """Open rows that the run didn't bring are closed; rows that a rule rejected weren't brought."""
    gone = (F.col("status") == "ACTIVE") & (F.col("last_seen") < run_id)
    return serving.withColumn("status", F.when(gone, F.lit("CLOSED")).otherwise(F.col("status")))


def expired_runs(rows: DataFrame, keep: int) -> DataFrame:
    """(source, run_id) of runs with data beyond the ``keep`` latest of each source; runs without data don't count."""
    runs = rows.select("source", "run_id").distinct()
    return runs.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("run_id")))).where(F.col("k") > keep).select("source", "run_id")


def prune(rows: DataFrame, keep: int) -> DataFrame:
    return rows.join(expired_runs(rows, keep), ["source", "run_id"], "left_anti")


def run_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """(source, run_id, folder) of the partitions with data of a table partitioned by source and run. Only folders are listed."""
    from urllib.parse import unquote

    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for of_source in system.listStatus(root) if system.exists(root) else []:
        for of_run in system.listStatus(of_source.getPath()) if of_source.isDirectory() and "=" in of_source.getPath().getName() else []:
            here = of_run.getPath()
            if of_run.isDirectory() and any(s.getLen() for s in system.listStatus(here)):
                found.append((unquote(of_source.getPath().getName().split("=", 1)[1]), int(here.getName().split("=", 1)[1]), here.toString()))
    return spark.createDataFrame(found, "source string, run_id long, folder string")


def expire_partitions(spark: SparkSession, folder: str, keep: int) -> int:
    """Removes the runs beyond the ``keep`` latest of each source from a table partitioned by source and run, and says how many.

    Whole folders go; no file of a run that stays is read or written. A run that is gone already is none.
    """
    here = run_partitions(spark, folder)
    gone = here.join(expired_runs(here, keep), ["source", "run_id"], "left_semi").select("folder").collect()
    path = spark._jvm.org.apache.hadoop.fs.Path
    for row in gone:
        at = path(row.folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def last_success(ledger: DataFrame, source: str) -> DataFrame:
    """The latest successful run of a source, if any."""
    return ledger.where((F.col("source") == source) & (F.col("status") == "SUCCESS")).orderBy(F.desc("id")).limit(1)


def unchanged(ledger: DataFrame, source: str, file_hash: str) -> bool:
    """Whether the file is the one of the last successful run."""
    row = last_success(ledger, source).select("file_hash").first()
    return row is not None and row[0] == file_hash


def valid_drop(ledger: DataFrame, least: float = 0.7) -> DataFrame:
    """Successful runs with the valid rows of the one before, and whether they fell below ``least`` of it."""
    good = ledger.where("status = 'SUCCESS'")
    before = F.lag("rows_valid").over(W.partitionBy("source").orderBy("id"))
    return good.withColumn("before", before).withColumn("dropped", F.coalesce(F.col("rows_valid") < least * F.col("before"), F.lit(False)))


def latest_with_findings(findings: DataFrame) -> DataFrame:
    """The findings of each source's latest run that has any."""
    latest = findings.groupBy("source").agg(F.max("run_id").alias("run_id"))
    return findings.join(latest, ["source", "run_id"], "left_semi")
