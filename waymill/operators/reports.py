"""Reports of runs, searches and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_daily(runs: DataFrame, since: str | None = None, zone: str = "Asia/Seoul") -> DataFrame:
    """One row a local day: runs, failures, median and p95 milliseconds of successes from the cache, unreachable cells."""
    r = runs if since is None else runs.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    day = F.to_date(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), zone)).alias("day")
    timed = (F.col("status") == "SUCCESS") & (F.col("source") == "CACHE")
    ms = F.when(timed, F.col("elapsed_ms"))
    return r.groupBy(day).agg(
        F.count_if(F.col("status") != "NOT_COMPUTABLE").alias("runs"),
        F.count_if(F.col("status") == "ERROR").alias("failures"),
        F.bround(F.percentile(ms, F.lit(0.5))).cast("long").alias("median_ms"),
        F.bround(F.percentile(ms, F.lit(0.95))).cast("long").alias("p95_ms"),
        F.coalesce(F.sum("unreachable"), F.lit(0)).alias("unreachable"),
    )


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts by source and severity with totals of each source and of all."""
    return findings.rollup("source", "severity").agg(F.count("*").alias("n"))


def expired(rows: DataFrame, ts: str, now: str, days: int = 30) -> DataFrame:
    """Rows younger than ``days`` before ``now``."""
    return rows.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def unnested(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Parallel arrays as rows with their ordinal ``ord`` from 1; where one is shorter its values are null."""
    rest = [c for c in df.columns if c not in arrays]
    each = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("_k", "_z"))
    return each.select(*rest, (F.col("_k") + 1).cast("long").alias("ord"), *[F.col(f"_z.{a}").alias(a) for a in arrays])


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal what is wanted; a column for which nothing is wanted is left alone."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df
