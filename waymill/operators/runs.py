"""Ingest runs of registered sources: each leaves tables of its own and one row in the ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from waymill.functions.scalars import is_active
from waymill.operators import ingest, rules

LEDGER = (
    "id long, source string, status string, file_hash string, rows_raw long, rows_valid long, n_new long, n_kept long, n_vanished long, n_closed long, outside long, folder string, message string"
)
SERVED = ["name", "category_raw", "road_address", "jibun_address", "phone", "biz_status_name", "licensed_date", "closed_date", "x_5186", "y_5186", "status"]


@dataclass(frozen=True)
class Input:
    """A source's rows of today, and the hash of the file that they come from."""

    source: str
    file_hash: str
    read: Callable[[], DataFrame]


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")


def served(spark: SparkSession, folder: str, source: str) -> DataFrame | None:
    """The serving table that the source's last successful run wrote; none before the first."""
    last = ingest.last_success(ledger(spark, folder), source).first()
    return spark.read.parquet(f"{last.folder}/serving") if last else None


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _one(spark: SparkSession, folder: str, given: Input, run_id: int) -> Row:
    """Stages, checks, compares and merges one source. Everything is written beside what is served."""
    last = ingest.last_success(ledger(spark, folder), given.source).first()
    if last is not None and last.file_hash == given.file_hash:
        return Row(status="SKIPPED", file_hash=given.file_hash, rows_raw=0, rows_valid=0, n_new=0, n_kept=0, n_vanished=0, n_closed=0, outside=0, folder=None, message=None)
    place = f"{folder}/runs/{given.source}-{run_id}-{uuid4().hex[:8]}"
    raw = _write(given.read(), f"{place}/raw")
    rows, gauges = ingest.staging(raw)
    current = _write(rows, f"{place}/staging")
    previous = spark.read.schema(current.schema).parquet(f"{last.folder}/staging") if last else None
    found = _write(rules.findings(current, previous, run_id), f"{place}/findings")
    marked = rules.apply(current, found)
    valid = _write(marked.where("is_valid").withColumn("status", F.when(is_active(F.col("biz_status_name")), "ACTIVE").otherwise("CLOSED")).select("source_id", *SERVED), f"{place}/valid")
    if last is None:
        out = valid.withColumn("first_seen", F.lit(run_id).cast("long")).withColumn("last_seen", F.lit(run_id).cast("long"))
    else:
        old = spark.read.parquet(f"{last.folder}/serving")
        out = ingest.close_vanished(ingest.upsert(old, valid, ["source_id"], run_id), run_id)
    out.select("source_id", *SERVED, F.col("first_seen").cast("long"), F.col("last_seen").cast("long")).write.parquet(f"{place}/serving")
    diff = ingest.run_diff(previous, current, is_active(F.col("biz_status_name"))).first()
    return Row(status="SUCCESS", file_hash=given.file_hash, rows_raw=raw.count(), rows_valid=valid.count(), **diff.asDict(), outside=gauges.first().outside, folder=place, message=None)


def run_all(spark: SparkSession, folder: str, inputs: Iterable[Input]) -> DataFrame:
    """Runs every source once and returns the ledger.

    A source whose file is that of its last success is skipped. One that fails leaves a FAILED row and
    its serving table as it was, and the others still run: a run is published by its ledger row alone,
    which is written last.
    """
    next_id = (ledger(spark, folder).agg(F.max("id")).first()[0] or 0) + 1
    for run_id, given in enumerate(inputs, next_id):
        try:
            row = _one(spark, folder, given, run_id).asDict()
        except Exception as e:  # noqa: BLE001 - the failure is the row's content
            row = {"status": "FAILED", "file_hash": given.file_hash, "message": f"{type(e).__name__}: {e}"[:500]}
        names = [c.split()[0] for c in LEDGER.split(", ")]
        row |= {"id": run_id, "source": given.source}
        spark.createDataFrame([tuple(row.get(n) for n in names)], LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    return ledger(spark, folder)
