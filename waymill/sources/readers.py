"""Readers and writers of registers and timetables, and the checks a fetched file must pass."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CP949, UTF8_BOM = "x-windows-949", "UTF-8"

# The columns of the licence register in their order.
LICENCE_COLUMNS = (
    "open_local_gov_code mgmt_no license_date biz_status_name closed_date site_area site_postal_code road_postal_code biz_name "
    "biz_type_name data_update_type building_ownership factory_office_staff factory_prod_staff factory_sales_staff water_facility_type "
    "male_staff multi_use_yn data_updated_at road_address grade_type deposit hq_staff detail_status_name detail_status_code "
    "total_facility_scale female_staff biz_status_code surroundings_type monthly_rent hygiene_biz_type traditional_main_food "
    "traditional_desig_no phone coord_x coord_y jibun_address homepage last_modified_at"
).split()
LICENCE = T.StructType([T.StructField(c, T.StringType()) for c in LICENCE_COLUMNS])


@dataclass(frozen=True)
class Source:
    code: str
    label: str
    path: str
    encoding: str = CP949


class Catalogue:
    """The registered sources by code."""

    def __init__(self, *sources: Source):
        self._by_code = {s.code: s for s in sources}
        if len(self._by_code) != len(sources):
            raise ValueError("a source code is registered twice")

    def __getitem__(self, code: str) -> Source:
        return self._by_code[code]

    def codes(self) -> list[str]:
        return list(self._by_code)


@contextlib.contextmanager
def legacy(spark: SparkSession) -> Iterator[None]:
    """Within it the session reads and writes CP949 and judges whole CSV rows, whatever it was configured with."""
    wanted = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.csv.parser.columnPruning.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def csv(spark: SparkSession, path: str, encoding: str = UTF8_BOM, schema: T.StructType | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """An all-string CSV with a header; rows with too many or too few fields are skipped.

    With a schema the fields are taken by place. CP949 needs spark.sql.legacy.javaCharsets, and skipping
    whole bad rows under a narrow selection spark.sql.csv.parser.columnPruning.enabled=false (see session, or ``legacy``).
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED")
    df = reader.schema(schema).option("enforceSchema", True).csv(path) if schema else reader.option("inferSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if columns:
        df = df.select(*columns)
    return df.limit(limit) if limit is not None else df


def licences(spark: SparkSession, source: Source, limit: int | None = None) -> DataFrame:
    """A licence register with ``raw_id``, the order in the file: of a single file, Spark numbers rows in order."""
    df = csv(spark, source.path, source.encoding, LICENCE, limit=limit)
    return df.withColumn("raw_id", F.monotonically_increasing_id())


def walk_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and edges (src, dst, length) of a GraphML file."""
    keys = spark.read.format("xml").option("rowTag", "key").load(path).select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"))
    names = {r["name"]: r["key"] for r in keys.collect()}

    def value(name: str):
        return F.element_at(F.transform(F.filter("data", lambda d: d["_key"] == names[name]), lambda d: d["_VALUE"].cast("double")), 1)

    data = T.StructField("data", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())])))
    node = T.StructType([T.StructField("_id", T.StringType()), data])
    edge = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), data])
    nodes = spark.read.format("xml").option("rowTag", "node").schema(node).load(path).select(F.col("_id").alias("id"), value("x").alias("x"), value("y").alias("y"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema(edge).load(path).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("length").alias("length"))
    return nodes, edges


def jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A database query read with a cursor of ``fetch`` rows."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()


def write_runs(df: DataFrame, path: str, *keys: str) -> None:
    """Appends a run or build as partitions of its own, by ``keys``, run_id if there are none."""
    df.write.mode("append").partitionBy(*(keys or ("run_id",))).parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(form).save(path)


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def contents_sha256(spark: SparkSession, path: str) -> str:
    """One hash of a file, or of all files of a folder by name, in any store that Spark reads.

    Each file is hashed where it is read; what comes back is a hash a file. Where the same bytes are split over other files
    the hash is another.
    """
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("h"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "name", "h")))
    return files.agg(F.sha2(F.array_join(listed, ",").cast("binary"), 256)).first()[0]


def against(spark: SparkSession, new: str, old: str | None, header: list[str], encoding: str = CP949, least: float = 0.8) -> list[str]:
    """``accepted`` for files or folders in any store that Spark reads: the header of every file, and sizes in all."""
    sizes = lambda path: spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    found = []
    # The line is cut as bytes, so that no character is. No byte within a character of these encodings is a line's end.
    line = F.encode(F.substring_index(F.decode(F.substring("content", 1, 1 << 16), "ISO-8859-1"), "\n", 1), "ISO-8859-1")
    first = F.split(F.regexp_replace(F.decode(line, encoding), "^\ufeff|\r$", ""), ",")
    heads = spark.read.format("binaryFile").load(new).where("length > 0").select(F.transform(first, lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))).alias("h"))
    seen = heads.agg(F.count("*").alias("n"), F.count_if(F.col("h") != F.array(*[F.lit(c) for c in header])).alias("others")).first()
    if seen.others or not seen.n:
        found.append("header")
    if old is not None and sizes(new) < least * sizes(old):
        found.append("size")
    return found


def write_lines(df: DataFrame, path: str, header: str, encoding: str = CP949) -> None:
    """A text column ``line`` written as it is, in a legacy encoding, with the header line atop each file."""
    df.select(F.col("line").alias(header)).write.option("header", True).option("encoding", encoding).option("sep", "\u0001").option("quote", "\u0000").option("escape", "\u0000").option("emptyValue", "").csv(path)


def accepted(new: str, old: str | None, header: list[str], name: str, encoding: str = "cp949", least: float = 0.8) -> list[str]:
    """What speaks against a fetched file: its name, its header, or its size against the one before."""
    against = []
    if Path(new).suffix.removesuffix(".part") not in ("", ".csv") or name not in Path(new).name:
        against.append("name")
    with open(new, encoding=encoding, errors="replace") as f:
        if [c.strip().strip('"') for c in f.readline().rstrip("\r\n").lstrip("﻿").split(",")] != header:
            against.append("header")
    if old and Path(old).exists() and Path(new).stat().st_size < least * Path(old).stat().st_size:
        against.append("size")
    return against
