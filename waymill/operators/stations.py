"""Coordinates of stations out of a station master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.scalars import base_line, normalize_station


def located(stations: DataFrame, master: DataFrame, renamed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(stations with lat and lon, stations that have none) for stations (line, station).

    ``master`` is (line, station, lat, lon, place): line may be null, place is the order in the file. A
    station is looked up by its base line and name, then by name alone among all rows, those of
    unknown lines too; the first row of a key wins. ``renamed`` (line, station, other) has names
    that the master spells otherwise.
    """
    at = stations.withColumn("_line", base_line(F.col("line"))).withColumn("_name", F.col("station"))
    if renamed is not None:
        other = renamed.select(F.col("line").alias("_line"), F.col("station").alias("_name"), F.col("other").alias("_other"))
        at = at.join(other, ["_line", "_name"], "left").withColumn("_name", F.coalesce("_other", "_name"))
    at = at.withColumn("_name", normalize_station(F.col("_name")))
    point = F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    known = master.withColumn("_name", normalize_station(F.col("station"))).withColumn("_line", F.col("line"))
    by_line = known.where("_line IS NOT NULL").groupBy("_line", "_name").agg(F.min_by(point, "place").alias("_p"))
    by_name = known.groupBy("_name").agg(F.min_by(point, "place").alias("_q"))
    found = at.join(by_line, ["_line", "_name"], "left").join(by_name, "_name", "left")
    out = found.select(*[F.col(c) for c in stations.columns], F.coalesce("_p.lat", "_q.lat").alias("lat"), F.coalesce("_p.lon", "_q.lon").alias("lon"))
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    return out.where(~missing), out.where(missing).select(*stations.columns)
