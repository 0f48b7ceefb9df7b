import pytest
from pyspark.sql import functions as F

from waymill.functions import crs


def test_known_point(spark):
    df = spark.createDataFrame([(198744.767994092, 451930.939476321)], "x double, y double")
    r = crs.to_5186(df, "x", "y", "e", "n").first()
    assert (r.e, r.n) == (pytest.approx(198814.38, abs=0.1), pytest.approx(552236.12, abs=0.1))


def test_round_trip(spark):
    df = spark.createDataFrame([(170_000.0 + 7000 * i, 520_000.0 + 9000 * i) for i in range(8)], "x double, y double")
    back = crs.forward(crs.inverse(df, crs.EPSG_5186, "x", "y", "lat", "lon"), crs.EPSG_5186, "lat", "lon", "x2", "y2")
    worst = back.select(F.max(crs.planar(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))).first()[0]
    assert worst < 1e-3


def test_haversine(spark):
    r = spark.range(1).select(crs.haversine(F.lit(37.5), F.lit(127.0), F.lit(37.5), F.lit(127.0)).alias("zero"), crs.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half")).first()
    assert r.zero == 0 and r.half == pytest.approx(20_015_114.35, rel=1e-6)
