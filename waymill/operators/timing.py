"""Leg times, headways and boarding weights from timetables.

Timetable rows: line, direction, train, station, arrive, depart (seconds of the service day), id; ``day`` if there are several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymill.functions.scalars import NO_SERVICE, board_wait, is_express, service_hour

#: Plausible run times and headways in seconds.
RUN, HEADWAY = (1, 1800), (1, 3600)


def leg_times(stops: DataFrame, *days: str) -> DataFrame:
    """(line, a, b, seconds, samples): the median time from one departure to the next stop's of the same train."""
    order = W.partitionBy("line", "direction", "train", *days).orderBy("arrive", "id")
    legs = stops.select("line", F.col("station").alias("a"), F.lead("station").over(order).alias("b"), (F.lead("depart").over(order) - F.col("depart")).alias("run"))
    good = legs.where(F.col("run").between(*RUN) & (F.col("a") != F.col("b")))
    return good.groupBy("line", "a", "b").agg(F.percentile("run", F.lit(0.5)).alias("seconds"), F.count("*").alias("samples"))


def headways(stops: DataFrame, *days: str) -> DataFrame:
    """(line, station, direction, hour, seconds, samples): medians of the gaps between arrivals.

    Gaps are taken over the whole day and belong to the hour of the later train; hours are never
    filtered before, so that the first train of an hour has a gap.
    """
    order = W.partitionBy("line", "station", "direction", *days).orderBy("arrive", "id")
    gaps = stops.withColumn("gap", F.col("arrive") - F.lag("arrive").over(order)).where(F.col("gap").between(*HEADWAY))
    return gaps.groupBy("line", "station", "direction", service_hour(F.col("arrive")).alias("hour")).agg(F.percentile("gap", F.lit(0.5)).alias("seconds"), F.count("*").alias("samples"))


def service_hours(stops: DataFrame) -> DataFrame:
    """(line, station, hours): the hours with a train, sorted."""
    return stops.groupBy("line", "station").agg(F.array_sort(F.collect_set(service_hour(F.col("arrive")))).alias("hours"))


def board_weights(gaps: DataFrame, service: DataFrame) -> DataFrame:
    """(line, station, by_hour): half the headway in every service hour, -1 outside.

    The headway of an hour is the median over directions; hours without one take the last known
    before, then the next known after. A platform without any headway has no row.
    """
    waits = gaps.groupBy("line", "station", "hour").agg(board_wait(F.percentile("seconds", F.lit(0.5))).alias("wait"))
    spine = service.join(waits.select("line", "station").distinct(), ["line", "station"], "left_semi").select("line", "station", "hours", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    by = W.partitionBy("line", "station").orderBy("hour")
    full = spine.join(waits, ["line", "station", "hour"], "left")
    before = F.last("wait", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("wait", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))
    weight = F.when(F.array_contains("hours", F.col("hour")), F.coalesce(before, after)).otherwise(NO_SERVICE)
    full = full.select("line", "station", "hour", weight.cast("short").alias("weight"))
    return full.groupBy("line", "station").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "weight"))), lambda s: s["weight"]).alias("by_hour"))


def section_hours(sections: DataFrame, keys: list[str], hours: list[str], days: int) -> DataFrame:
    """by_hour of bus sections given a column of seconds for each hour and a row for each day (0: no bus).

    ``days`` is how many days the file holds for this kind of day. An hour's weight is the median of the
    days that ran if they are more than half of all ``days``; a section that ran on few days is closed. A section is one row
    with its days, so that rows are not multiplied by hours.
    """
    days_of = sections.groupBy(*keys).agg(F.collect_list(F.array(*[F.col(h).try_cast("double") for h in hours])).alias("d"))
    ran = lambda i: F.array_sort(F.filter(F.transform("d", lambda d: F.get(d, F.lit(i))), lambda v: v > 0))
    each = days_of.select(*keys, F.array(*[ran(i) for i in range(len(hours))]).alias("ran"))

    def weight(ran: Column) -> Column:
        n = F.size(ran)
        middle = (F.get(ran, ((n - 1) / 2).cast("int")) + F.get(ran, (n / 2).cast("int"))) / 2
        return F.when(n > days * 0.5, F.bround(middle).cast("int")).otherwise(NO_SERVICE)

    return each.select(*keys, F.transform("ran", weight).alias("by_hour"))


def known_headways(sections: DataFrame, headway: DataFrame, key: str = "route") -> tuple[DataFrame, DataFrame]:
    """(sections of routes with a headway, routes without one)."""
    return sections.join(headway, key, "left_semi"), sections.select(key).distinct().join(headway, key, "left_anti")


# Published headways of the lines in minutes (rush hour), and the stations that lines 1 and 4 are measured on.
REFERENCE_MINUTES = {"1": 3.0, "2": 2.5, "3": 3.0, "4": 2.5, "5": 2.5, "6": 4.0, "7": 2.5, "8": 4.5}
SCOPES = {
    "1": "서울역 시청 종각 종로3가 종로5가 동대문 신설동 제기동 청량리".split(),
    "4": "당고개 상계 노원 창동 쌍문 수유 미아 길음 성신여대입구 한성대입구 혜화 동대문 충무로 명동 회현 서울역 숙대입구 삼각지 신용산 이촌 동작 총신대입구 사당 남태령".split(),
}


def reference_check(gaps: DataFrame, hour: int = 8, most: float = 2.0) -> DataFrame:
    """(line, computed_min, reference_rh_min, ratio, scoped, ok): the headways of an hour against published ones.

    Express lines aren't compared. A line with a scope is measured on the scope's stations, unless none of them
    has a headway. A line is ok if it has no reference, or at most ``most`` times the reference.
    """
    lines = sorted(set(REFERENCE_MINUTES) | set(SCOPES))
    known = gaps.sparkSession.createDataFrame([(x, REFERENCE_MINUTES.get(x), SCOPES.get(x)) for x in lines], "line string, reference double, scope array<string>")
    gaps = gaps.select("line", "station", "hour", "seconds")
    at = gaps.where((F.col("hour") == hour) & ~is_express(F.col("line"))).join(F.broadcast(known), "line", "left")
    inside = F.when(F.col("scope").isNull() | F.array_contains("scope", F.col("station")), F.col("seconds"))
    half = F.lit(0.5)
    each = at.groupBy("line").agg(F.coalesce(F.percentile(inside, half), F.percentile("seconds", half)).alias("s"), F.max("reference").alias("reference"), F.max(F.col("scope").isNotNull()).alias("scoped"))
    minutes = F.col("s") / 60
    ratio = minutes / F.col("reference")
    return each.select("line", F.bround(minutes, 1).alias("computed_min"), F.col("reference").alias("reference_rh_min"), F.bround(ratio, 2).alias("ratio"), "scoped", F.coalesce(ratio <= most, F.lit(True)).alias("ok"))


def quantiles(df: DataFrame, value: Column, over: float) -> DataFrame:
    """n, median, p95, most and the number over a limit."""
    v = df.select(value.cast("double").alias("v"))
    return v.agg(F.count("v").alias("n"), F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.95)).alias("p95"), F.max("v").alias("most"), F.count_if(F.col("v") > over).alias("n_over"))
