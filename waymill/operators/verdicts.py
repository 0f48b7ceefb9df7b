"""Which coordinate system a register is in: candidates are held against places that are known, and against each other."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.functions import crs
from waymill.functions.scalars import lot_matches


@dataclass(frozen=True)
class Candidate:
    """A system that coordinates may be in; a control is one that they can't be in, and is never the best."""

    label: str
    projection: crs.Projection
    datum: crs.Datum | None
    control: bool = False


@dataclass(frozen=True)
class Anchor:
    """A lot with the place where it is."""

    label: str
    lot: str
    lat: float
    lon: float


# The box of the city in degrees (west, south, east, north), the bounds of verdicts in metres,
# the systems that registers have been given in, and lots of large buildings with their places.
CITY = (126.73, 37.40, 127.27, 37.72)
PASS_METRES, WARN_METRES = 150.0, 300.0
CANDIDATES = (
    Candidate("EPSG:5174", crs.EPSG_5174, crs.KOREAN_1985),
    Candidate("EPSG:2097", crs.EPSG_2097, crs.KOREAN_1985),
    Candidate("modified Bessel, seven parameters", crs.EPSG_5174, crs.SEVEN_PARAMETERS),
    Candidate("modified Bessel, three parameters", crs.EPSG_5174, crs.THREE_PARAMETERS),
    Candidate("plain Bessel, seven parameters", crs.EPSG_2097, crs.SEVEN_PARAMETERS),
    Candidate("control, EPSG:5186", crs.EPSG_5186, None, control=True),
)
ANCHORS = (
    Anchor("롯데월드타워·몰", "송파구 신천동 29", 37.5130, 127.1027),
    Anchor("코엑스", "강남구 삼성동 159", 37.5115, 127.0595),
    Anchor("서울역", "중구 봉래동2가 122", 37.5547, 126.9707),
    Anchor("고속터미널", "서초구 반포동 19-4", 37.5049, 127.0048),
    Anchor("63빌딩", "영등포구 여의도동 60", 37.5197, 126.9400),
    Anchor("IFC", "영등포구 여의도동 23", 37.5250, 126.9255),
    Anchor("서울시청", "중구 태평로1가 31", 37.5663, 126.9779),
    Anchor("잠실종합운동장", "송파구 잠실동 10", 37.5152, 127.0731),
)


def in_city(lat: Column, lon: Column) -> Column:
    return lon.between(CITY[0], CITY[2]) & lat.between(CITY[1], CITY[3])


def ratio(flag: Column) -> Column:
    """The part of rows for which a flag holds, to four places; none without rows."""
    return F.bround(F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)), 4)


def _parameters(candidates: Sequence[Candidate]) -> Column:
    """The candidates' numbers as one array; without a datum step its numbers are zero."""
    rows = []
    for i, c in enumerate(candidates):
        p, d = c.projection, c.datum or crs.Datum((0.0, 0.0, 0.0))
        numbers = {"a": p.ellipsoid.a, "f": p.ellipsoid.inverse_f, "lon0": p.lon0, "lat0": p.lat0, "east": p.east, "north": p.north, "ppm": d.ppm}
        numbers |= {f"{name}{k}": v for name, of in (("t", d.t), ("r", d.r), ("o", d.pivot)) for k, v in enumerate(of)}
        rows.append(F.struct(F.lit(i).alias("candidate"), *[F.lit(float(v)).alias(k) for k, v in numbers.items()]))
    return F.array(*rows)


def placed(rows: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Rows (x, y, ...) with both coordinates, once for each ``candidate``, with ``lat`` and ``lon`` by it.

    The candidates' numbers are columns, so that one chain of projections serves all of them.
    """
    located = rows.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    each = located.select("*", F.explode(_parameters(candidates)).alias("_p"))
    of = lambda *names: tuple(F.col(f"_p.{n}") for n in names)
    p = crs.Projection(crs.Ellipsoid(*of("a", "f")), *of("lon0", "lat0", "east", "north"))
    d = crs.Datum(of("t0", "t1", "t2"), of("r0", "r1", "r2"), *of("ppm"), of("o0", "o1", "o2"))
    out = crs.to_degrees(each, "x", "y", "lat", "lon", p, d)
    return out.select(*rows.columns, F.col("_p.candidate").alias("candidate"), "lat", "lon")


def verdict(metres: Column) -> Column:
    return F.when(metres.isNull(), "NO_DATA").when(metres < PASS_METRES, "PASS").when(metres < WARN_METRES, "WARN").otherwise("FAIL")


def anchor_errors(rows: DataFrame, candidates: Sequence[Candidate] = CANDIDATES, anchors: Sequence[Anchor] = ANCHORS) -> DataFrame:
    """(candidate, anchor, n, inside, samples, median) of rows (lot address ``jibun``, x, y), both numbers of the sequences.

    Anchor -1 is a candidate as a whole: its rows, the part of them in the city, and the median over all rows at
    anchors. Rows, candidates and anchors meet in one pass; an anchor without rows has no row here.
    """
    lots = [F.when(lot_matches(F.col("jibun"), a.lot), i) for i, a in enumerate(anchors)]
    hits = F.concat(F.array(F.lit(-1)), F.filter(F.array(*lots), lambda i: i.isNotNull()))
    # A row stands once for itself and once for each anchor that it is at.
    at = rows.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.explode(hits).alias("hit"))
    p = placed(at, candidates)
    here = F.get(F.array(*[F.struct(F.lit(a.lat).alias("lat"), F.lit(a.lon).alias("lon")) for a in anchors]), F.nullif("hit", F.lit(-1)))
    p = p.withColumn("_here", here)
    error = crs.haversine(F.col("_here.lat"), F.col("_here.lon"), F.col("lat"), F.col("lon"))
    inside = F.when(F.col("hit") == -1, in_city(F.col("lat"), F.col("lon")))
    items = p.select("candidate", F.nullif("hit", F.lit(-1)).alias("anchor"), inside.alias("inside"), error.alias("error"))
    both = items.groupingSets([["candidate"], ["candidate", "anchor"]], "candidate", "anchor").agg(
        F.count("inside").alias("n"), ratio(F.col("inside")).alias("inside"), F.count("error").alias("samples"), F.percentile("error", F.lit(0.5)).alias("median"), F.grouping("anchor").alias("whole")
    )
    return both.where("whole = 1 OR anchor IS NOT NULL").select("candidate", F.coalesce("anchor", F.lit(-1)).alias("anchor"), "n", "inside", "samples", "median")


def judged(errors: DataFrame, candidates: Sequence[Candidate] = CANDIDATES, anchors: Sequence[Anchor] = ANCHORS) -> DataFrame:
    """Per candidate, the nearest first: (place, label, inside, median_m, samples, verdict, best, anchors).

    ``anchors`` lists each anchor's label, samples and median. The best is the candidate with the least median
    that isn't a control, of equals the first given; candidates without samples come last and are NO_DATA.
    """
    spark = errors.sparkSession
    given = spark.createDataFrame([(i, c.label, c.control) for i, c in enumerate(candidates)], "candidate int, label string, control boolean")
    points = spark.createDataFrame([(i, a.label) for i, a in enumerate(anchors)], "anchor int, name string")
    each = F.broadcast(given.select("candidate").crossJoin(points)).join(errors.where("anchor >= 0"), ["candidate", "anchor"], "left")
    listed = each.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("anchor", "name", F.coalesce("samples", F.lit(0)).alias("samples"), F.bround("median", 1).alias("median_m")))).alias("a"))
    whole = given.join(errors.where("anchor = -1").drop("anchor"), "candidate", "left").join(listed, "candidate", "left")
    order = F.struct(F.coalesce(F.bround("median", 1), F.lit(float("inf"))), "candidate")
    best = whole.where("NOT control AND median IS NOT NULL").agg(F.min_by("candidate", order).alias("_best"))
    ranks = whole.agg(F.transform(F.array_sort(F.collect_list(order)), lambda o: o["candidate"]).alias("_ranks"))
    out = whole.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(ranks))
    return out.select(
        F.array_position("_ranks", F.col("candidate")).cast("int").alias("place"),
        "label",
        F.coalesce("inside", F.lit(0.0)).alias("inside"),
        F.bround("median", 1).alias("median_m"),
        F.coalesce("samples", F.lit(0)).alias("samples"),
        verdict(F.col("median")).alias("verdict"),
        F.coalesce(F.col("candidate") == F.col("_best"), F.lit(False)).alias("best"),
        F.transform("a", lambda a: F.struct(a["name"].alias("name"), a["samples"].alias("samples"), a["median_m"].alias("median_m"))).alias("anchors"),
    ).orderBy("place")


def spread(rows: DataFrame, key: str, candidates: Sequence[Candidate] = CANDIDATES, sample: int = 5000) -> DataFrame:
    """(a, b, n, median_m, max_m) of every two candidates: how far apart they put the same rows.

    The sample are the rows with the least hashes of their key, the same on every run. A row is projected once by each
    candidate, and all pairs of candidates are columns of that row.
    """
    located = rows.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    some = located.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample).select(F.col(key).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = placed(some, candidates).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("candidate", "lat", "lon"))).alias("at"))
    at = lambda i: F.get("at", F.lit(i))
    pairs = [(a, b, i, j) for i, a in enumerate(candidates) for j, b in enumerate(candidates) if i < j]
    apart = F.array(*[crs.haversine(at(i)["lat"], at(i)["lon"], at(j)["lat"], at(j)["lon"]) for _, _, i, j in pairs])
    name = lambda which: F.get(F.array(*[F.lit(pair[which].label) for pair in pairs]), F.col("_pair"))
    each = p.select(apart.alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("_pair")).select(name(0).alias("a"), name(1).alias("b"), F.get("_d", F.col("_pair")).alias("d"))
    return each.groupBy("a", "b").agg(F.count("*").alias("n"), F.bround(F.percentile("d", F.lit(0.5)), 1).alias("median_m"), F.bround(F.max("d"), 1).alias("max_m"))


def agreement(ours: DataFrame, theirs: DataFrame, key: str, metres: float = 0.001) -> DataFrame:
    """One row (n, max_m, median_m, mean_m, agrees) of distances between two tables (key, x, y) of the same points."""
    both = ours.select(key, "x", "y").join(theirs.select(key, F.col("x").alias("_x"), F.col("y").alias("_y")), key)
    d = crs.planar(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))
    out = both.agg(F.count("*").alias("n"), F.max(d).alias("max_m"), F.percentile(d, F.lit(0.5)).alias("median_m"), F.avg(d).alias("mean_m"))
    return out.withColumn("agrees", F.coalesce(F.col("max_m") <= metres, F.lit(False)))
