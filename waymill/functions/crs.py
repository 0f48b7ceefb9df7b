"""Map projections in DataFrame columns: transverse Mercator, datum shifts, and distances on the globe."""

from __future__ import annotations

from dataclasses import dataclass
from math import radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Numbers of an ellipsoid, or Columns of them, as in the two classes below."""

    a: float
    inverse_f: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_f

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


# Ellipsoids, projections and the datum step between them.
BESSEL = Ellipsoid(6377397.155, 299.1528128)
GRS80 = Ellipsoid(6378137.0, 298.257222101)


@dataclass(frozen=True)
class Projection:
    ellipsoid: Ellipsoid
    lon0: float
    lat0: float = 38.0
    east: float = 200_000.0
    north: float = 500_000.0


@dataclass(frozen=True)
class Datum:
    """Coordinate-frame rotation about a pivot: metres, seconds of arc, parts per million."""

    t: tuple[float, float, float]
    r: tuple[float, float, float] = (0.0, 0.0, 0.0)
    ppm: float = 0.0
    pivot: tuple[float, float, float] = (0.0, 0.0, 0.0)


EPSG_5174 = Projection(BESSEL, 127.0028902777778)
EPSG_2097 = Projection(BESSEL, 127.0)
EPSG_5186 = Projection(GRS80, 127.0, north=600_000.0)
KOREAN_1985 = Datum((-145.907, 505.034, 685.756), (-1.162, 2.347, 1.592), 6.342, (-3159521.31, 4068151.32, 3748113.85))
THREE_PARAMETERS = Datum((-146.43, 507.89, 681.46))
#: The same seven numbers turned the other way and about the centre of the earth.
SEVEN_PARAMETERS = Datum(KOREAN_1985.t, (1.162, -2.347, -1.592), KOREAN_1985.ppm)


def _arc(e: Ellipsoid, lat):
    """Length of the meridian to a latitude (float or Column)."""
    e2, s = e.e2, F.sin if isinstance(lat, Column) else sin
    return e.a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * s(2 * lat)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * s(4 * lat)
        - (35 * e2**3 / 3072) * s(6 * lat)
    )


def _steps(df: DataFrame, *layers: dict[str, Column]) -> DataFrame:
    """Columns added layer by layer: a value used often is a column, and computed once."""
    for layer in layers:
        df = df.withColumns(layer)
    return df


def _without(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_t_")])


C = F.col


def forward(df: DataFrame, p: Projection, lat: str, lon: str, x: str, y: str) -> DataFrame:
    """Columns x, y in metres of columns lat, lon in degrees."""
    e, e2 = p.ellipsoid, p.ellipsoid.e2
    ep2 = e2 / (1 - e2)
    s, c, t, k, a, n = (C(f"_t_{v}") for v in "sctkan")
    return _without(
        _steps(
            df,
            {"_t_phi": F.radians(C(lat))},
            {"_t_s": F.sin("_t_phi"), "_t_c": F.cos("_t_phi")},
            {"_t_n": F.lit(e.a) / F.sqrt(1 - e2 * s * s), "_t_t": (s / c) * (s / c), "_t_k": ep2 * c * c, "_t_a": F.radians(C(lon) - F.lit(p.lon0)) * c},
            {"_t_a2": a * a},
            {
                x: F.lit(p.east) + n * a * (1 + C("_t_a2") * ((1 - t + k) / 6 + (5 - 18 * t + t * t + 72 * k - 58 * ep2) * C("_t_a2") / 120)),
                y: F.lit(p.north) + _arc(e, C("_t_phi")) - F.lit(_arc(e, p.lat0 * radians(1))) + n * (s / c) * C("_t_a2") * (0.5 + C("_t_a2") * ((5 - t + 9 * k + 4 * k * k) / 24 + (61 - 58 * t + t * t + 600 * k - 330 * ep2) * C("_t_a2") / 720)),
            },
        )
    )


def inverse(df: DataFrame, p: Projection, x: str, y: str, lat: str, lon: str) -> DataFrame:
    """Columns lat, lon in degrees of columns x, y in metres."""
    e, e2 = p.ellipsoid, p.ellipsoid.e2
    ep2, root = e2 / (1 - e2), (1 - e2) ** 0.5
    e1 = (1 - root) / (1 + root)
    mu, phi, s, c, k, t, n, q, d = (C(f"_t_{v}") for v in ("mu", "phi", "s", "c", "k", "t", "n", "q", "d"))
    return _without(
        _steps(
            df,
            {"_t_mu": (C(y) - F.lit(p.north) + F.lit(_arc(e, p.lat0 * radians(1)))) / (e.a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))},
            {"_t_phi": mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)},
            {"_t_s": F.sin("_t_phi"), "_t_c": F.cos("_t_phi")},
            {"_t_k": ep2 * c * c, "_t_t": (s / c) * (s / c), "_t_q": 1 - e2 * s * s},
            {"_t_n": F.lit(e.a) / F.sqrt("_t_q")},
            {"_t_d": (C(x) - F.lit(p.east)) / n},
            {"_t_d2": d * d},
            {
                lat: F.degrees(phi - (n * (s / c) * q * F.sqrt("_t_q") / (e.a * (1 - e2))) * C("_t_d2") * (0.5 - C("_t_d2") * ((5 + 3 * t + 10 * k - 4 * k * k - 9 * ep2) / 24 - (61 + 90 * t + 298 * k + 45 * t * t - 252 * ep2 - 3 * k * k) * C("_t_d2") / 720))),
                lon: F.lit(p.lon0) + F.degrees(d * (1 - C("_t_d2") * ((1 + 2 * t + k) / 6 - (5 - 2 * k + 28 * t - 3 * k * k + 8 * ep2 + 24 * t * t) * C("_t_d2") / 120)) / c),
            },
        )
    )


def shift(df: DataFrame, lat: str, lon: str, source: Ellipsoid, target: Ellipsoid, d: Datum) -> DataFrame:
    """Degrees moved from one datum to another through geocentric coordinates, in place."""
    rx, ry, rz = (v * radians(1 / 3600) for v in d.r)
    k = 1 + d.ppm * 1e-6
    n, u, v, w = (C(f"_t_{c}") for c in "nuvw")
    layers = [
        {"_t_phi": F.radians(C(lat)), "_t_lam": F.radians(C(lon))},
        {"_t_n": F.lit(source.a) / F.sqrt(1 - source.e2 * F.sin("_t_phi") * F.sin("_t_phi"))},
        {"_t_u": n * F.cos("_t_phi") * F.cos("_t_lam") - F.lit(d.pivot[0]), "_t_v": n * F.cos("_t_phi") * F.sin("_t_lam") - F.lit(d.pivot[1]), "_t_w": n * (1 - source.e2) * F.sin("_t_phi") - F.lit(d.pivot[2])},
        {"_t_x": k * (u + rz * v - ry * w) + F.lit(d.pivot[0] + d.t[0]), "_t_y": k * (v - rz * u + rx * w) + F.lit(d.pivot[1] + d.t[1]), "_t_z": k * (w + ry * u - rx * v) + F.lit(d.pivot[2] + d.t[2])},
        {"_t_flat": F.sqrt(C("_t_x") * C("_t_x") + C("_t_y") * C("_t_y"))},
        {"_t_o": F.atan2(C("_t_z"), C("_t_flat") * (1 - target.e2))},
    ]
    for _ in range(4):
        layers.append({"_t_sin": F.sin("_t_o")})
        layers.append({"_t_o": F.atan2(C("_t_z") + target.e2 * target.a * C("_t_sin") / F.sqrt(1 - target.e2 * C("_t_sin") * C("_t_sin")), C("_t_flat"))})
    return _without(_steps(df, *layers, {lat: F.degrees("_t_o"), lon: F.degrees(F.atan2(C("_t_y"), C("_t_x")))}))


def to_5186(df: DataFrame, x: str, y: str, out_x: str, out_y: str, source: Projection = EPSG_5174, datum: Datum = KOREAN_1985) -> DataFrame:
    """Columns out_x, out_y in EPSG:5186 of columns x, y in the source system."""
    df = inverse(df, source, x, y, "_lat", "_lon")
    return forward(shift(df, "_lat", "_lon", source.ellipsoid, GRS80, datum), EPSG_5186, "_lat", "_lon", out_x, out_y).drop("_lat", "_lon")


def to_degrees(df: DataFrame, x: str, y: str, lat: str, lon: str, source: Projection, datum: Datum | None) -> DataFrame:
    """Columns lat, lon in degrees of the globe of columns x, y in the source system; without a datum step none is needed."""
    df = inverse(df, source, x, y, lat, lon)
    return df if datum is None else shift(df, lat, lon, source.ellipsoid, GRS80, datum)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_008.8) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * radius * F.asin(F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return radius * F.sqrt(x * x + y * y)


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
