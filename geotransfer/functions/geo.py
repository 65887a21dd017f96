"""Map projections, grid blocks and polygon text as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from geotransfer.functions.numeric import _col

# Ellipsoids and projection parameters.
GRS80 = (6378137.0, 1 / 298.257222101)
WGS84 = (6378137.0, 1 / 298.257223563)
CLARKE_1866 = (6378206.4, 1 / 294.978698214)
ALBERS_CONUS = dict(lat1=29.5, lat2=45.5, lat0=23.0, lon0=-96.0)
UTM_50N_MERIDIAN = 117.0


class _Albers:
    """Constants of the ellipsoidal equal-area conic (Snyder 1987, chapter 14)."""

    def __init__(self, ellipsoid, lat1, lat2, lat0, lon0):
        self.a, f = ellipsoid
        self.e2 = 2 * f - f * f
        self.e = math.sqrt(self.e2)
        m1, m2 = self._m(lat1), self._m(lat2)
        q0, q1, q2 = self.q_value(lat0), self.q_value(lat1), self.q_value(lat2)
        self.n = (m1 * m1 - m2 * m2) / (q2 - q1)
        self.c = m1 * m1 + self.n * q1
        self.rho0 = self.a * math.sqrt(self.c - self.n * q0) / self.n
        self.lon0 = lon0

    def _m(self, lat):
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1 - self.e2 * s * s)

    def q_value(self, lat):
        s = math.sin(math.radians(lat))
        return (1 - self.e2) * (s / (1 - self.e2 * s * s)
                                - math.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))


def albers(lon, lat, ellipsoid=GRS80, lat1=29.5, lat2=45.5, lat0=23.0,
           lon0=-96.0) -> tuple[Column, Column]:
    """Easting and northing in metres on an Albers equal-area grid."""
    k = _Albers(ellipsoid, lat1, lat2, lat0, lon0)
    s = F.sin(F.radians(_col(lat)))
    q = F.lit(1 - k.e2) * (s / (F.lit(1.0) - F.lit(k.e2) * s * s)
                           - F.ln((F.lit(1.0) - F.lit(k.e) * s) / (F.lit(1.0) + F.lit(k.e) * s))
                           / F.lit(2 * k.e))
    rho = F.lit(k.a) * F.sqrt(F.lit(k.c) - F.lit(k.n) * q) / F.lit(k.n)
    theta = F.lit(k.n) * F.radians(_col(lon) - F.lit(k.lon0))
    return rho * F.sin(theta), F.lit(k.rho0) - rho * F.cos(theta)


def utm_north(lon, lat, meridian: float = UTM_50N_MERIDIAN,
              ellipsoid=WGS84) -> tuple[Column, Column]:
    """Easting and northing on a northern UTM zone by the Krueger series (order n^4)."""
    a, f = ellipsoid
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = [
        n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
        13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
        61 * n ** 3 / 240 - 103 * n ** 4 / 140,
        49561 * n ** 4 / 161280,
    ]
    c = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(_col(lat)))
    dlon = F.radians(_col(lon) - F.lit(meridian))
    t = F.sinh(F.atanh(s) - F.lit(c) * F.atanh(F.lit(c) * s))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, aj in enumerate(alpha, start=1):
        east = east + F.lit(aj) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        north = north + F.lit(aj) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    scale = F.lit(0.9996 * radius)
    return F.lit(500000.0) + scale * east, scale * north


def grid_index(coordinate, size: float) -> Column:
    return F.floor(_col(coordinate) / F.lit(float(size))).cast("long")


def albers_block_id(ix, iy) -> Column:
    return F.concat(F.lit("EPSG5070_50KM_"), _col(ix).cast("string"), F.lit("_"),
                    _col(iy).cast("string"))


def utm_block_id(ie, in_) -> Column:
    return F.concat(F.lit("E"), _col(ie).cast("string"), F.lit("_N"), _col(in_).cast("string"))


def box_wkt(e_min, n_min, e_max, n_max) -> Column:
    """Closed rectangle as WKT, corners in the order SW, SE, NE, NW, SW."""
    a, b, c, d = (_col(x).cast("string") for x in (e_min, n_min, e_max, n_max))
    sp, sep = F.lit(" "), F.lit(", ")
    return F.concat(F.lit("POLYGON (("), a, sp, b, sep, c, sp, b, sep, c, sp, d, sep,
                    a, sp, d, sep, a, sp, b, F.lit("))"))


def aspect_components(aspect_degrees) -> tuple[Column, Column]:
    r = F.radians(_col(aspect_degrees))
    return F.sin(r), F.cos(r)
