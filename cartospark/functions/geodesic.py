"""Geodesic and planar helpers as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0087714
MERCATOR_RADIUS = 6378137.0
MERCATOR_MAX_LAT = 85.0511287798066
DEGREE_KM = EARTH_KM * math.pi / 180


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def haversine_km(lng1, lat1, lng2, lat2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(_c(lng2)) - F.radians(_c(lng1))) / 2), F.lit(2))
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))  # least() passes over nulls


UNITS = {"km": 1.0, "m": 1000.0, "mile": 0.621371192237334, "degree": 1 / DEGREE_KM}


def distance_in(unit: str, lng1, lat1, lng2, lat2) -> Column:
    return haversine_km(lng1, lat1, lng2, lat2) * UNITS[unit]


def planar_distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_c(x2) - _c(x1), F.lit(2)) + F.pow(_c(y2) - _c(y1), F.lit(2)))


def box_by_distance(x, y, distance) -> Column:
    """Planar bounds of all points within a distance."""
    x, y, d = _c(x), _c(y), _c(distance)
    return F.struct((x - d).alias("xmin"), (y - d).alias("ymin"), (x + d).alias("xmax"), (y + d).alias("ymax"))


def km_to_degree(km) -> Column:
    return _c(km) / DEGREE_KM


def degree_to_km(degree) -> Column:
    return _c(degree) * DEGREE_KM


def box_by_km(lng, lat, km) -> Column:
    """Bounds of all points within so many km; longitudes aren't wrapped."""
    lng, lat, km = _c(lng), _c(lat), _c(km)
    dlat = km_to_degree(km)
    dlng = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(km / EARTH_KM) / F.cos(F.radians(lat)))))
    return F.struct((lng - dlng).alias("xmin"), (lat - dlat).alias("ymin"), (lng + dlng).alias("xmax"), (lat + dlat).alias("ymax"))


def point_on_bearing(lng, lat, bearing, km) -> Column:
    """The point so many km away; bearing in degrees clockwise from north."""
    lng, lat, b, d = F.radians(_c(lng)), F.radians(_c(lat)), F.radians(_c(bearing)), _c(km) / EARTH_KM
    lat2 = F.asin(F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(b))
    lng2 = lng + F.atan2(F.sin(b) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(lat2))
    return F.struct(F.degrees(lng2).alias("lng"), F.degrees(lat2).alias("lat"))


def bearing(lng1, lat1, lng2, lat2) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lng2)) - F.radians(_c(lng1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def turning_angle(x1, y1, x2, y2, x3, y3) -> Column:
    """Change of direction at the middle point, in degrees within [0, 180]."""
    a = F.atan2(_c(y2) - _c(y1), _c(x2) - _c(x1))
    b = F.atan2(_c(y3) - _c(y2), _c(x3) - _c(x2))
    return F.abs(F.degrees(F.atan2(F.sin(b - a), F.cos(b - a))))


def interpolate_time(t, t1, v1, t2, v2) -> Column:
    """Linear between (t1, v1) and (t2, v2); times in seconds."""
    t, t1, v1, t2, v2 = map(_c, (t, t1, v1, t2, v2))
    return F.when(t1 == t2, v1).otherwise(v1 + (v2 - v1) * (t - t1) / (t2 - t1))


def mercator_x(lng) -> Column:
    return F.radians(_c(lng)) * MERCATOR_RADIUS


def mercator_y(lat) -> Column:
    """Latitudes are cut to the square map."""
    lat = F.least(F.greatest(_c(lat), F.lit(-MERCATOR_MAX_LAT)), F.lit(MERCATOR_MAX_LAT))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS


def from_mercator(x, y) -> Column:
    return F.struct(F.degrees(_c(x) / MERCATOR_RADIUS).alias("lng"), F.degrees(2 * F.atan(F.exp(_c(y) / MERCATOR_RADIUS)) - math.pi / 2).alias("lat"))


# --- planar predicates on coordinates -----------------------------------------------------------------


def cross_product(x1, y1, x2, y2, x3, y3) -> Column:
    """Of (p2 - p1) and (p3 - p1): above 0 where p3 lies left of the line."""
    x1, y1, x2, y2, x3, y3 = map(_c, (x1, y1, x2, y2, x3, y3))
    return (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)


def side_of_line(x1, y1, x2, y2, x3, y3) -> Column:
    return F.signum(cross_product(x1, y1, x2, y2, x3, y3)).cast("int")


def on_segment(x1, y1, x2, y2, x, y) -> Column:
    x1, y1, x2, y2, x, y = map(_c, (x1, y1, x2, y2, x, y))
    between = (x >= F.least(x1, x2)) & (x <= F.greatest(x1, x2)) & (y >= F.least(y1, y2)) & (y <= F.greatest(y1, y2))
    return (cross_product(x1, y1, x2, y2, x, y) == 0) & between


def segments_meet(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    d1, d2 = side_of_line(x3, y3, x4, y4, x1, y1), side_of_line(x3, y3, x4, y4, x2, y2)
    d3, d4 = side_of_line(x1, y1, x2, y2, x3, y3), side_of_line(x1, y1, x2, y2, x4, y4)
    touch = on_segment(x3, y3, x4, y4, x1, y1) | on_segment(x3, y3, x4, y4, x2, y2) | on_segment(x1, y1, x2, y2, x3, y3) | on_segment(x1, y1, x2, y2, x4, y4)
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | touch


def triangle_area(x1, y1, x2, y2, x3, y3) -> Column:
    return F.abs(cross_product(x1, y1, x2, y2, x3, y3)) / 2
