"""Trajectories: rows of (trajectory, time, lng, lat), native windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesic import haversine_km, turning_angle


def _seconds(t: Column) -> Column:
    """Seconds since the epoch, of a timestamp with or without a zone."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def steps(df: DataFrame, traj: str, ts: str, lng: str = "lng", lat: str = "lat", order: list[str] | None = None) -> DataFrame:
    """df with step_km, step_s, speed_kmh, delta_speed and turn (degrees) of every point, from the points next to it."""
    w = Window.partitionBy(traj).orderBy(ts, *(order or [lng, lat]))
    before = lambda c: F.lag(c).over(w)
    out = df.withColumn("step_km", haversine_km(before(lng), before(lat), F.col(lng), F.col(lat)))
    out = out.withColumn("step_s", _seconds(F.col(ts)) - _seconds(before(ts)))
    out = out.withColumn("speed_kmh", F.when(F.col("step_s") > 0, F.col("step_km") / F.col("step_s") * 3600))
    out = out.withColumn("delta_speed", F.col("speed_kmh") - F.lag("speed_kmh").over(w))
    return out.withColumn("turn", turning_angle(before(lng), before(lat), F.col(lng), F.col(lat), F.lead(lng).over(w), F.lead(lat).over(w)))


def features(df: DataFrame, traj: str, ts: str, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """One row a trajectory: times, end points, number of points, bounds, length, mean speed, detour ratio."""
    s = steps(df, traj, ts, lng, lat)
    point = F.struct(F.col(lng).alias("lng"), F.col(lat).alias("lat"))
    order = F.struct(ts, lng, lat)
    out = s.groupBy(traj).agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.min_by(point, order).alias("start_point"), F.max_by(point, order).alias("end_point"), F.count(F.lit(1)).alias("num_points"),
        F.min(lng).alias("xmin"), F.min(lat).alias("ymin"), F.max(lng).alias("xmax"), F.max(lat).alias("ymax"), F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("length_km"),
    )
    hours = (_seconds(F.col("end_time")) - _seconds(F.col("start_time"))) / 3600
    straight = haversine_km(F.col("start_point.lng"), F.col("start_point.lat"), F.col("end_point.lng"), F.col("end_point.lat"))
    return out.withColumn("speed_kmh", F.when(hours > 0, F.col("length_km") / hours)).withColumn("detour_ratio", F.when(straight > 0, F.col("length_km") / straight))


def stay_points(df: DataFrame, traj: str, ts: str, lng: str = "lng", lat: str = "lat", radius_km: float = 0.2, least_s: float = 1200) -> DataFrame:
    """Runs of points, each within the radius of the one before it, that last long enough: times, mean centre, bounds, seconds."""
    w = Window.partitionBy(traj).orderBy(ts, lng, lat)
    far = F.coalesce(haversine_km(F.lag(lng).over(w), F.lag(lat).over(w), F.col(lng), F.col(lat)) > radius_km, F.lit(True))
    run = df.withColumn("__far", far.cast("int")).withColumn("run", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(traj, "run").agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.avg(lng).alias("lng"), F.avg(lat).alias("lat"), F.count(F.lit(1)).alias("num_points"),
        F.min(lng).alias("xmin"), F.min(lat).alias("ymin"), F.max(lng).alias("xmax"), F.max(lat).alias("ymax"),
    )
    out = out.withColumn("stay_s", _seconds(F.col("end_time")) - _seconds(F.col("start_time")))
    return out.where(F.col("stay_s") >= least_s).drop("run")


def linestrings(df: DataFrame, traj: str, ts: str, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """(traj, coords array<double>): x1, y1, x2, y2 ... in time order, as st_createline takes them; a trajectory is one value."""
    pts = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(lng).alias("x"), F.col(lat).alias("y"))))
    return df.groupBy(traj).agg(F.flatten(F.transform(pts, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias("coords"))


def passing(df: DataFrame, traj: str, lng: str, lat: str, x: float, y: float, km: float) -> DataFrame:
    """Trajectories with a point within so many km of (x, y)."""
    return df.where(haversine_km(F.col(lng), F.col(lat), F.lit(x), F.lit(y)) <= km).select(traj).distinct()
