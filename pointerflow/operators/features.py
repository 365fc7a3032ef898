"""Kinematic features of actions (FE1-FE6)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dom_tag, euclidean, normalize, self_intersections, with_path_steps
from .events import sequence

EPS = 1e-6
KINEMATIC = ("cursor_speed", "acceleration_mean", "reciprocal_acceleration", "jitter", "direction_changes", "curvature_mean", "rate_of_curvature", "distance_travelled", "movement_offset", "straightness", "self_intersections")
FEATURES = ("action_duration", *KINEMATIC, "x", "y", "x_raw", "y_raw")


def session_xy_stats(actions: DataFrame) -> DataFrame:
    """Median and spread of all points of a sequence: path points of movements,
    places of other actions.  The spread is the quartiles' distance, or else
    the range, or else 1."""
    moves = F.col("type") == "mouse_movement"
    points = F.when(moves, F.transform("path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).otherwise(F.array(F.struct("x", "y")))
    p = actions.select("session_key", F.explode_outer(points).alias("p")).select("session_key", "p.*")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    aggs = []
    for c in "xy":
        v = F.when(both, F.col(c))
        aggs += [F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{c}"), (F.max(v) - F.min(v)).alias(f"r{c}")]
    per = p.groupBy("session_key").agg(*aggs)
    out = []
    for c in "xy":
        q, r = F.col(f"q{c}"), F.col(f"r{c}")
        scale = F.when(q[2] - q[0] > EPS, q[2] - q[0]).when(r > EPS, r).otherwise(1.0)
        out += [F.coalesce(q[1], F.lit(0.0)).alias(f"{c}_center"), scale.alias(f"{c}_scale")]
    return per.select("session_key", *out)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _total(a) / F.size(a)).otherwise(0.0)


def _placed(actions: DataFrame, stats: DataFrame) -> DataFrame:
    return actions.join(stats, "session_key")


def _action_features(placed: DataFrame) -> DataFrame:
    """Features of actions of all kinds, in one projection; movements with fewer
    than two whole points go.  Times are compared before Python counts crossings,
    while Spark still knows how the rows are partitioned."""
    moves, clicks = F.col("type") == "mouse_movement", F.col("type") == "click"
    whole = F.filter("path", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["t"].isNotNull())
    rows = placed.withColumn("raw", F.when(moves, whole)).where(~moves | (F.size("raw") >= 2))
    rows = with_time_since_last(rows.withColumn("time", F.when(clicks, F.col("timestamp")).when(moves, F.coalesce("timestamp", F.try_element_at("raw", F.lit(-1))["t"])).otherwise(F.col("end"))))
    rows = rows.withColumn("points", F.transform("raw", lambda p: F.struct(normalize(p["x"], "x_center", "x_scale").alias("x"), normalize(p["y"], "y_center", "y_scale").alias("y"), p["t"].alias("t"))))
    rows = with_path_steps(rows, "points").withColumn("s_total", _total(F.col("s_dist")))
    # a column of its own: inside the lambda of jitter it would be added up anew for every step
    rows = rows.withColumn("s_mean", F.when(F.size("s_dist") > 0, F.col("s_total") / F.size("s_dist")).otherwise(0.0))
    first, last, raw_last = (F.try_element_at(c, F.lit(i)) for c, i in ((F.col("points"), 1), (F.col("points"), -1), (F.col("raw"), -1)))
    total, offset = F.col("s_total"), euclidean(first["x"], first["y"], last["x"], last["y"])
    jitter = F.sqrt(_mean(F.transform("s_dist", lambda d: (d - F.col("s_mean")) * (d - F.col("s_mean")))))
    lasts = last["t"] - first["t"]
    dwell = F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0))
    rows = rows.withColumns({"distance_travelled": F.when(moves, total), "acceleration_mean": F.when(moves, _mean(F.col("s_speed_change"))), "movement_offset": F.when(moves, offset), "jitter": F.when(F.size("s_dist") > 1, jitter).when(moves, 0.0)})
    rows = rows.withColumn("action_duration", F.when(moves, F.when(lasts > 0, lasts).otherwise(1.0)).when(~clicks, dwell))
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    moved = {
        "cursor_speed": F.col("distance_travelled") / F.col("action_duration"),
        "reciprocal_acceleration": F.when(F.abs("acceleration_mean") > EPS, 1 / F.col("acceleration_mean")).otherwise(0.0),
        "direction_changes": F.size(F.filter("s_angle", lambda a: a > math.pi / 4)),
        "curvature_mean": _mean(F.col("s_angle")),
        "rate_of_curvature": zero(_total(F.col("s_angle")), F.col("distance_travelled")),
        "straightness": zero(F.col("movement_offset"), F.col("distance_travelled")),
    }
    placed_at = {c: F.when(moves, last[c]).otherwise(normalize(c, f"{c}_center", f"{c}_scale")) for c in "xy"}
    raw_at = {f"{c}_raw": F.when(moves, raw_last[c]).otherwise(F.col(c)) for c in "xy"}
    out = rows.select(
        "session_key", "action_idx", F.col("type").alias("action_type"), "points", F.when(clicks, dom_tag("node")).alias("dom_element_type"), "time", "time_since_last_action",
        "action_duration", "acceleration_mean", "jitter", "distance_travelled", "movement_offset", *(F.when(moves, c).alias(k) for k, c in moved.items()), *(c.alias(k) for k, c in (placed_at | raw_at).items()),
    )
    # last, so that rows wait for Python without the columns between
    return out.withColumn("self_intersections", F.when(F.col("action_type") == "mouse_movement", self_intersections("points"))).drop("points")


_NAMED = ("session_key", "action_idx", "action_type", "dom_element_type", "time")
_PLACES = ("x", "y", "x_raw", "y_raw")


def movement_features(actions: DataFrame, stats: DataFrame) -> DataFrame:
    """Twelve values of each movement's normalized path; movements with fewer
    than two whole points go."""
    return _action_features(_placed(actions.where("type = 'mouse_movement'"), stats)).select(*_NAMED, "action_duration", *KINEMATIC, *_PLACES)


def click_features(actions: DataFrame, stats: DataFrame) -> DataFrame:
    return _action_features(_placed(actions.where("type = 'click'"), stats)).select(*_NAMED, *_PLACES)


def dwell_features(actions: DataFrame, stats: DataFrame) -> DataFrame:
    """Hovers, pauses and anything else: how long and where."""
    return _action_features(_placed(actions.where("type not in ('click', 'mouse_movement')"), stats)).select(*_NAMED, "action_duration", *_PLACES)


def with_time_since_last(features: DataFrame) -> DataFrame:
    """Time since the previous kept row of the sequence; 0 if either lacks one."""
    gap = F.col("time") - F.lag("time").over(sequence("action_idx"))
    return features.withColumn("time_since_last_action", F.coalesce(gap, F.lit(0.0)))


def extract_features(actions: DataFrame) -> DataFrame:
    """One row of features an action, in the order of the actions.

    Actions and the points of their sequences are shuffled by sequence once
    each; statistics, join and order follow from that partitioning.
    """
    placed = _placed(actions.repartition("session_key"), session_xy_stats(actions))
    out = _action_features(placed)
    module = F.get(F.split("session_key", r"\|"), F.lit(2)).alias("module_id")
    return out.select("session_key", "action_idx", module, "action_type", "dom_element_type", *FEATURES, "time_since_last_action")
