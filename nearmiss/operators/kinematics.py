"""Derived motion per track. A (scenario, track) group has one row per frame, so windows stay small."""
from pyspark.sql import DataFrame, Window as W, functions as F

from nearmiss.functions.columns import finite, flag, wrap_angle


def track():
    return W.partitionBy("scenario_id", "track_id").orderBy("time_index")


def kinematics(states: DataFrame) -> DataFrame:
    """Speed, acceleration, yaw rate and jerk from consecutive valid rows of a track."""
    c = F.col
    before = lambda name: F.lag(name).over(track())
    moving = flag(c("valid")) & finite(c("velocity_x")) & finite(c("velocity_y"))
    df = states.withColumn("usable", moving).withColumn(
        "derived_speed_mps",
        F.when(c("usable"), F.sqrt(c("velocity_x") * c("velocity_x") + c("velocity_y") * c("velocity_y"))))
    df = df.withColumns({
        "dt": c("timestamp_seconds") - before("timestamp_seconds"),
        "dv": c("derived_speed_mps") - before("derived_speed_mps"),
        "dh": c("heading") - before("heading"),
        "pair_ok": c("usable") & F.coalesce(before("usable"), F.lit(False))})
    step = F.when(c("pair_ok") & (c("dt") > 0), c("dt"))
    df = df.withColumns({"derived_accel_mps2": c("dv") / step, "derived_yaw_rate_rps": wrap_angle(c("dh")) / step})
    df = df.withColumn("derived_jerk_mps3", (c("derived_accel_mps2") - before("derived_accel_mps2")) / step)
    known = [c(n).isNotNull() for n in ("derived_speed_mps", "derived_accel_mps2", "derived_yaw_rate_rps", "derived_jerk_mps3")]
    return (df.withColumn("derived_kinematic_valid", known[0] & known[1] & known[2] & known[3])
            .drop("usable", "dt", "dv", "dh", "pair_ok"))


def path_length(states: DataFrame) -> DataFrame:
    """Cumulative path length of each track over its valid rows."""
    rows = states.filter(flag(F.col("valid")))
    dx = F.col("center_x") - F.lag("center_x").over(track())
    dy = F.col("center_y") - F.lag("center_y").over(track())
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return (rows.withColumn("step_m", step)
            .withColumn("path_m", F.sum("step_m").over(track().rowsBetween(W.unboundedPreceding, 0))))
