"""Scenario safety indicators."""
from pyspark.sql import DataFrame, Window as W, functions as F

from nearmiss.functions.columns import finite, flag
from nearmiss.functions.geometry import speed
from nearmiss.operators.kinematics import kinematics
from nearmiss.operators.mapjoin import nearest_distance
from nearmiss.operators.pairs import FRAME, circle_pair_metrics, ego_track, frame_presence
from nearmiss.session import durable_rows

KPIS = ["max_jerk", "drac_max", "rss_margin_min", "cross_track_error_max", "ttlc_min", "offroad_ratio"]


def max_jerk(ego: DataFrame) -> DataFrame:
    """Largest absolute ego jerk."""
    return kinematics(ego).groupBy("scenario_id").agg(F.max(F.abs("derived_jerk_mps3")).alias("max_jerk"))


def drac_max(pairs: DataFrame) -> DataFrame:
    """Largest deceleration to avoid contact, closing^2 / (2 d); 0 if nothing closes in."""
    cs, d = F.col("derived_closing_speed_mps"), F.col("pair_distance_m")
    drac = F.when((cs > 0) & (d > 0.1), cs * cs / (F.greatest(d, F.lit(0.1)) * 2.0))
    return pairs.groupBy("scenario_id").agg(F.coalesce(F.max(drac), F.lit(0.0)).alias("drac_max"))


def rss_margin_min(pairs: DataFrame, ego: DataFrame, *, rho: float = 0.5, a_max: float = 4.0) -> DataFrame:
    """Smallest gap beyond the reaction-plus-braking distance of the ego.

    The speed depends on the frame only, so pairs are reduced to the smallest
    distance per frame before the speed is looked up.
    """
    ego = ego.filter("valid").select(*FRAME, speed().alias("v")).filter(finite(F.col("v")))
    nearest = pairs.groupBy(*FRAME).agg(F.min("pair_distance_m").alias("d"))
    v = F.col("v")
    margin = F.col("d") - (v * rho + v * v / (2.0 * a_max))
    return nearest.join(ego, FRAME).groupBy("scenario_id").agg(F.min(margin).alias("rss_margin_min"))


def _ego_positions(ego: DataFrame) -> DataFrame:
    placed = finite(F.col("center_x")) & finite(F.col("center_y"))
    return (ego.filter(F.col("valid") & placed)
            .select(*FRAME, F.col("center_x").alias("x0"), F.col("center_y").alias("y0")))


def cross_track_and_offroad(ego: DataFrame, points: DataFrame, *, edge_m: float = 2.0) -> DataFrame:
    """Largest distance to the nearest lane point, and share of frames off the nearest road edge."""
    near = nearest_distance(_ego_positions(ego), points.filter(F.col("feature_type").isin("lane", "road_edge")))
    lane = F.when(F.col("feature_type") == "lane", F.col("distance_m"))
    edge = F.when(F.col("feature_type") == "road_edge", (F.col("distance_m") > edge_m).cast("double"))
    return near.groupBy("scenario_id").agg(F.round(F.max(lane), 4).alias("cross_track_error_max"),
                                           F.round(F.avg(edge), 4).alias("offroad_ratio"))


def ttlc_min(ego: DataFrame, *, lane_width_m: float = 3.7) -> DataFrame:
    """Half lane width over lateral speed, smallest over frames drifting faster than 0.1 m/s."""
    c = F.col
    lateral = F.abs(-c("velocity_x") * F.sin("heading") + c("velocity_y") * F.cos("heading"))
    ego = ego.filter("valid").withColumn("v_lat", lateral)
    return ego.groupBy("scenario_id").agg(
        F.round(F.min(F.when(finite(c("v_lat")) & (c("v_lat") > 0.1), F.lit(lane_width_m / 2) / F.greatest(c("v_lat"), F.lit(0.1)))), 4).alias("ttlc_min"))


def all_kpis(states: DataFrame, points: DataFrame) -> DataFrame:
    """The six indicators per scenario; NULL means not measurable."""
    presence = durable_rows(frame_presence(states))
    ego, pairs = ego_track(presence), durable_rows(circle_pair_metrics(states, presence).select(*FRAME, "pair_distance_m", "derived_closing_speed_mps"))
    out = presence.select("scenario_id").distinct()
    for part in (max_jerk(ego), drac_max(pairs), rss_margin_min(pairs, ego), cross_track_and_offroad(ego, points), ttlc_min(ego)):
        out = out.join(part, "scenario_id", "left")
    return out.select("scenario_id", *KPIS)


def kpi_coverage(kpis: DataFrame) -> DataFrame:
    long = kpis.unpivot(["scenario_id"], KPIS, "kpi", "value")
    n, ok = F.count("*"), F.count("value")
    return long.groupBy("kpi").agg(n.alias("n_total"), ok.alias("n_valid"), F.round(ok / n, 4).alias("coverage"),
                                   F.round((n - ok) / n, 4).alias("missing_rate"))


def response_kpis(presence: DataFrame, frames: DataFrame) -> DataFrame:
    """Ego response percentiles (at most one value per frame) and the radial closing proxy."""
    c = F.col
    ego = kinematics(ego_track(presence)).withColumns({
        "decel": F.when(c("derived_accel_mps2").isNotNull(), F.greatest(F.lit(0.0), -c("derived_accel_mps2"))), "jerk": F.abs("derived_jerk_mps3"),
        "yaw": F.abs("derived_yaw_rate_rps"), "lat": F.abs(c("derived_speed_mps") * c("derived_yaw_rate_rps"))})
    p95 = lambda x, n: F.coalesce(F.percentile(x, F.lit(0.95)), F.lit(0.0)).alias(n)
    response = ego.groupBy("scenario_id").agg(
        p95("decel", "kpi__sdc_hard_decel_p95"),
        F.coalesce(F.min("derived_accel_mps2"), F.lit(0.0)).alias("kpi__sdc_min_longitudinal_accel"),
        p95("jerk", "kpi__sdc_abs_jerk_p95"), p95("yaw", "kpi__sdc_abs_yaw_rate_p95"), p95("lat", "kpi__sdc_lateral_accel_p95"))
    cs = c("dominant_closing_speed_mps")
    proxy = F.when(c("is_exposed") & (cs > 0), cs * cs / (F.greatest(F.lit(0.5), c("dominant_clearance_m")) * 2.0))
    radial = frames.groupBy("scenario_id").agg(F.coalesce(F.max(proxy), F.lit(0.0)).alias("kpi__radial_closing_decel_proxy_max"))
    out = radial.join(response, "scenario_id", "left")
    return out.na.fill(0.0, [x for x in out.columns if x.startswith("kpi__")])


def motion_continuity(states: DataFrame, points: DataFrame) -> DataFrame:
    """Per-scenario ego continuity checks with their measured values.

    Speed and acceleration, which stem from the stored velocity, are held against first and second differences of the positions.
    """
    c = F.col
    w = W.partitionBy("scenario_id").orderBy("time_index")
    presence = durable_rows(frame_presence(states))
    ego = ego_track(presence)
    lane = (nearest_distance(_ego_positions(ego), points.filter(c("feature_type") == "lane"))
            .select(*FRAME, c("distance_m").alias("cte")))
    rows = kinematics(ego).join(lane, FRAME, "left")
    step = lambda n: c(n) - F.lag(n).over(w)
    dt = F.greatest(step("timestamp_seconds"), F.lit(1e-12))
    rows = rows.withColumns({"sx": step("center_x"), "sy": step("center_y"), "dt": dt,
                             "dh": step("heading"), "dcte": F.abs(step("cte"))})
    jump = F.sqrt(c("sx") * c("sx") + c("sy") * c("sy"))
    fd = F.sqrt((c("sx") / c("dt")) * (c("sx") / c("dt")) + (c("sy") / c("dt")) * (c("sy") / c("dt")))
    spd = speed()
    rows = rows.withColumn("fd", fd).withColumn("fd_accel", (c("fd") - F.lag("fd").over(w)) / c("dt"))
    turn = F.abs(F.pmod(c("dh") + F.pi(), F.pi() * 2) - F.pi())
    rows = rows.withColumns({
        "jump": jump, "turn": turn,
        "v_err": F.when(spd > 0.5, F.abs(c("fd") - spd) / F.greatest(spd, F.lit(1.0))),
        "a_err": F.abs(c("fd_accel") - c("derived_accel_mps2")) / F.greatest(F.abs("derived_accel_mps2"), F.lit(0.5))})
    top = lambda x, n: F.round(F.coalesce(F.max(x), F.lit(0.0)), 4).alias(n)
    span = lambda x: F.coalesce(F.max(x) - F.min(x), F.lit(0.0))
    per = rows.groupBy("scenario_id").agg(
        top("jump", "max_jump_m"), top("v_err", "max_velocity_rel_error"), top("a_err", "max_accel_rel_error"),
        top("turn", "max_heading_jump_rad"), F.round(F.greatest(span("length"), span("width")), 4).alias("box_range_m"),
        top("dcte", "max_cte_change_m"))
    track = W.partitionBy("scenario_id", "track_id").orderBy("time_index")
    tracks = (states.filter(flag(c("valid"))).withColumn("gap", c("time_index") - F.lag("time_index").over(track))
              .groupBy("scenario_id", "track_id").agg(flag(F.max("gap") > 5).alias("fragmented"))
              .groupBy("scenario_id").agg(F.count("*").alias("n_tracks"), F.count_if("fragmented").alias("n_fragmented")))
    out = presence.select("scenario_id").distinct().join(per, "scenario_id", "left").join(tracks.hint("merge"), "scenario_id", "left")
    out = out.withColumn("fragmentation_ratio", F.round(F.coalesce(c("n_fragmented") / F.greatest(c("n_tracks"), F.lit(1)), F.lit(0.0)), 4))
    below = lambda x, t: F.coalesce(c(x) < t, F.lit(True))
    return out.withColumns({
        "position_ok": below("max_jump_m", 2.0), "velocity_ok": below("max_velocity_rel_error", 0.10),
        "acceleration_ok": below("max_accel_rel_error", 0.20), "heading_ok": below("max_heading_jump_rad", 0.5),
        "box_ok": below("box_range_m", 0.01), "map_ok": below("max_cte_change_m", 1.0), "topology_ok": below("fragmentation_ratio", 0.2)})


def continuity_pass_rates(checks: DataFrame) -> DataFrame:
    names = [x for x in checks.columns if x.endswith("_ok")]
    rates = checks.agg(F.count("*").alias("n"), *[F.count_if(x).alias(x) for x in names])
    return rates.unpivot(["n"], names, "check_name", "n_passed").withColumn("pass_rate", F.round(F.col("n_passed") / F.col("n"), 4))
