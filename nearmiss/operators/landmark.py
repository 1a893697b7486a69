"""Landmark features and prospective outcomes at the current frame."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.constants import (CENSORED, CURRENT_INDEX, FUTURE_CONTACT, HORIZON_FRAMES, INVALID_EGO, INVALID_FRAME, OVERLAP, RADIUS_M,
                                T_MAX_S, TAU_CRITICAL_S)
from nearmiss.functions import geometry as G
from nearmiss.functions.columns import flag
from nearmiss.operators.features import composition_changes, ego_motion
from nearmiss.operators.kinematics import kinematics
from nearmiss.operators.mapjoin import dispersion
from nearmiss.operators.pairs import FRAME, ego_states, frame_join, frame_presence, full_state, pair_metrics, salted_join
from nearmiss.operators.profile import ordered
from nearmiss.session import durable

# Feature names.
PHYSICS_21 = [
    "capped_index_ttc_s", "is_ttc_finite", "is_censored", "index_distance_m", "radial_closing_speed_mps", "ego_longitudinal_pos_m",
    "ego_lateral_pos_m", "ego_longitudinal_vel_mps", "ego_lateral_vel_mps", "ego_speed_mps", "target_speed_mps", "rel_heading_sin",
    "rel_heading_cos", "ego_accel_mps2", "ego_accel_valid", "target_accel_mps2", "target_accel_valid", "ego_length_m", "ego_width_m",
    "target_length_m", "target_width_m",
]
CONTEXT_13 = [
    "n_actors_30m", "n_actors_50m", "n_actors_70m", "n_vehicles_70m", "n_pedestrians_70m", "n_cyclists_70m", "nearest_third_party_dist_m",
    "mean_third_party_speed_mps", "std_third_party_speed_mps", "circular_heading_dispersion", "max_positive_closing_pressure",
    "agg_positive_closing_pressure", "context_empty",
]
PHYSICS_16 = ["p__current_c_t", "p__current_scene_ttc_min_s", "p__dominant_clearance_m", "p__dominant_center_distance_m",
              "p__dominant_closing_speed_mps", "p__sdc_speed_mps", "p__sdc_accel_mps2", "p__sdc_yaw_rate_radps",
              "p__dominant_rel_long_pos_m", "p__dominant_rel_lat_pos_m", "p__dominant_rel_long_vel_mps", "p__dominant_rel_lat_vel_mps",
              "p__dominant_speed_mps", "p__dominant_is_vehicle", "p__dominant_is_pedestrian", "p__dominant_is_cyclist"]
ENV_INST_13 = ["e_inst__n_actors_30m", "e_inst__n_actors_50m", "e_inst__n_actors_70m", "e_inst__n_vehicles_70m", "e_inst__n_pedestrians_70m",
               "e_inst__n_cyclists_70m", "e_inst__positive_closing_agent_count", "e_inst__third_party_nearest_dist_m",
               "e_inst__third_party_mean_speed_mps", "e_inst__third_party_speed_std_mps", "e_inst__third_party_heading_dispersion",
               "e_inst__third_party_closing_pressure_max", "e_inst__third_party_closing_pressure_sum"]
ENV_HIST_7 = ["e_hist__n_actors_70m_mean_1s", "e_hist__n_actors_70m_std_1s", "e_hist__n_actors_70m_slope_1s",
              "e_hist__closing_pressure_sum_mean_1s", "e_hist__closing_pressure_sum_max_1s", "e_hist__third_party_speed_mean_1s",
              "e_hist__actor_composition_turnover_1s"]


def prospective_outcome(frames: DataFrame, *, index: int = CURRENT_INDEX, horizon: int = HORIZON_FRAMES, tau: float = TAU_CRITICAL_S) -> DataFrame:
    """At the current frame: onset within 1 s and 2 s, future peak severity and its change."""
    c = F.col
    ahead = lambda n: ordered().rowsBetween(1, n)
    rows = frames.withColumns({"ttc_1s": F.min("scene_ttc_min_s").over(ahead(horizon // 2)), "ttc_2s": F.min("scene_ttc_min_s").over(ahead(horizon)),
                               "peak_2s": F.coalesce(F.max("severity_c_t").over(ahead(horizon)), F.lit(0.0))})
    rows = rows.filter((c("time_index") == index) & ~c("status").isin(INVALID_FRAME, INVALID_EGO))
    calm = F.coalesce("scene_ttc_min_s", F.lit(T_MAX_S)) > tau
    onset = lambda t: (calm & flag(c(t) <= tau)).cast("int")
    return rows.select("scenario_id", "time_index", c("status").alias("current_status"), onset("ttc_2s").alias("y_onset_3s_h2s"),
                       onset("ttc_1s").alias("y_onset_3s_h1s"), F.greatest("peak_2s", F.lit(0.0)).alias("future_peak_c_h2s"),
                       (F.greatest("peak_2s", F.lit(0.0)) - F.coalesce("severity_c_t", F.lit(0.0))).alias("delta_future_peak_c_h2s"))


def followup_labels(states: DataFrame, *, index: int = CURRENT_INDEX, horizon: int = HORIZON_FRAMES, tau: float = TAU_CRITICAL_S,
                    radius_m: float = RADIUS_M) -> DataFrame:
    """One landmark per (scenario, target) of the current frame, followed over the next frames.

    positive: first frame with TTC <= tau or overlap; incomplete: a frame without
    the pair comes first; excluded: out of radius, overlapping or already
    critical at the current frame; negative otherwise.
    """
    c = F.col
    window = states.filter(c("time_index").between(index, index + horizon))
    presence = durable(frame_presence(window))
    pairs = pair_metrics(window, presence, clearance=True, radius_m=float("inf"))
    now, later = c("time_index") == index, c("time_index") > index
    critical = later & (c("obb_overlap_now") | (c("obb_ttc_s") <= tau))
    at_now = lambda x: F.max(F.when(now, c(x)))
    per = pairs.groupBy("scenario_id", "target_track_id").agg(
        F.max("target_object_type").alias("target_type"), at_now("pair_distance_m").alias("index_distance_m"), at_now("clearance_m").alias("index_clearance_m"),
        at_now("obb_ttc_s").alias("index_ttc_s"), at_now("obb_overlap_now").alias("index_overlap"), at_now("closing_speed_mps").alias("index_closing_speed_mps"),
        F.min_by(F.struct("time_index", "obb_ttc_s", "obb_overlap_now"), F.when(critical, c("time_index"))).alias("event"),
        # At most `horizon` frame numbers per pair.
        F.collect_set(F.when(later, c("time_index"))).alias("seen"))
    ego = presence.filter("ego_ok").groupBy("scenario_id").agg(F.collect_set("time_index").alias("ego_seen"))
    per = per.filter(c("index_distance_m").isNotNull()).join(ego, "scenario_id")
    expected = F.sequence(F.lit(index + 1), F.lit(index + horizon))
    per = per.withColumns({"lost": F.array_min(F.array_except(expected, "seen")), "has_event": c("event.time_index").isNotNull() & (c("event.time_index") > index)})
    reason = (F.when(c("index_distance_m") > radius_m, "OUT_OF_RADIUS").when(c("index_overlap"), "INDEX_OVERLAP")
              .when(c("index_ttc_s") <= tau, "INDEX_ALREADY_CRITICAL"))
    event_first = c("has_event") & (c("lost").isNull() | (c("event.time_index") < c("lost")))
    label = (F.when(reason.isNotNull(), "excluded").when(event_first, "positive").when(c("lost").isNotNull(), "incomplete").otherwise("negative"))
    per = per.withColumns({"exclusion_reason": reason, "label": label})
    positive, incomplete = c("label") == "positive", c("label") == "incomplete"
    return per.select(
        "scenario_id", "target_track_id", "target_type", "index_distance_m", "index_clearance_m", "index_ttc_s", "index_closing_speed_mps",
        c("exclusion_reason").isNull().alias("is_eligible"), "exclusion_reason", "label",
        F.when(positive, c("event.time_index")).alias("event_time_index"), F.when(positive, c("event.obb_ttc_s")).alias("event_ttc_s"),
        F.when(positive, F.when(c("event.obb_overlap_now"), "OVERLAP").otherwise("TTC_LE_3S")).alias("event_type"),
        F.when(incomplete, c("lost")).alias("incomplete_time_index"),
        F.when(incomplete, F.when(F.array_contains("ego_seen", c("lost")), "TARGET_LOST").otherwise("EGO_LOST")).alias("incomplete_reason"))


def eligible_landmarks(labels: DataFrame) -> DataFrame:
    """Complete landmarks with a binary target."""
    return (labels.filter(F.col("is_eligible") & F.col("label").isin("positive", "negative"))
            .withColumn("target_binary", (F.col("label") == "positive").cast("int")))


def anchor_vs_open_set(labels: DataFrame, frames: DataFrame, *, index: int = CURRENT_INDEX, horizon: int = HORIZON_FRAMES, tau: float = TAU_CRITICAL_S) -> DataFrame:
    """The locked pair's label against the label of whichever actor is soonest in each frame."""
    c = F.col
    anchor = labels.filter("is_eligible").groupBy("scenario_id").agg(
        F.min_by(F.struct("target_track_id", "label"), F.struct("index_ttc_s", "index_clearance_m", "index_distance_m", "target_track_id")).alias("a"))
    later = frames.filter(c("time_index").between(index + 1, index + horizon))
    first = later.filter(flag(c("scene_ttc_min_s") <= tau)).groupBy("scenario_id").agg(F.min_by("dominant_actor_id", "time_index").alias("first_id"))
    out = anchor.join(first, "scenario_id", "left")
    open_label = F.when(c("first_id").isNotNull(), "positive").otherwise("negative")
    return out.select("scenario_id", c("a.target_track_id").alias("anchor_track_id"), c("a.label").alias("anchor_label"),
                      open_label.alias("open_set_frame_min_label"), (c("a.label") != open_label).alias("anchor_vs_open_disagreement"),
                      c("first_id").alias("open_set_first_critical_track_id"),
                      flag(c("first_id") != c("a.target_track_id")).alias("open_target_switch_or_new_entrant"))


def _around(states: DataFrame, presence: DataFrame, index: int) -> DataFrame:
    """Usable actors of any class within 70 m of the ego at the current frame."""
    ego = ego_states(presence).filter(F.col("time_index") == index)
    actors = states.filter((F.col("time_index") == index) & ~flag(F.col("is_sdc")) & full_state()).select(
        *FRAME, "track_id", "object_type", *G.prefixed("t_"))
    rows = G.with_relative_state(frame_join(ego, actors)).withColumnRenamed("pair_distance_m", "d")
    return rows.filter(F.col("d") <= RADIUS_M).withColumns({
        "spd": G.speed("t_"), "hc": F.cos("t_heading"), "hs": F.sin("t_heading"), "closing": G.closing_speed("d"),
        "moving": F.col("d") > 1e-6}).withColumn("pos", F.when(F.col("moving"), F.greatest("closing", F.lit(0.0))))


def _totals(rows: DataFrame) -> DataFrame:
    """Per-frame sums over all actors, the nearest and the fastest-closing one, and the runners-up.

    With these, the statistics of "everyone but one actor" follow by
    subtraction, so pairs of actors are never formed.
    """
    c = F.col
    kind = lambda t: F.count_if(c("object_type") == t)
    first = rows.groupBy(*FRAME).agg(
        F.count("*").alias("n"), F.count_if(c("d") <= 30).alias("n30"), F.count_if(c("d") <= 50).alias("n50"), kind("TYPE_VEHICLE").alias("veh"),
        kind("TYPE_PEDESTRIAN").alias("ped"), kind("TYPE_CYCLIST").alias("cyc"), F.sum("spd").alias("s1"), F.sum(c("spd") * c("spd")).alias("s2"),
        F.sum("hc").alias("sc"), F.sum("hs").alias("ss"), F.sum(c("pos") / F.greatest(F.lit(1.0), c("d"))).alias("press"),
        F.count_if(c("moving") & (c("closing") > 0)).alias("n_closing"),
        F.min(F.struct("d", "track_id")).alias("near"), F.max(F.struct("pos", "track_id")).alias("fast"))
    second = salted_join(first.select(*FRAME, c("near.track_id").alias("near_id"), c("fast.track_id").alias("fast_id")), rows, FRAME, ["track_id"], buckets=2)
    runners = second.groupBy(*FRAME).agg(F.min(F.when(c("track_id") != c("near_id"), c("d"))).alias("near2"),
                                         F.max(F.when(c("track_id") != c("fast_id"), c("pos"))).alias("fast2"))
    return first.join(runners, FRAME)


def _without(one: str) -> dict:
    """Context columns with the actor in struct column `one` (NULL: nobody) taken out of the totals."""
    c = F.col
    own = lambda x: F.coalesce(c(f"{one}.{x}"), F.lit(0.0))
    hit = c(f"{one}.track_id").isNotNull()
    n = c("n") - hit.cast("int")
    is_type = lambda t: flag(c(f"{one}.object_type") == t).cast("int")
    mean = (c("s1") - own("spd")) / F.greatest(n, F.lit(1))
    var = F.greatest((c("s2") - own("spd") * own("spd")) / F.greatest(n, F.lit(1)) - mean * mean, F.lit(0.0))
    some = n > 0
    when = lambda x, d: F.when(some, F.coalesce(x, F.lit(d))).otherwise(F.lit(d))
    same = lambda s: flag(c(f"{one}.track_id") == c(f"{s}.track_id"))
    return {
        "n30": c("n30") - flag(hit & (c(f"{one}.d") <= 30)).cast("int"), "n50": c("n50") - flag(hit & (c(f"{one}.d") <= 50)).cast("int"), "n70": n,
        "veh": c("veh") - is_type("TYPE_VEHICLE"), "ped": c("ped") - is_type("TYPE_PEDESTRIAN"), "cyc": c("cyc") - is_type("TYPE_CYCLIST"),
        "nearest": when(F.when(same("near"), c("near2")).otherwise(c("near.d")), RADIUS_M), "mean_speed": when(mean, 0.0),
        "std_speed": F.when(n > 1, F.sqrt(var)).otherwise(F.lit(0.0)),
        "disp": when(dispersion((c("sc") - own("hc")) / F.greatest(n, F.lit(1)), (c("ss") - own("hs")) / F.greatest(n, F.lit(1))), 0.0),
        "press_max": when(F.when(same("fast"), c("fast2")).otherwise(c("fast.pos")), 0.0),
        "press_sum": when(c("press") - F.coalesce(c(f"{one}.pos") / F.greatest(F.lit(1.0), c(f"{one}.d")), F.lit(0.0)), 0.0),
        "n_closing": c("n_closing") - flag(c(f"{one}.moving") & (c(f"{one}.closing") > 0)).cast("int"), "empty": (~some).cast("double")}


_ACTOR = ["track_id", "object_type", "d", "spd", "hc", "hs", "pos", "closing", "moving", "dx", "dy", "dvx", "dvy", "t_heading", "t_length", "t_width"]


def landmark_pair_features(states: DataFrame, labels: DataFrame, *, index: int = CURRENT_INDEX) -> DataFrame:
    """Physics (21) and third-party context (13) of every landmark pair inside the radius."""
    c = F.col
    presence = durable(frame_presence(states.filter(c("time_index") <= index)))
    rows = durable(_around(states, presence, index))
    accel = kinematics(states.filter(c("time_index") <= index)).filter(c("time_index") == index).select(*FRAME, "track_id", c("derived_accel_mps2").alias("accel"))
    pair = labels.filter(c("index_distance_m") <= RADIUS_M).select("scenario_id", F.lit(index).alias("time_index"), c("target_track_id").alias("track_id"),
                                                                   "index_ttc_s", "index_closing_speed_mps")
    df = rows.join(pair, [*FRAME, "track_id"]).join(accel, [*FRAME, "track_id"], "left")
    ego_accel = accel.select(*FRAME, c("track_id").alias("ego_track_id"), c("accel").alias("ego_accel"))
    df = df.join(ego_accel, [*FRAME, "ego_track_id"], "left").withColumn("one", F.struct(*_ACTOR))
    df = df.join(_totals(rows), FRAME).withColumns({f"x_{k}": v.cast("double") for k, v in _without("one").items()})
    lon, lat = G.in_heading_frame("dx", "dy", "e_heading")
    vlon, vlat = G.in_heading_frame("dvx", "dvy", "e_heading")
    ttc = F.greatest(F.lit(0.0), F.least(F.lit(T_MAX_S), F.coalesce("index_ttc_s", F.lit(T_MAX_S))))
    real = F.coalesce("index_ttc_s", F.lit(T_MAX_S)) < T_MAX_S
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    turn = c("t_heading") - c("e_heading")
    physics = [ttc, real.cast("double"), (~real).cast("double"), c("d"), zero("index_closing_speed_mps"), lon, lat, vlon, vlat, G.speed("e_"), c("spd"),
               F.sin(turn), F.cos(turn), zero("ego_accel"), c("ego_accel").isNotNull().cast("double"), zero("accel"), c("accel").isNotNull().cast("double"),
               c("e_length"), c("e_width"), c("t_length"), c("t_width")]
    context = [c(f"x_{k}") for k in ("n30", "n50", "n70", "veh", "ped", "cyc", "nearest", "mean_speed", "std_speed", "disp", "press_max", "press_sum", "empty")]
    return df.select("scenario_id", c("track_id").alias("target_track_id"), *[v.alias(n) for n, v in zip(PHYSICS_21, physics)], *[v.alias(n) for n, v in zip(CONTEXT_13, context)])


def landmark_features(states: DataFrame, frames: DataFrame, *, index: int = CURRENT_INDEX) -> DataFrame:
    """36 features at the current frame (physics of the dominant actor, third parties, one-second history) with the outcomes."""
    c = F.col
    past = states.filter(c("time_index") <= index)
    presence = durable(frame_presence(past))
    rows = durable(_around(past, presence, index))
    now = frames.filter(c("time_index") == index)
    dom = now.select(*FRAME, c("dominant_actor_id").alias("track_id")).join(rows, [*FRAME, "track_id"]).select(*FRAME, F.struct(*_ACTOR).alias("one"), "e_heading")
    ego = ego_states(presence).filter(c("time_index") == index).select(*FRAME, G.speed("e_").alias("ego_speed")).join(ego_motion(presence), FRAME, "left")
    df = (now.join(ego, FRAME).join(dom, FRAME, "left").join(_totals(rows), FRAME, "left")
          .na.fill(0, ["n", "n30", "n50", "veh", "ped", "cyc", "n_closing"]).na.fill(0.0, ["s1", "s2", "sc", "ss", "press"]))
    df = df.withColumns({f"x_{k}": v.cast("double") for k, v in _without("one").items()})
    w = ordered().rowsBetween(-index, 0)
    n = c("n_valid_targets_70m").cast("double")
    moving = flag(c("valid")) & ~flag(c("is_sdc"))
    spd = past.filter(moving).groupBy(*FRAME).agg(F.avg(G.speed()).alias("frame_speed"))
    hist = (frames.filter(c("time_index") <= index).join(composition_changes(past, include_ego=True), FRAME, "left").join(spd, FRAME, "left")
            .select(*FRAME, F.avg(n).over(w).alias("h_mean"), F.stddev_pop(n).over(w).alias("h_std"),
                    ((n - F.first(n).over(w)) / F.lit((index + 1) * 0.1)).alias("h_slope"),
                    F.avg(F.coalesce("frame_speed", F.lit(0.0))).over(w).alias("h_speed"),
                    F.coalesce(F.sum("changed").over(w), F.lit(0)).cast("double").alias("h_turn")).filter(c("time_index") == index))
    df = df.join(hist, FRAME)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    lon, lat = (zero(v) for v in G.in_heading_frame("one.dx", "one.dy", "e_heading"))
    vlon, vlat = (zero(v) for v in G.in_heading_frame("one.dvx", "one.dvy", "e_heading"))
    is_type = lambda t: flag(c("dominant_actor_type") == t).cast("double")
    physics = [zero(c("severity_c_t")), F.coalesce("scene_ttc_min_s", F.lit(T_MAX_S)), F.coalesce("dominant_clearance_m", F.lit(RADIUS_M)),
               F.coalesce("dominant_center_distance_m", F.lit(RADIUS_M)), zero(c("dominant_closing_speed_mps")), c("ego_speed"), zero(c("ego_accel")), zero(c("ego_yaw_rate")),
               lon, lat, vlon, vlat, zero(c("one.spd")), is_type("TYPE_VEHICLE"), is_type("TYPE_PEDESTRIAN"), is_type("TYPE_CYCLIST")]
    typed = lambda x: c(x).cast("double")
    inst = [c("x_n30"), c("x_n50"), typed("n_valid_targets_70m"), typed("n_vehicles_70m"), typed("n_pedestrians_70m"), typed("n_cyclists_70m"), c("x_n_closing"),
            c("x_nearest"), c("x_mean_speed"), c("x_std_speed"), c("x_disp"), c("x_press_max"), c("x_press_sum")]
    history = [c("h_mean"), c("h_std"), c("h_slope"), c("x_press_sum"), c("x_press_max"), c("h_speed"), c("h_turn")]
    out = df.select("scenario_id", *[v.alias(x) for x, v in zip(PHYSICS_16 + ENV_INST_13 + ENV_HIST_7, physics + inst + history)])
    return prospective_outcome(frames, index=index).join(out, "scenario_id", "left")


def feature_dictionary(spark) -> DataFrame:
    """Static metadata of the landmark features."""
    rows = [(f, "physics", "current_and_past") for f in PHYSICS_21] + [(f, "context", "current") for f in CONTEXT_13]
    return spark.createDataFrame(rows, "feature_name string, feature_role string, time_support string")
