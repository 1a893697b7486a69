"""Pairs to frame outcomes. One row per (scenario, frame of the fixed grid)."""
from pyspark.sql import DataFrame, Window as W, functions as F

from nearmiss.constants import (CENSORED, CONTACT_TOL, DT_S, FUTURE_CONTACT, INVALID_EGO, INVALID_FRAME,
                                METHOD_BOX, N_FRAMES, NO_EXPOSURE, OVERLAP, T_MAX_S, T_MIN_S, TAU_CRITICAL_S)
from nearmiss.functions.columns import clip, flag
from nearmiss.operators.pairs import FRAME, circle_pair_metrics, frame_presence, pair_metrics
from nearmiss.session import durable


def frame_spine(presence: DataFrame, n_frames: int = N_FRAMES) -> DataFrame:
    """All scenarios x frames 0..n-1 with presence flags; absent frames have none set.

    A scenario's frames (at most n) are gathered into one map and laid out on
    the grid, which needs one exchange and no join.
    """
    flags = ["any_row", "any_valid", "ego_flagged", "ego_ok"]
    per = (presence.filter(F.col("time_index").between(0, n_frames - 1)).groupBy("scenario_id").agg(
        F.max("ego_track_id").alias("ego_track_id"),
        F.map_from_entries(F.collect_list(F.struct("time_index", F.struct(*flags)))).alias("seen")))
    grid = per.select("scenario_id", "ego_track_id", "seen", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("time_index"))
    return grid.select(*FRAME, "ego_track_id", (F.col("time_index") * F.lit(DT_S)).alias("timestamp_seconds"),
                       *[F.coalesce(F.try_element_at("seen", F.col("time_index"))[f], F.lit(False)).alias(f) for f in flags])


def frame_targets(states: DataFrame, presence: DataFrame | None = None, *, n_frames: int = N_FRAMES, reductions: bool = False) -> DataFrame:
    """Frame label by precedence: overlap beats future contact beats censored.

    Near actors whose numerics are unusable keep a frame out of no_exposure. With reductions, also the least distance and the
    greatest closing speed of the frame's usable pairs, from the same pass.
    """
    presence = durable(frame_presence(states)) if presence is None else presence
    pairs = pair_metrics(states, presence, clearance=False, valid_targets_only=False)
    c = F.col
    future = c("obb_hit_future") & ~c("obb_overlap_now") & (c("obb_ttc_s") > CONTACT_TOL)
    reduced = pairs.groupBy(*FRAME).agg(
        F.count("*").alias("n_near"),
        F.count_if("pair_valid").alias("n_eligible_pairs"),
        F.count_if("obb_overlap_now").alias("n_obb_overlap"),
        F.count_if(future).alias("n_obb_future_contact"),
        F.min(F.when(future, c("obb_ttc_s"))).alias("min_future"),
        F.min(F.when(c("pair_valid"), c("pair_distance_m"))).alias("min_pair_distance_m"),
        F.max(F.when(c("pair_valid"), c("closing_speed_mps"))).alias("max_closing_speed_mps"))
    out = frame_spine(presence, n_frames).join(reduced, FRAME, "left")
    status = (F.when(~c("any_valid"), INVALID_FRAME).when(~c("ego_ok"), INVALID_EGO)
              .when(c("n_near").isNull(), NO_EXPOSURE).when(c("n_obb_overlap") > 0, OVERLAP)
              .when(c("n_obb_future_contact") > 0, FUTURE_CONTACT).otherwise(CENSORED))
    out = out.withColumn("target_status", status)
    horizon = F.lit(T_MAX_S)
    exposed = c("target_status").isin(OVERLAP, FUTURE_CONTACT, CENSORED)
    return out.select(
        *FRAME, "timestamp_seconds", "ego_track_id", "target_status",
        F.when(c("target_status") == OVERLAP, F.lit(0.0)).when(c("target_status") == FUTURE_CONTACT, c("min_future"))
         .when(c("target_status") == CENSORED, horizon).alias("ttc_obb_swept_s"),
        (c("target_status") == CENSORED).alias("right_censored"),
        (c("target_status") == OVERLAP).alias("overlap_now_flag"),
        F.when(exposed, c("n_eligible_pairs")).otherwise(F.lit(0)).alias("n_eligible_pairs"),
        F.when(c("target_status") == OVERLAP, c("n_obb_overlap")).alias("n_obb_overlap"),
        F.when(c("target_status") == FUTURE_CONTACT, c("n_obb_future_contact")).alias("n_obb_future_contact"),
        F.lit(METHOD_BOX).alias("ttc_method"),
        F.when(c("target_status").isin(FUTURE_CONTACT, CENSORED), horizon).alias("censor_time_s"),
        *(["min_pair_distance_m", "max_closing_speed_mps"] if reductions else []))


def frame_targets_log(states: DataFrame, presence: DataFrame | None = None, *, pairs: DataFrame | None = None) -> DataFrame:
    """Circle-based label: nearest-in-time pair and its log TTC, for frames that have rows."""
    presence = durable(frame_presence(states)) if presence is None else presence
    if pairs is None:
        pairs = circle_pair_metrics(states, presence)
    c = F.col
    best = pairs.groupBy(*FRAME).agg(
        F.count("*").alias("n_pairs"),
        F.min_by(F.struct("derived_ttc_2d_s", "derived_hit_future", "target_track_id", "target_object_type"),
                 F.struct("derived_ttc_2d_s", "target_track_id")).alias("b"))
    has_ego = F.max("ego_row").over(W.partitionBy("scenario_id"))
    frames = presence.withColumn("has_ego", has_ego).filter("has_ego").withColumnRenamed("clock_s", "timestamp_seconds")
    out = frames.join(best, FRAME, "left")
    exposed = c("any_valid") & c("ego_flagged") & c("n_pairs").isNotNull()
    event = exposed & c("b.derived_hit_future")
    return out.select(
        *FRAME, "timestamp_seconds",
        exposed.cast("int").alias("exposure_flag"),
        F.when(exposed, c("n_pairs")).otherwise(F.lit(0)).alias("n_eligible_pairs"),
        F.when(exposed, c("b.derived_ttc_2d_s")).alias("ttc_min_s"),
        (exposed & ~c("b.derived_hit_future")).alias("ttc_censored"),
        F.when(event, F.log(F.greatest(c("b.derived_ttc_2d_s"), F.lit(T_MIN_S))))
         .when(exposed, F.log(F.lit(T_MAX_S))).alias("y_log_ttc"),
        F.when(exposed, c("b.target_track_id")).alias("target_object_id"),
        F.when(exposed, c("b.target_object_type")).alias("target_object_type"),
        F.when(~c("any_valid"), INVALID_FRAME).when(~c("ego_flagged"), INVALID_EGO)
         .when(c("n_pairs").isNull(), NO_EXPOSURE).when(event, "event").otherwise(CENSORED).alias("target_status"))


def scene_criticality(states: DataFrame, presence: DataFrame | None = None, *, n_frames: int = N_FRAMES, t_min: float = 0.0,
                      t_max: float = T_MAX_S, tau: float = TAU_CRITICAL_S) -> DataFrame:
    """Frame severity with the focal (nearest) and dominant (soonest) actor.

    Both picks are total orders, so the result does not depend on row order:
    focal by (clearance, distance, id), dominant by (TTC, clearance, distance, id).
    """
    presence = durable(frame_presence(states)) if presence is None else presence
    pairs = pair_metrics(states, presence, t_max=t_max)
    c = F.col
    pick = F.struct(c("target_track_id").alias("id"), c("target_object_type").alias("type"),
                    c("clearance_m").alias("clearance"), c("pair_distance_m").alias("dist"),
                    c("closing_speed_mps").alias("closing"), c("obb_ttc_s").alias("ttc"),
                    c("obb_overlap_now").alias("overlap"), c("obb_hit_future").alias("hit"))
    by_type = lambda t: F.count_if(c("target_object_type") == t)
    reduced = pairs.groupBy(*FRAME).agg(
        F.min_by(pick, F.struct("clearance_m", "pair_distance_m", "target_track_id")).alias("f"),
        F.min_by(pick, F.struct("obb_ttc_s", "clearance_m", "pair_distance_m", "target_track_id")).alias("d"),
        F.count("*").alias("n_valid_targets_70m"), by_type("TYPE_VEHICLE").alias("n_vehicles_70m"),
        by_type("TYPE_PEDESTRIAN").alias("n_pedestrians_70m"), by_type("TYPE_CYCLIST").alias("n_cyclists_70m"))
    out = frame_spine(presence, n_frames).join(reduced, FRAME, "left")
    contact = c("d.overlap") | (c("d.ttc") <= 1e-6)
    status = (F.when(~c("any_row"), INVALID_FRAME).when(~c("ego_ok"), INVALID_EGO).when(c("d").isNull(), NO_EXPOSURE)
              .when(contact, OVERLAP).when(c("d.hit") & (c("d.ttc") < t_max), FUTURE_CONTACT).otherwise(CENSORED))
    out = out.withColumn("status", status)
    exposed = c("status").isin(OVERLAP, FUTURE_CONTACT, CENSORED)
    ttc = F.when(c("status") == CENSORED, F.lit(float(t_max))).when(exposed, c("d.ttc"))
    severity = (F.when(c("status") == OVERLAP, F.lit(1.0)).when(c("status") == CENSORED, F.lit(0.0))
                .when(c("status") == FUTURE_CONTACT, clip(F.lit(1.0) - (c("d.ttc") - t_min) / (t_max - t_min), 0.0, 1.0)))
    n = lambda name: F.coalesce(c(name), F.lit(0)).alias(name)
    return out.select(
        *FRAME, c("timestamp_seconds").alias("timestamp_s"), "status",
        ttc.alias("scene_ttc_min_s"), severity.alias("severity_c_t"),
        flag(ttc <= tau).alias("is_critical_3s"), F.lit(float(t_max)).alias("censor_time_s"),
        exposed.alias("is_exposed"), c("status").isin(OVERLAP, FUTURE_CONTACT).alias("is_event"),
        (c("status") == CENSORED).alias("is_censored"), (c("status") == OVERLAP).alias("is_overlap"),
        c("f.id").alias("focal_actor_id"), c("f.type").alias("focal_actor_type"),
        c("f.clearance").alias("focal_clearance_m"), c("f.dist").alias("focal_center_distance_m"),
        c("f.closing").alias("focal_closing_speed_mps"),
        c("d.id").alias("dominant_actor_id"), c("d.type").alias("dominant_actor_type"),
        c("d.clearance").alias("dominant_clearance_m"), c("d.dist").alias("dominant_center_distance_m"),
        c("d.closing").alias("dominant_closing_speed_mps"),
        n("n_valid_targets_70m"), n("n_vehicles_70m"), n("n_pedestrians_70m"), n("n_cyclists_70m"))


def frame_labels(frames: DataFrame) -> DataFrame:
    """Valid frames with TTC labels and the scenario-equal weight 1 / n_valid_frames."""
    valid = frames.filter(~F.col("status").isin(INVALID_FRAME, INVALID_EGO))
    ttc = F.coalesce("scene_ttc_min_s", F.lit(T_MAX_S))
    n = F.count("*").over(W.partitionBy("scenario_id"))
    return valid.withColumns({
        "target_ttc_s": ttc, "target_c_t": F.coalesce("severity_c_t", F.lit(0.0)),
        **{f"target_y_tau_{t}s": (ttc <= float(t)).cast("int") for t in (2, 3, 5)},
        "weight_scenario_equal": F.lit(1.0) / n})
