"""Scenario and frame context joined into one model-ready table."""
from pyspark.sql import DataFrame, functions as F

from nearmiss.constants import (C_ODD, DEFAULT_SPEED_LIMIT_MPS, GO_STATES, MODEL_FEATURES, R2_CONTEXT, R2_STATE, STOP_STATES, Z_STATE)
from nearmiss.functions.geometry import speed
from nearmiss.operators.frames import frame_targets, frame_targets_log
from nearmiss.operators.kinematics import kinematics
from nearmiss.operators.pairs import FRAME, ego_track, frame_presence
from nearmiss.operators.quality import leakage_audit
from nearmiss.operators.splits import legacy_split_of
from nearmiss.session import durable

_MAP_COUNTS = {"odd_n_lanes": "lane", "odd_n_road_lines": "road_line", "odd_n_road_edges": "road_edge", "odd_n_crosswalks": "crosswalk",
               "odd_n_stop_signs": "stop_sign", "odd_n_speed_bumps": "speed_bump", "odd_n_driveways": "driveway"}


def frame_context(states: DataFrame, presence: DataFrame | None = None) -> DataFrame:
    """Valid actors per class and frame."""
    presence = frame_presence(states) if presence is None else presence
    return presence.select(*FRAME, "n_valid_agents", "n_vehicles", "n_pedestrians", "n_cyclists")


def map_feature_counts(points: DataFrame) -> DataFrame:
    """Distinct features by type per scenario; features are made distinct before they are counted."""
    features = points.groupBy("scenario_id", "feature_type", "feature_id").agg(F.lit(1).alias("one"))
    return features.groupBy("scenario_id").agg(
        F.count("*").alias("odd_n_map_features"), *[F.count_if(F.col("feature_type") == t).alias(n) for n, t in _MAP_COUNTS.items()])


def signal_ratios(signals: DataFrame) -> DataFrame:
    """Signals of a frame and their go / stop shares."""
    n = F.count("*")
    return signals.groupBy(*FRAME).agg(
        F.lit(1).alias("odd_has_signal"), n.alias("odd_n_active_signals"),
        (F.count_if(F.col("signal_state").isin(*GO_STATES)) / n).alias("odd_signal_go_ratio"),
        (F.count_if(F.col("signal_state").isin(*STOP_STATES)) / n).alias("odd_signal_stop_ratio"))


def ego_state_features(ego: DataFrame) -> DataFrame:
    """Ego speed and its ratio to the default limit."""
    v = F.when(F.col("valid"), speed())
    return ego.select(*FRAME, v.alias("ego_speed_mps"), (v / DEFAULT_SPEED_LIMIT_MPS).alias("ego_speed_ratio"))


def attach_context(targets: DataFrame, context: DataFrame, map_counts: DataFrame, signals: DataFrame, ego: DataFrame) -> DataFrame:
    """Left joins of traffic, map, signal and ego features onto frame targets."""
    odd = {n: f"odd_{n}" for n in ("n_valid_agents", "n_vehicles", "n_pedestrians", "n_cyclists")}
    out = (targets.join(context.withColumnsRenamed(odd), FRAME, "left").join(signal_ratios(signals), FRAME, "left")
           .join(ego_state_features(ego), FRAME, "left").join(map_counts, "scenario_id", "left"))
    filled = ["odd_has_signal", "odd_n_active_signals", "odd_signal_go_ratio", "odd_signal_stop_ratio"]
    return out.na.fill(0, filled)


def scaler_stats(df: DataFrame, features: list) -> DataFrame:
    """One row per feature: mean, sample std (1 if below 1e-12), min, max and counts."""
    per = [x for f in features for x in (F.avg(f).alias(f"{f}|mean"), F.stddev_samp(F.col(f).cast("double")).alias(f"{f}|std"),
                                         F.min(f).cast("double").alias(f"{f}|min"), F.max(f).cast("double").alias(f"{f}|max"), F.count(f).alias(f"{f}|n"))]
    wide = df.agg(F.count("*").alias("total"), *per)
    c = lambda f, s: F.col(f"`{f}|{s}`")
    std = lambda f: F.when(c(f, "n") > 1, F.when(c(f, "std") < 1e-12, F.lit(1.0)).otherwise(c(f, "std"))).otherwise(F.lit(1.0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("feature"), zero(c(f, "mean")).alias("mean"), std(f).alias("std"), zero(c(f, "min")).alias("min"), zero(c(f, "max")).alias("max"),
        c(f, "n").alias("n_non_null"), F.col("total").alias("n_total")) for f in features])))


def apply_scaler(df: DataFrame, stats: DataFrame, features: list) -> DataFrame:
    """Standardised copies <feature>_z. The statistics are one row per feature."""
    known = {r["feature"]: r for r in stats.collect()}
    return df.withColumns({f"{f}_z": (F.col(f) - F.lit(known[f]["mean"])) / F.lit(known[f]["std"]) for f in features if f in known})


def model_table(states: DataFrame, points: DataFrame, signals: DataFrame) -> DataFrame:
    """Log-TTC targets, 16 context and 2 state features with scaled copies; scaled on the train split only."""
    audit = leakage_audit(MODEL_FEATURES)
    if audit["status"] != "PASS":
        raise ValueError(f"model features leak the target: {audit}")
    presence = durable(frame_presence(states))
    table = attach_context(frame_targets_log(states, presence), frame_context(states, presence), map_feature_counts(points), signals, ego_track(presence))
    table = durable(table.withColumn("split", legacy_split_of(F.col("scenario_id"))))
    stats = scaler_stats(table.filter("split = 'train'"), MODEL_FEATURES)
    keep = ["scenario_id", "time_index", "timestamp_seconds", "split", *C_ODD, *Z_STATE]
    scaled = apply_scaler(table, stats, MODEL_FEATURES)
    return scaled.select(*keep, *[f"{f}_z" for f in MODEL_FEATURES], "y_log_ttc", "ttc_censored", "exposure_flag", "target_status")


def r2_features(states: DataFrame) -> DataFrame:
    """Frame targets with six ego / nearest-pair features and the actor count."""
    presence = durable(frame_presence(states))
    ego = kinematics(ego_track(presence)).select(
        *FRAME, F.col("derived_speed_mps").alias("ego_speed_mps"), F.col("derived_accel_mps2").alias("ego_accel_mps2"),
        F.col("derived_yaw_rate_rps").alias("ego_yaw_rate_rps"))
    context = frame_context(states, presence).select(*FRAME, F.col("n_valid_agents").alias("traffic_n_valid_agents"))
    out = frame_targets(states, presence, reductions=True).join(ego, FRAME, "left").join(context, FRAME, "left")
    return out.select(*FRAME, "target_status", "ttc_obb_swept_s", "right_censored", "overlap_now_flag", "ttc_method", "censor_time_s", *R2_STATE, *R2_CONTEXT)
