"""Catalog: pairs, frames and profiles."""
from pyspark.sql import functions as F

from nearmiss.operators import frames as FR, pairs as P, profile as PR
from nearmiss.plans.catalog import query, rounded
from nearmiss.sources.fixture import states


def frames_of(spark, sf_dir):
    return FR.scene_criticality(states(spark, sf_dir))


def profile_of(spark, sf_dir):
    return PR.scenario_profile(frames_of(spark, sf_dir))


@query
def most_critical_scenarios(spark, sf_dir):
    p = profile_of(spark, sf_dir).select("scenario_id", "criticality_peak", "criticality_auc_s", "tet_3s_s", "episode_count_3s")
    p = rounded(p).orderBy(F.desc("criticality_peak"), F.desc("criticality_auc_s"), "scenario_id")
    return p.limit(50)


@query
def pair_metrics(spark, sf_dir):
    df = P.pair_metrics(states(spark, sf_dir), valid_targets_only=False)
    return rounded(df.select("scenario_id", "time_index", "ego_track_id", "target_track_id", "target_object_type",
                             "pair_distance_m", "clearance_m", "closing_speed_mps", "obb_ttc_s", "obb_hit_future",
                             "obb_overlap_now", "obb_status", "pair_valid"))


@query
def pair_metrics_circle(spark, sf_dir):
    return rounded(P.circle_pair_metrics(states(spark, sf_dir)))


@query
def circle_vs_box(spark, sf_dir):
    return rounded(P.containment_audit(P.circle_vs_box(states(spark, sf_dir))))


@query
def frame_targets(spark, sf_dir):
    return rounded(FR.frame_targets(states(spark, sf_dir)))


@query
def frame_targets_log(spark, sf_dir):
    return rounded(FR.frame_targets_log(states(spark, sf_dir)))


@query
def scene_criticality(spark, sf_dir):
    return rounded(frames_of(spark, sf_dir))


@query
def frame_labels(spark, sf_dir):
    df = FR.frame_labels(frames_of(spark, sf_dir))
    return rounded(df.select("scenario_id", "time_index", "status", "target_ttc_s", "target_c_t", "target_y_tau_2s",
                             "target_y_tau_3s", "target_y_tau_5s", "weight_scenario_equal"))


@query
def scenario_profile(spark, sf_dir):
    return rounded(profile_of(spark, sf_dir))


@query
def critical_episodes(spark, sf_dir):
    return rounded(PR.critical_episodes(frames_of(spark, sf_dir)).drop("episode"))


@query
def recovery_time(spark, sf_dir):
    return rounded(PR.recovery_time(frames_of(spark, sf_dir)))


@query
def pair_key_audit(spark, sf_dir):
    return rounded(P.pair_key_audit(P.ego_target_pairs(states(spark, sf_dir))))


@query
def dominant_turnover(spark, sf_dir):
    return rounded(PR.dominant_turnover(frames_of(spark, sf_dir)))
