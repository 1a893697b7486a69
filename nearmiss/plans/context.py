"""Catalog: kinematics, features."""
from pyspark.sql import functions as F

from nearmiss.constants import E_DYNAMIC, E_HIST, E_STATIC, P_CLEAN
from nearmiss.operators import features as X, kinematics as K, mapjoin as MJ
from nearmiss.plans.catalog import query, rounded
from nearmiss.operators.frames import scene_criticality
from nearmiss.operators.pairs import frame_presence
from nearmiss.plans.core import frames_of
from nearmiss.session import durable_rows
from nearmiss.sources.fixture import map_points, signals, states


@query
def kinematics(spark, sf_dir):
    return rounded(K.kinematics(states(spark, sf_dir)).select(
        "scenario_id", "time_index", "track_id", "derived_speed_mps", "derived_accel_mps2", "derived_yaw_rate_rps",
        "derived_jerk_mps3", "derived_kinematic_valid"))


@query
def path_length(spark, sf_dir):
    return rounded(K.path_length(states(spark, sf_dir)).select("scenario_id", "track_id", "time_index", "step_m", "path_m"), 5)


@query
def nearest_map_point(spark, sf_dir):
    return rounded(MJ.nearest_distance(X.ego_positions(frame_presence(states(spark, sf_dir))), map_points(spark, sf_dir)))


@query
def lane_heading(spark, sf_dir):
    return rounded(MJ.lane_headings(map_points(spark, sf_dir)).select("scenario_id", "feature_id", "point_index", "lane_heading"))


@query
def lane_points_in_radius(spark, sf_dir):
    return rounded(MJ.lane_context(X.ego_positions(frame_presence(states(spark, sf_dir))), map_points(spark, sf_dir)))


@query
def signals_in_radius(spark, sf_dir):
    return rounded(MJ.signal_context(X.ego_positions(frame_presence(states(spark, sf_dir))), signals(spark, sf_dir)))


def _context(spark, sf_dir):
    s = durable_rows(states(spark, sf_dir))
    presence = durable_rows(frame_presence(s))
    frames = durable_rows(scene_criticality(s, presence))
    return s, presence, frames, durable_rows(X.actor_context(X.past_actor_pairs(s, presence, X.focal_of(frames))))


@query
def p_clean_features(spark, sf_dir):
    _, presence, frames, ctx = _context(spark, sf_dir)
    return rounded(X.physics_controls(frames, presence, ctx))


@query
def e_static_features(spark, sf_dir):
    presence = durable_rows(frame_presence(states(spark, sf_dir)))
    return rounded(X.static_context(presence, map_points(spark, sf_dir), signals(spark, sf_dir)))


@query
def e_dynamic_features(spark, sf_dir):
    _, presence, _, ctx = _context(spark, sf_dir)
    return rounded(X.dynamic_context(presence, ctx))


@query
def e_hist_features(spark, sf_dir):
    s, presence, frames, ctx = _context(spark, sf_dir)
    return rounded(X.history_context(frames, s, presence, ctx))


@query
def composition_turnover(spark, sf_dir):
    return rounded(X.actor_history(frames_of(spark, sf_dir), states(spark, sf_dir)))


def feature_table(spark, sf_dir):
    """The views of actors and map points are read several times, so each is derived once."""
    return X.frame_feature_table(durable_rows(states(spark, sf_dir)), durable_rows(map_points(spark, sf_dir)), signals(spark, sf_dir))


@query
def frame_feature_table(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir))


@query
def scenario_feature_means(spark, sf_dir):
    return rounded(X.scenario_feature_means(feature_table(spark, sf_dir), P_CLEAN + E_STATIC + E_DYNAMIC + E_HIST))
