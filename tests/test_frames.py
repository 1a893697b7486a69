"""Frame states, picks, profiles and history on literal rows."""
import pytest
from pyspark.sql import functions as F

from nearmiss.operators import features as X, frames as FR, pairs as P, profile as PR
from tests.conftest import state


def frame(states_df, rows, t=0):
    return FR.scene_criticality(states_df(rows)).filter(F.col("time_index") == t).first()


def test_nearest_in_time_and_counts(states_df):
    r = frame(states_df, [state(vx=10.0), state(track=101, x=64.5), state(track=102, x=14.5), state(track=103, x=34.5)])
    assert r.scene_ttc_min_s == pytest.approx(1.0) and r.dominant_actor_id == 102 and r.n_valid_targets_70m == 3
    assert r.severity_c_t == pytest.approx(0.9) and r.is_critical_3s


def test_ties_go_to_smaller_id(states_df):
    r = frame(states_df, [state(vx=10.0), state(track=20, x=24.5), state(track=10, x=24.5)])
    assert r.dominant_actor_id == 10 and r.focal_actor_id == 10


def test_focal_and_dominant_differ(states_df):
    r = frame(states_df, [state(vx=10.0, length=4.0), state(track=1, y=6.0, vx=10.0, vy=1.0, length=4.0), state(track=2, x=29.0, length=4.0)])
    assert r.focal_actor_id == 1 and r.focal_clearance_m == pytest.approx(4.0)
    assert r.dominant_actor_id == 2 and r.scene_ttc_min_s == pytest.approx(2.5)


def test_state_precedence(states_df):
    rows = [state(t=1, valid=False), state(t=1, track=1, x=9.0), state(t=2), state(t=2, track=1, x=90.0), state(t=3), state(t=3, track=1, x=1.0), state(t=3, track=2, x=20.0),
            state(t=4, vx=10.0), state(t=4, track=1, x=20.0), state(t=5), state(t=5, track=1, x=20.0), state(t=6), state(t=6, track=1, x=20.0, vx=None),
            state(t=7), state(t=7, track=1, x=5.0, kind="TYPE_OTHER"), state(t=8, valid=False), state(t=8, track=1, valid=False)]
    got = {r.time_index: r.status for r in FR.scene_criticality(states_df(rows)).collect()}
    want = {0: "invalid_frame", 1: "invalid_ego_state", 2: "no_exposure", 3: "current_geometry_overlap", 4: "future_contact_event", 5: "right_censored", 6: "no_exposure",
            7: "no_exposure", 8: "invalid_ego_state", 9: "invalid_frame"}
    assert {k: got[k] for k in want} == want and len(got) == 91
    targets = {r.time_index: r for r in FR.frame_targets(states_df(rows)).collect()}
    # An unusable near actor keeps this builder's frame out of no_exposure.
    assert targets[6].target_status == "right_censored" and targets[6].n_eligible_pairs == 0
    assert targets[8].target_status == "invalid_frame"


def curve(spark, ttcs):
    """A scenario profile input with the given TTC per frame (None: no exposure)."""
    rows = []
    for t, v in enumerate(ttcs):
        sev = None if v is None else max(0.0, 1 - v / 10)
        status = "no_exposure" if v is None else "right_censored" if v >= 10 else "future_contact_event"
        rows.append(("s", t, t * 0.1, status, v, sev, v is not None, 7 if v is not None else None, "TYPE_VEHICLE" if v is not None else None))
    return spark.createDataFrame(rows, "scenario_id string, time_index int, timestamp_s double, status string, scene_ttc_min_s double, severity_c_t double, "
                                       "is_exposed boolean, dominant_actor_id int, dominant_actor_type string")


def test_constant_ttc_profile(spark):
    r = PR.scenario_profile(curve(spark, [2.0] * 10)).first()
    assert r.criticality_peak == pytest.approx(0.8) and r.tet_3s_s == pytest.approx(1.0) and r.criticality_auc_s == pytest.approx(0.8)
    assert r.episode_count_3s == 1 and r.recovery_censored_3s and r.recovery_time_3s_s == pytest.approx(0.9)


def test_last_frame_counts_a_tenth(spark):
    r = PR.scenario_profile(curve(spark, [None, 2.0])).first()
    assert r.tet_3s_s == pytest.approx(0.1)


def test_episode_merge_and_minimum(spark):
    near = [2.0] * 4 + [9.0] * 4 + [2.0] * 4     # 0.4 s + 0.4 s gap + 0.4 s -> one merged episode
    far = [2.0] * 6 + [9.0] * 7 + [2.0] * 6      # 0.7 s apart -> two
    short = [9.0] * 5 + [2.0] * 3 + [9.0] * 10   # 0.3 s -> dropped
    n = lambda c: PR.scenario_profile(curve(spark, c)).first()
    assert n(near).episode_count_3s == 1 and n(near).max_episode_duration_3s_s == pytest.approx(1.2)
    assert n(far).episode_count_3s == 2 and n(short).episode_count_3s == 0
    for c in (near, far, short):
        df = curve(spark, c)
        assert PR.critical_episodes(df).count() == n(c).episode_count_3s


def test_recovery_after_peak(spark):
    r = PR.scenario_profile(curve(spark, [5.0, 1.0, 2.0] + [9.0] * 3 + [2.0] + [9.0] * 8)).first()
    # Peak at 0.1 s; the first hold of five safe frames ends at 1.1 s.
    assert not r.recovery_censored_3s and r.recovery_time_3s_s == pytest.approx(1.1 - 0.5 - 0.1)
    s = PR.recovery_time(curve(spark, [5.0, 1.0, 2.0] + [9.0] * 3 + [2.0] + [9.0] * 8)).first()
    assert s.recovery_time_3s_s == pytest.approx(r.recovery_time_3s_s)


def test_scenario_without_exposure(spark):
    r = PR.scenario_profile(curve(spark, [None] * 5)).first()
    assert (r.exposed_frames, r.criticality_peak, r.episode_count_3s, r.recovery_censored_3s, r.recovery_time_3s_s) == (0, 0.0, 0, True, 0.0)


def test_weights_sum_to_one_per_scenario(states_df):
    rows = [state("a", t) for t in range(3)] + [state("b", t) for t in range(7)]
    sums = FR.frame_labels(FR.scene_criticality(states_df(rows))).groupBy("scenario_id").agg(F.sum("weight_scenario_equal").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in sums) and len(sums) == 2


def moving_scene(n=30, after=None):
    """Ego and three actors; frames later than `after` are shifted wildly."""
    rows = []
    for t in range(n):
        k = 40.0 if after is not None and t > after else 0.0
        rows += [state(t=t, x=t * 1.0, vx=10.0), state(t=t, track=1, x=30.0 - k, y=4.0, vx=-3.0), state(t=t, track=2, x=10.0 + t, y=-5.0 + k, vx=8.0, h=0.3)]
        if t % 4:
            rows.append(state(t=t, track=3, x=20.0, y=9.0 + k, vy=-1.0, kind="TYPE_PEDESTRIAN", length=0.8, width=0.8))
    return rows


def test_features_see_no_future(spark, states_df):
    points = spark.createDataFrame([("s", 1, "lane", i, float(i), 1.0, 0.0) for i in range(60)], "scenario_id string, feature_id long, feature_type string, point_index int, x double, y double, z double")
    signals = spark.createDataFrame([("s", t, 1, "LANE_STATE_STOP", 12.0, 3.0) for t in range(30)], "scenario_id string, time_index int, lane_id long, signal_state string, stop_point_x double, stop_point_y double")
    table = lambda rows: X.frame_feature_table(states_df(rows), points, signals).filter(F.col("time_index") == 15).first().asDict()
    a, b = table(moving_scene()), table(moving_scene(after=15))
    assert a == b
    assert a["e_static__lane_point_density_50m"] == 60 and a["e_static__dist_nearest_crosswalk_m"] == 100.0
    assert a["e_dynamic__active_stop_signal_count_70m"] == 1.0 and a["e_hist__actor_composition_turnover_1s"] == 4.0


def test_row_order_does_not_matter(states_df):
    rows = moving_scene(12)
    key = lambda rs: sorted(map(str, FR.scene_criticality(states_df(rs)).collect()))
    assert key(rows) == key(rows[::-1])


def test_one_scenario_holding_most_rows(states_df):
    """A scenario with very many actors gives the same result as brute force."""
    rows = [state("hot"), *[state("hot", track=i, x=(i % 50) - 25.0, y=(i // 50) * 3.0 + 4, vx=(i % 7) - 3.0) for i in range(1, 600)], state("cold"), state("cold", track=1, x=9.0)]
    got = {r.scenario_id: r for r in FR.scene_criticality(states_df(rows)).filter("time_index = 0").collect()}
    near = sum(1 for r in rows if r[0] == "hot" and r[3] > 0 and (r[6] ** 2 + r[7] ** 2) ** 0.5 <= 70)
    assert got["hot"].n_valid_targets_70m == near and got["cold"].n_valid_targets_70m == 1


def test_long_polyline_in_chunks(spark):
    from nearmiss.operators.mapjoin import lane_headings
    rows = [("s", 1, "lane", i, float(i), float((i * 7) % 5), 0.0) for i in range(40) if i not in (11, 12, 13, 14, 15)] + [("s", 2, "lane", 3, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "scenario_id string, feature_id long, feature_type string, point_index int, x double, y double, z double")
    key = lambda d: {(r.feature_id, r.point_index): r.lane_heading for r in d.collect()}
    assert key(lane_headings(df, chunk=4)) == key(lane_headings(df)) and key(lane_headings(df))[(2, 3)] == 0.0
