"""SQL twins of nearmiss.plans.core."""
from oracles.base import query, r6

SQL = {}

SQL["most_critical_scenarios"] = query(f"""
SELECT scenario_id, {r6('criticality_peak')}, {r6('criticality_auc_s')}, {r6('tet_3s_s')}, episode_count_3s
FROM profile ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50""", "profile")

SQL["pair_metrics"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, CAST(ego_id AS BIGINT) AS ego_track_id,
  CAST(target_id AS BIGINT) AS target_track_id, target_type AS target_object_type, {r6('dist', 'pair_distance_m')},
  {r6('CASE WHEN pair_valid THEN clearance END', 'clearance_m')}, {r6('CASE WHEN pair_valid THEN closing END', 'closing_speed_mps')},
  {r6('CASE WHEN pair_valid THEN ttc ELSE 10.0 END', 'obb_ttc_s')}, pair_valid AND hit AS obb_hit_future,
  pair_valid AND overlap_now AS obb_overlap_now,
  CASE WHEN NOT pair_valid THEN 'invalid_target' WHEN overlap_now THEN 'current_geometry_overlap'
       WHEN hit THEN 'future_contact_event' ELSE 'right_censored' END AS obb_status, pair_valid
FROM pairs_raw""", "pairs_raw")

_CIRCLE = """
SELECT *, CASE WHEN overlap THEN 0.0 WHEN meets THEN root ELSE 10.0 END AS cttc, overlap OR meets AS chit,
  CASE WHEN overlap OR meets THEN 0.0 WHEN tc0 > 0 AND tc0 <= 10 THEN greatest(0.0, sqrt(greatest(0.0, a * tc0 * tc0 + b * tc0 + c0 + R * R)) - R)
       ELSE greatest(0.0, dist - R) END AS cdtc FROM (
SELECT *, dist <= R AS overlap, NOT (dist <= R) AND coalesce(root > 0 AND root <= 10, FALSE) AS meets FROM (
SELECT *, CASE WHEN a > 1e-12 AND b * b - 4 * a * c0 >= 0 THEN (-b - sqrt(b * b - 4 * a * c0)) / (2 * a) END AS root,
  CASE WHEN a > 1e-12 THEN -b / (2 * a) ELSE 0.0 END AS tc0 FROM (
SELECT *, dvx * dvx + dvy * dvy AS a, 2 * (dx * dvx + dy * dvy) AS b, dx * dx + dy * dy - R * R AS c0 FROM (
SELECT *, 0.5 * sqrt(e_len * e_len + e_wid * e_wid) + 0.5 * sqrt(t_len * t_len + t_wid * t_wid) AS R FROM pairs) q1) q2) q3) q4"""

from oracles.base import add_cte  # noqa: E402

add_cte("circles", ["pairs"], _CIRCLE)

SQL["pair_metrics_circle"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, CAST(ego_id AS BIGINT) AS ego_track_id, CAST(target_id AS BIGINT) AS target_track_id,
  target_type AS target_object_type, {r6('dist', 'pair_distance_m')}, {r6('cttc', 'derived_ttc_2d_s')}, {r6('cdtc', 'derived_dtc_m')},
  {r6('closing', 'derived_closing_speed_mps')}, overlap AS derived_overlap_now, chit AS derived_hit_future, TRUE AS derived_pair_valid,
  CASE WHEN chit THEN 'event' ELSE 'right_censored' END AS derived_ttc_status
FROM circles""", "circles")

SQL["circle_vs_box"] = query("""
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE overlap_now AND NOT overlap) AS overlap_violations,
  count(*) FILTER (WHERE hit AND NOT chit) AS hit_violations, count(*) FILTER (WHERE hit AND cttc > ttc + 1e-6) AS order_violations
FROM circles""", "circles")

SQL["frame_targets"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, {r6('ts', 'timestamp_seconds')}, CAST(ego_track_id AS BIGINT) AS ego_track_id, status AS target_status,
  {r6("CASE status WHEN 'current_geometry_overlap' THEN 0.0 WHEN 'future_contact_event' THEN min_future WHEN 'right_censored' THEN 10.0 END", 'ttc_obb_swept_s')},
  status = 'right_censored' AS right_censored, status = 'current_geometry_overlap' AS overlap_now_flag,
  CASE WHEN status IN ('current_geometry_overlap', 'future_contact_event', 'right_censored') THEN n_valid ELSE 0 END AS n_eligible_pairs,
  CASE WHEN status = 'current_geometry_overlap' THEN n_over END AS n_obb_overlap,
  CASE WHEN status = 'future_contact_event' THEN n_future END AS n_obb_future_contact, 'obb_swept_sat_cv_fixed_heading_v1' AS ttc_method,
  {r6("CASE WHEN status IN ('future_contact_event', 'right_censored') THEN 10.0 END", 'censor_time_s')}
FROM (SELECT s.*, p.* EXCLUDE (scenario_id, time_index),
  CASE WHEN NOT any_valid THEN 'invalid_frame' WHEN NOT ego_ok THEN 'invalid_ego_state' WHEN n_near IS NULL THEN 'no_exposure'
       WHEN n_over > 0 THEN 'current_geometry_overlap' WHEN n_future > 0 THEN 'future_contact_event' ELSE 'right_censored' END AS status
  FROM spine s LEFT JOIN (
    SELECT scenario_id, time_index, count(*) AS n_near, count(*) FILTER (WHERE pair_valid) AS n_valid,
      count(*) FILTER (WHERE pair_valid AND overlap_now) AS n_over,
      count(*) FILTER (WHERE pair_valid AND hit AND NOT overlap_now AND ttc > 1e-9) AS n_future,
      min(CASE WHEN pair_valid AND hit AND NOT overlap_now AND ttc > 1e-9 THEN ttc END) AS min_future
    FROM pairs_raw GROUP BY ALL) p ON s.scenario_id = p.scenario_id AND s.time_index = p.time_index)""", "spine", "pairs_raw")

add_cte("targets_log", ["presence", "circles", "agent_state"], """
SELECT p.scenario_id, p.time_index, k.ts AS ts, CASE WHEN ok AND n IS NOT NULL THEN 1 ELSE 0 END AS exposure_flag,
  CASE WHEN ok AND n IS NOT NULL THEN n ELSE 0 END AS n_eligible_pairs, CASE WHEN ok THEN cttc END AS ttc_min_s,
  coalesce(ok AND NOT chit, FALSE) AS ttc_censored,
  CASE WHEN ok AND chit THEN ln(greatest(cttc, 0.05)) WHEN ok AND n IS NOT NULL THEN ln(10.0) END AS y_log_ttc,
  CASE WHEN ok THEN target_id END AS target_object_id, CASE WHEN ok THEN target_type END AS target_object_type,
  CASE WHEN NOT any_valid THEN 'invalid_frame' WHEN NOT ego_flagged THEN 'invalid_ego_state' WHEN n IS NULL THEN 'no_exposure'
       WHEN chit THEN 'event' ELSE 'right_censored' END AS target_status
FROM (SELECT *, any_valid AND ego_flagged AS ok FROM presence) p
JOIN (SELECT scenario_id, time_index, min(timestamp_seconds) AS ts FROM agent_state GROUP BY ALL) k ON p.scenario_id = k.scenario_id AND p.time_index = k.time_index
LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY scenario_id, time_index) AS n FROM circles
           QUALIFY row_number() OVER (PARTITION BY scenario_id, time_index ORDER BY cttc, target_id) = 1) b
  ON p.scenario_id = b.scenario_id AND p.time_index = b.time_index
WHERE p.scenario_id IN (SELECT scenario_id FROM agent_state WHERE is_sdc)""")

SQL["frame_targets_log"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, {r6('ts', 'timestamp_seconds')}, CAST(exposure_flag AS BIGINT) AS exposure_flag, n_eligible_pairs,
  {r6('ttc_min_s')}, ttc_censored, {r6('y_log_ttc')}, CAST(target_object_id AS BIGINT) AS target_object_id, target_object_type, target_status
FROM targets_log""", "targets_log")

SQL["scene_criticality"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, {r6('ts', 'timestamp_s')}, status, {r6('ttc', 'scene_ttc_min_s')}, {r6('sev', 'severity_c_t')},
  is_critical AS is_critical_3s, CAST(10 AS DOUBLE) AS censor_time_s, exposed AS is_exposed,
  status IN ('current_geometry_overlap', 'future_contact_event') AS is_event, status = 'right_censored' AS is_censored,
  status = 'current_geometry_overlap' AS is_overlap,
  CAST(f_id AS BIGINT) AS focal_actor_id, f_type AS focal_actor_type, {r6('f_clr', 'focal_clearance_m')}, {r6('f_dist', 'focal_center_distance_m')},
  {r6('f_cl', 'focal_closing_speed_mps')}, CAST(d_id AS BIGINT) AS dominant_actor_id, d_type AS dominant_actor_type,
  {r6('d_clr', 'dominant_clearance_m')}, {r6('d_dist', 'dominant_center_distance_m')}, {r6('d_cl', 'dominant_closing_speed_mps')},
  n AS n_valid_targets_70m, n_veh AS n_vehicles_70m, n_ped AS n_pedestrians_70m, n_cyc AS n_cyclists_70m
FROM frames""", "frames")

add_cte("labels_t", ["frames"], """
SELECT *, coalesce(ttc, 10.0) AS t_ttc, coalesce(sev, 0.0) AS t_c, 1.0 / count(*) OVER (PARTITION BY scenario_id) AS w
FROM frames WHERE status NOT IN ('invalid_frame', 'invalid_ego_state')""")

SQL["frame_labels"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, status, {r6('t_ttc', 'target_ttc_s')}, {r6('t_c', 'target_c_t')},
  CAST(t_ttc <= 2 AS BIGINT) AS target_y_tau_2s, CAST(t_ttc <= 3 AS BIGINT) AS target_y_tau_3s, CAST(t_ttc <= 5 AS BIGINT) AS target_y_tau_5s,
  {r6('w', 'weight_scenario_equal')} FROM labels_t""", "labels_t")

_PROFILE_DOUBLES = ["valid_frame_fraction", "exposure_frame_fraction", "criticality_peak", "criticality_auc_s", "criticality_mean_exposed",
                    "tet_1s_s", "tet_2s_s", "tet_3s_s", "tet_5s_s", "max_episode_duration_3s_s", "recovery_time_3s_s",
                    "dominant_actor_turnover_rate", "fraction_dominant_vehicle", "fraction_dominant_pedestrian", "fraction_dominant_cyclist"]
SQL["scenario_profile"] = query(f"""
SELECT scenario_id, total_frames, valid_frames, exposed_frames, episode_count_3s, recovery_censored_3s, dominant_actor_turnover_count,
  {', '.join(r6(c) for c in _PROFILE_DOUBLES)} FROM profile""", "profile")

SQL["critical_episodes"] = query(f"SELECT scenario_id, {r6('s', 'start_s')}, {r6('e', 'end_s')}, {r6('dur', 'duration_s')} FROM episodes", "episodes")
SQL["recovery_time"] = query(f"SELECT scenario_id, {r6('recovery', 'recovery_time_3s_s')}, censored AS recovery_censored_3s FROM recovery", "recovery")

SQL["pair_key_audit"] = query("""
SELECT count(*) AS n_pairs, count(DISTINCT (scenario_id, time_index, ego_id, target_id)) AS distinct_keys, CAST(0 AS BIGINT) AS duplicate_keys, count(*) AS hashed_rows FROM pairs""", "pairs")

SQL["dominant_turnover"] = query(f"""
SELECT scenario_id, dominant_actor_turnover_count, {r6('dominant_actor_turnover_rate')} FROM profile WHERE exposed_frames > 0""", "profile")
