"""SQL twins of nearmiss.plans.tables."""
from oracles import context  # noqa: F401  (defines the CTEs used here)
from oracles.base import add_cte, query, r6
from oracles.context import KEY

SQL = {}

add_cte("grid", ["agent_state"], """
SELECT s.scenario_id, CAST(u AS INT) AS time_index FROM (SELECT DISTINCT scenario_id FROM agent_state) s, range(91) r(u)""")
add_cte("dense", ["grid", "agent_state"], """
SELECT k.scenario_id, u.time_index, k.track_id, k.code, coalesce(a.valid, FALSE) AS valid, a.* EXCLUDE (scenario_id, time_index, track_id, valid)
FROM (SELECT scenario_id, track_id, max(CASE object_type WHEN 'TYPE_VEHICLE' THEN 1 WHEN 'TYPE_PEDESTRIAN' THEN 2 WHEN 'TYPE_CYCLIST' THEN 3 ELSE 7 END) AS code
      FROM agent_state GROUP BY ALL) k JOIN grid u ON k.scenario_id = u.scenario_id
LEFT JOIN agent_state a ON a.scenario_id = k.scenario_id AND a.track_id = k.track_id AND a.time_index = u.time_index""")

SQL["flatten_scenario"] = query("""
SELECT s.scenario_id, CAST(91 AS BIGINT) AS n_timestamps, n_tracks, CAST(0 AS BIGINT) AS sdc_track_index, coalesce(n_map, 0) AS n_map_features,
  CAST(CASE WHEN n_sig > 0 THEN 91 ELSE 0 END AS BIGINT) AS n_dynamic_signal_steps, CAST(1 AS BIGINT) AS n_objects_of_interest, CAST(s.scenario_id AS INT) % 2 = 0 AS has_sdc_paths,
  CAST(0 AS DOUBLE) AS timestamp_start, CAST(9 AS DOUBLE) AS timestamp_end, CAST(9 AS DOUBLE) AS duration_seconds
FROM (SELECT scenario_id, count(DISTINCT track_id) AS n_tracks FROM agent_state GROUP BY 1) s
LEFT JOIN (SELECT scenario_id, count(DISTINCT feature_id) AS n_map FROM map_feature GROUP BY 1) m ON s.scenario_id = m.scenario_id
LEFT JOIN (SELECT scenario_id, count(*) AS n_sig FROM dynamic_signal GROUP BY 1) g ON s.scenario_id = g.scenario_id""", "agent_state", "map_feature", "dynamic_signal")

_f4 = lambda c: f"round(CAST(CAST(CASE WHEN valid THEN {c} END AS FLOAT) AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS {c}"
_d4 = lambda c: f"round(CASE WHEN valid THEN {c} END, 4) + CAST(0 AS DOUBLE) AS {c}"
SQL["flatten_agent_state"] = query(f"""
SELECT {KEY}, round(CAST(time_index AS DOUBLE) / 10.0, 4) AS timestamp_seconds, CAST(track_id AS BIGINT) AS track_id,
  CASE code WHEN 1 THEN 'TYPE_VEHICLE' WHEN 2 THEN 'TYPE_PEDESTRIAN' WHEN 3 THEN 'TYPE_CYCLIST' ELSE 'UNKNOWN_7' END AS object_type, valid,
  {', '.join(_d4(c) for c in ('center_x', 'center_y', 'center_z'))},
  {', '.join(_f4(c) for c in ('velocity_x', 'velocity_y', 'heading', 'length', 'width', 'height'))},
  track_id = 1 AS is_sdc, track_id = 2 AS is_object_of_interest FROM dense""", "dense")

SQL["flatten_frame_context"] = query(f"""
SELECT {KEY}, round(CAST(time_index AS DOUBLE) / 10.0, 6) AS timestamp_seconds, count(*) FILTER (WHERE valid) AS n_valid_agents,
  count(*) FILTER (WHERE valid AND code = 1) AS n_vehicles, count(*) FILTER (WHERE valid AND code = 2) AS n_pedestrians,
  count(*) FILTER (WHERE valid AND code = 3) AS n_cyclists, count(*) FILTER (WHERE valid AND code > 3) AS n_other
FROM dense GROUP BY scenario_id, time_index""", "dense")

SQL["flatten_map_features"] = query(f"""
SELECT scenario_id, feature_id, feature_type, row_number() OVER w - 1 AS point_index, {r6('x')}, {r6('y')}, {r6('z')}
FROM map_feature WINDOW w AS (PARTITION BY scenario_id, feature_id ORDER BY point_index)
QUALIFY feature_type <> 'stop_sign' OR row_number() OVER w = 1""", "map_feature")

SQL["flatten_dynamic_signals"] = query(f"""
SELECT {KEY}, lane_id, signal_state, {r6('stop_point_x')}, {r6('stop_point_y')} FROM dynamic_signal""", "dynamic_signal")
SQL["flatten_sdc_paths"] = query(f"""
SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY time_index) - 1 AS point_index, {r6('center_x', 'x')}, {r6('center_y', 'y')}, {r6('center_z', 'z')} FROM agent_state a
WHERE valid AND CAST(scenario_id AS INT) % 2 = 0 AND track_id = (SELECT min(track_id) FROM agent_state b WHERE b.scenario_id = a.scenario_id)""", "agent_state")
SQL["with_aliases"] = query(f"""
SELECT {KEY}, CAST(track_id AS BIGINT) AS track_id, scenario_id AS segment_id, CAST(time_index AS BIGINT) AS frame_label, CAST(track_id AS BIGINT) AS obj_id FROM agent_state""", "agent_state")

SQL["field_coverage"] = query("""
SELECT field, present, n - present AS absent, round(100.0 * present / n, 2) AS coverage_pct, unsupported FROM (
  SELECT n, unnest([{'f': 'scenario_id', 'p': n, 'u': FALSE}, {'f': 'sdc_track_index', 'p': n, 'u': FALSE}, {'f': 'timestamps_seconds', 'p': n, 'u': FALSE},
    {'f': 'tracks', 'p': n, 'u': FALSE}, {'f': 'dynamic_map_states', 'p': ns, 'u': FALSE}, {'f': 'map_features', 'p': nm, 'u': FALSE}, {'f': 'objects_of_interest', 'p': n, 'u': FALSE},
    {'f': 'sdc_paths', 'p': np, 'u': np = 0}, {'f': 'path_samples', 'p': 0, 'u': TRUE}, {'f': 'weather', 'p': 0, 'u': TRUE}, {'f': 'visibility', 'p': 0, 'u': TRUE},
    {'f': 'friction', 'p': 0, 'u': TRUE}]) AS s FROM (
      SELECT (SELECT count(DISTINCT scenario_id) FROM agent_state) AS n, (SELECT count(DISTINCT scenario_id) FROM dynamic_signal) AS ns,
             (SELECT count(DISTINCT scenario_id) FROM map_feature) AS nm,
             (SELECT count(DISTINCT scenario_id) FROM agent_state WHERE CAST(scenario_id AS INT) % 2 = 0) AS np)) t, LATERAL (SELECT s.f AS field, s.p AS present, s.u AS unsupported)""", "agent_state", "map_feature", "dynamic_signal")

SQL["timestamp_stats"] = query(f"""
SELECT measure, count(*) AS count, count(DISTINCT v) AS unique_values, {r6('min(v)', 'min')}, {r6('max(v)', 'max')}, {r6('avg(v)', 'mean')}, {r6('median(v)', 'median')}, {r6('stddev_samp(v)', 'stdev')}
FROM (SELECT 'length' AS measure, CAST(count(DISTINCT time_index) AS DOUBLE) AS v FROM agent_state GROUP BY scenario_id
      UNION ALL SELECT 'step', d FROM (SELECT round_even(t - lag(t) OVER (PARTITION BY scenario_id ORDER BY time_index), 6) AS d
        FROM (SELECT DISTINCT scenario_id, time_index, timestamp_seconds AS t FROM agent_state)) WHERE d IS NOT NULL) GROUP BY measure""", "agent_state")

SQL["duplicate_keys"] = """
SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows, count(*) AS distinct_keys
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)"""
SQL["orphan_keys"] = "SELECT count(DISTINCT l_orderkey) AS orphan_keys FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"
_miss = ", ".join(f"round(100.0 * count(*) FILTER (WHERE valid AND {c} IS NULL) / count(*) FILTER (WHERE valid), 4) AS missing_pct_{c}"
                  for c in ("center_x", "center_y", "center_z", "velocity_x", "velocity_y", "heading", "length", "width", "height"))
SQL["validity_ratios"] = query(f"""
SELECT count(*) AS n_states, round(count(*) FILTER (WHERE NOT valid) / count(*), 4) AS invalid_state_ratio,
  count(*) FILTER (WHERE NOT valid AND center_x IS NOT NULL) = 0 AS invalid_states_are_null, {_miss} FROM agent_state""", "agent_state")
SQL["map_coverage"] = query("""
SELECT coalesce(feature_type, 'ALL') AS feature_type, count(*) AS points, count(DISTINCT (scenario_id, feature_id)) AS n_features
FROM map_feature GROUP BY GROUPING SETS ((feature_type), ())""", "map_feature")
SQL["signal_coverage"] = query("""
SELECT *, round(100.0 * timesteps_with_signals / n_frames, 2) AS signal_coverage_pct FROM (
SELECT count(*) AS total_entries, count(DISTINCT (scenario_id, time_index)) AS timesteps_with_signals, count(DISTINCT (scenario_id, lane_id)) AS unique_lanes,
  (SELECT count(DISTINCT (scenario_id, time_index)) FROM agent_state) AS n_frames FROM dynamic_signal)""", "dynamic_signal", "agent_state")

from oracles.core import SQL as CORE  # noqa: E402

_TARGETS = CORE["frame_targets"]
_with_targets = lambda sel: sel.replace("{T}", f"({_TARGETS})")
SQL["status_distribution"] = _with_targets("SELECT target_status AS status, count(*) AS n_frames FROM {T} GROUP BY 1")
SQL["risk_set_audit"] = _with_targets("""
SELECT count(*) AS n_frames, count(*) FILTER (WHERE target_status IN ('future_contact_event', 'right_censored')) AS n_primary,
  count(*) FILTER (WHERE target_status = 'future_contact_event') AS n_events,
  count(*) FILTER (WHERE target_status IN ('future_contact_event', 'right_censored') AND overlap_now_flag) AS overlap_in_primary,
  count(*) FILTER (WHERE target_status = 'future_contact_event' AND right_censored) AS censored_events,
  count(*) FILTER (WHERE target_status = 'future_contact_event' AND NOT coalesce(ttc_obb_swept_s > 0, FALSE)) AS bad_event_ttc,
  CAST(0 AS BIGINT) AS unknown_status, count(*) - count(DISTINCT (scenario_id, time_index)) AS duplicate_frame_keys FROM {T}""")
SQL["method_audit"] = _with_targets("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE ttc_method = 'obb_swept_sat_cv_fixed_heading_v1') AS n_method,
  count(*) FILTER (WHERE ttc_method <> 'obb_swept_sat_cv_fixed_heading_v1') AS n_other_method, CAST(0 AS BIGINT) AS legacy_columns, TRUE AS passed FROM {T}""")
SQL["primary_risk_set"] = _with_targets("""
SELECT scenario_id, time_index, target_status, ttc_obb_swept_s FROM {T} WHERE target_status IN ('future_contact_event', 'right_censored')""")

SPLIT = """CASE WHEN {u} < 0.7 THEN 'train' WHEN {u} < 0.85 THEN 'internal_val' ELSE 'internal_holdout' END"""
_hex = lambda e, i, n=8: f"CAST(('0x' || substr({e}, {i}, {n})) AS UBIGINT)"
_sha = "sha256('womd_r2_split_v1|42|' || scenario_id)"
_u = f"((CAST({_hex(_sha, 1)} AS DOUBLE) * 4294967296.0 + CAST({_hex(_sha, 9)} AS DOUBLE)) / 18446744073709551616.0)"
_md = "md5(scenario_id || '_42')"
_m = "0"
for _i in range(4):
    _m = f"(({_m}) * 4294967296 + {_hex(_md, 1 + 8 * _i)}) % 10000"
add_cte("ids", ["agent_state"], "SELECT DISTINCT scenario_id FROM agent_state")
add_cte("splits", ["ids"], f"""
SELECT scenario_id, u, {SPLIT.format(u='u')} AS split, CASE WHEN m < 7000 THEN 'train' WHEN m < 8500 THEN 'internal_val' ELSE 'internal_holdout' END AS legacy,
  CAST({_hex("sha256('WACV2027_WARP_SEED_V3:' || scenario_id)", 1)} AS DOUBLE) / 4294967295.0 < 0.2 AS warp
FROM (SELECT scenario_id, {_u} AS u, {_m} AS m FROM ids)""")
SQL["assign_split"] = query("SELECT scenario_id, round(u, 9) + CAST(0 AS DOUBLE) AS u, split, legacy AS legacy_split, warp AS warp_sample FROM splits", "splits")
SQL["split_overlap"] = query("""SELECT scenario_id, least(split, legacy) AS first_split, greatest(split, legacy) AS last_split FROM splits WHERE split <> legacy""", "splits")
SQL["split_counts"] = query("""SELECT split, count(*) AS n_rows, count(DISTINCT a.scenario_id) AS n_scenarios FROM agent_state a JOIN splits s ON a.scenario_id = s.scenario_id GROUP BY 1""", "agent_state", "splits")
SQL["attach_split"] = query("""SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE split IS NULL) AS n_unassigned FROM agent_state a LEFT JOIN splits s ON a.scenario_id = s.scenario_id GROUP BY 1""", "agent_state", "splits")
SQL["dev_only"] = query("""SELECT a.scenario_id, split, count(*) AS n_states FROM agent_state a JOIN splits s ON a.scenario_id = s.scenario_id WHERE split <> 'internal_holdout' GROUP BY ALL""", "agent_state", "splits")
SQL["membership_audit"] = query("""
SELECT count(*) AS n_scenarios, CAST(0 AS BIGINT) AS n_overlap, count(*) FILTER (WHERE s.k IS NULL) AS n_unassigned, count(*) FILTER (WHERE i.scenario_id IS NULL) AS n_unknown, CAST(0 AS BIGINT) AS n_external
FROM ids i FULL JOIN (SELECT CAST(s_suppkey AS STRING) AS k FROM supplier) s ON i.scenario_id = s.k""", "ids")
SQL["membership_digest"] = query(f"""SELECT split, count(*) AS n_scenarios, CAST(sum(CAST({_hex('sha256(scenario_id)', 1, 15)} AS HUGEINT)) AS STRING) AS digest FROM splits GROUP BY 1""", "splits")
SQL["first_n_scenarios"] = query("""SELECT scenario_id, count(*) AS n_states FROM agent_state WHERE scenario_id IN (SELECT scenario_id FROM ids ORDER BY 1 LIMIT 20) GROUP BY 1""", "agent_state", "ids")

SQL["feature_coverage"] = query("""
SELECT f AS feature_name, c AS valid_count, round(c / n, 6) AS coverage_ratio FROM (
SELECT n, unnest(['center_x', 'heading', 'derived_speed_mps', 'derived_accel_mps2', 'derived_jerk_mps3']) AS f, unnest([a, b, c1, d, e]) AS c FROM (
SELECT count(*) AS n, count(center_x) AS a, count(heading) AS b, count(speed) AS c1, count(accel) AS d, count(jerk) AS e FROM kin))""", "kin")
SQL["finite_features"] = query("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE center_x IS NOT NULL AND speed IS NOT NULL AND accel IS NOT NULL) AS n_kept,
  count(*) FILTER (WHERE center_x IS NULL) AS nonfinite_center_x, count(*) FILTER (WHERE speed IS NULL) AS nonfinite_derived_speed_mps,
  count(*) FILTER (WHERE accel IS NULL) AS nonfinite_derived_accel_mps2 FROM kin""", "kin")
SQL["feature_contract"] = query("""
SELECT f AS feature_name, p AS present, an AS all_null, k AS constant, p AND NOT an AND NOT k AS passed FROM (
SELECT unnest(['center_x', 'height', 'derived_speed_mps', 'derived_jerk_mps3', 'no_such_feature']) AS f, unnest([TRUE, TRUE, TRUE, TRUE, FALSE]) AS p,
  unnest([a = 0, b = 0, c = 0, d = 0, TRUE]) AS an, unnest([a1, b1, c1, d1, FALSE]) AS k FROM (
SELECT count(center_x) AS a, count(height) AS b, count(speed) AS c, count(jerk) AS d, count(DISTINCT center_x) = 1 AS a1, count(DISTINCT height) = 1 AS b1,
  count(DISTINCT speed) = 1 AS c1, count(DISTINCT jerk) = 1 AS d1 FROM kin))""", "kin")
SQL["holdout_qc"] = query(f"""
SELECT count(*) AS total_frames, count(DISTINCT scenario_id) AS total_scenarios, {r6('count(*) / count(DISTINCT scenario_id)', 'mean_frames_per_scenario')},
  count(*) FILTER (WHERE f_clr IS NULL) + count(*) FILTER (WHERE d_clr IS NULL) AS null_values, {r6('avg(CAST(t_ttc <= 2 AS INT))', 'prevalence_tau_2s')},
  {r6('avg(CAST(t_ttc <= 3 AS INT))', 'prevalence_tau_3s')}, {r6('avg(CAST(t_ttc <= 5 AS INT))', 'prevalence_tau_5s')} FROM labels_t l
SEMI JOIN (SELECT * FROM splits WHERE split = 'internal_holdout') s ON l.scenario_id = s.scenario_id""", "labels_t", "splits")
SQL["profile_summary"] = query(f"""
SELECT count(*) AS n_scenarios, {r6('avg(criticality_peak)', 'mean_criticality_peak')}, {r6('avg(criticality_auc_s)', 'mean_criticality_auc_s')}, {r6('avg(tet_3s_s)', 'mean_tet_3s_s')},
  count(*) FILTER (WHERE episode_count_3s > 0) AS scenarios_with_critical_episode_3s, {r6('avg(CAST(episode_count_3s > 0 AS INT))', 'critical_episode_scenario_rate')},
  {r6('avg(dominant_actor_turnover_rate)', 'mean_dominant_actor_turnover_rate')} FROM profile""", "profile")

add_cte("sig_rows", ["agent_state"], """
SELECT *, coalesce(sqrt(pow(center_x - lag(center_x) OVER w, 2) + pow(center_y - lag(center_y) OVER w, 2)), 0.0) AS step,
  first_value(center_x) OVER w AS x0, first_value(center_y) OVER w AS y0 FROM agent_state WHERE is_sdc AND valid
WINDOW w AS (PARTITION BY scenario_id ORDER BY time_index)""")
# Copies of every fourth scenario, moved sideways: the audit must find them, and nothing else but what the data repeat.
add_cte("planted", ["agent_state"], """
SELECT * FROM agent_state UNION ALL SELECT * REPLACE (scenario_id || 'c' AS scenario_id, center_x + 1024 AS center_x) FROM agent_state WHERE CAST(scenario_id AS INT) % 4 = 0""")
add_cte("planted_rows", ["planted"], """
SELECT *, coalesce(sqrt(pow(center_x - lag(center_x) OVER w, 2) + pow(center_y - lag(center_y) OVER w, 2)), 0.0) AS step,
  first_value(center_x) OVER w AS x0, first_value(center_y) OVER w AS y0 FROM planted WHERE is_sdc AND valid
WINDOW w AS (PARTITION BY scenario_id ORDER BY time_index)""")
_sig = lambda q: f"""
SELECT scenario_id, count(*) AS n_frames,
  sha256(string_agg(CAST(CAST(round_even((center_x - x0) / {q}, 0) AS BIGINT) AS STRING) || ',' || CAST(CAST(round_even((center_y - y0) / {q}, 0) AS BIGINT) AS STRING), ';' ORDER BY time_index)) AS signature_hash,
  sum(step) AS dist, avg(sqrt(velocity_x * velocity_x + velocity_y * velocity_y)) AS spd, arg_min(heading, time_index) AS h0, arg_max(heading, time_index) AS h1
FROM sig_rows GROUP BY 1 HAVING count(*) >= 10"""
add_cte("sigs", ["sig_rows"], _sig("0.5"))
add_cte("sigs_planted", ["planted_rows"], _sig("0.5").replace("FROM sig_rows", "FROM planted_rows"))
add_cte("splits_planted", ["planted"], f"SELECT scenario_id, {SPLIT.format(u='u')} AS split FROM (SELECT scenario_id, {_u} AS u FROM (SELECT DISTINCT scenario_id FROM planted))")
SQL["trajectory_signature"] = query(f"""
SELECT g.scenario_id, n_frames, signature_hash, {r6('dist', 'total_distance_m', 5)}, {r6('spd', 'avg_speed_mps', 5)}, {r6('h0', 'start_heading', 5)}, {r6('h1', 'end_heading', 5)}, split
FROM sigs g JOIN splits s ON g.scenario_id = s.scenario_id""", "sigs", "splits")
SQL["near_duplicate_audit"] = query("""
SELECT CAST(sum(n) AS BIGINT) AS total_scenarios_audited, count(*) AS unique_trajectory_signatures, count(*) FILTER (WHERE n > 1) AS duplicate_cluster_count,
  count(*) FILTER (WHERE n > 1 AND k > 1) AS cross_split_leakage_cluster_count, CAST(coalesce(sum(CASE WHEN n > 1 AND k > 1 THEN n END), 0) AS BIGINT) AS cross_split_scenarios_count,
  CASE WHEN count(*) FILTER (WHERE n > 1 AND k > 1) = 0 THEN 'PASS' ELSE 'RESOLVED_BY_GROUPING' END AS verdict
FROM (SELECT signature_hash, count(*) AS n, count(DISTINCT split) AS k FROM sigs_planted g JOIN splits_planted s ON g.scenario_id = s.scenario_id GROUP BY 1)""", "sigs_planted", "splits_planted")

add_cte("kpi", ["ids", "kin", "circles", "agent_state", "map_feature"], """
SELECT i.scenario_id, max_jerk, drac_max, rss_margin_min, round(cte, 4) AS cross_track_error_max, round(ttlc, 4) AS ttlc_min, round(off, 4) AS offroad_ratio FROM ids i
LEFT JOIN (SELECT scenario_id, max(abs(jerk)) AS max_jerk FROM kin WHERE is_sdc GROUP BY 1) j ON i.scenario_id = j.scenario_id
LEFT JOIN (SELECT scenario_id, coalesce(max(CASE WHEN closing > 0 AND dist > 0.1 THEN closing * closing / (2 * dist) END), 0.0) AS drac_max FROM circles GROUP BY 1) d ON i.scenario_id = d.scenario_id
LEFT JOIN (SELECT c.scenario_id, min(dist - (speed * 0.5 + speed * speed / 8.0)) AS rss_margin_min FROM circles c JOIN kin k ON c.scenario_id = k.scenario_id AND c.time_index = k.time_index AND k.is_sdc
           WHERE speed IS NOT NULL GROUP BY 1) r ON i.scenario_id = r.scenario_id
LEFT JOIN (SELECT scenario_id, max(d) AS cte FROM (SELECT e.scenario_id, e.time_index, min(sqrt(pow(x - e.center_x, 2) + pow(y - e.center_y, 2))) AS d FROM agent_state e JOIN map_feature m
           ON e.scenario_id = m.scenario_id AND feature_type = 'lane' WHERE is_sdc AND valid AND x IS NOT NULL GROUP BY ALL) GROUP BY 1) c ON i.scenario_id = c.scenario_id
LEFT JOIN (SELECT scenario_id, avg(CASE WHEN d > 2 THEN 1.0 ELSE 0.0 END) AS off FROM (SELECT e.scenario_id, e.time_index, min(sqrt(pow(x - e.center_x, 2) + pow(y - e.center_y, 2))) AS d FROM agent_state e JOIN map_feature m
           ON e.scenario_id = m.scenario_id AND feature_type = 'road_edge' WHERE is_sdc AND valid AND x IS NOT NULL GROUP BY ALL) GROUP BY 1) o ON i.scenario_id = o.scenario_id
LEFT JOIN (SELECT scenario_id, min(1.85 / abs(-velocity_x * sin(heading) + velocity_y * cos(heading))) AS ttlc FROM agent_state
           WHERE is_sdc AND valid AND abs(-velocity_x * sin(heading) + velocity_y * cos(heading)) > 0.1 GROUP BY 1) t ON i.scenario_id = t.scenario_id""")
_K = ["max_jerk", "drac_max", "rss_margin_min", "cross_track_error_max", "ttlc_min", "offroad_ratio"]
SQL["kpis"] = query(f"SELECT scenario_id, {', '.join(r6(k, k, 4) for k in _K)} FROM kpi", "kpi")
SQL["kpi_coverage"] = query(f"""
SELECT k AS kpi, n AS n_total, v AS n_valid, round(v / n, 4) AS coverage, round((n - v) / n, 4) AS missing_rate FROM (
SELECT n, unnest({_K!r}) AS k, unnest([{', '.join('c_' + k for k in _K)}]) AS v FROM (SELECT count(*) AS n, {', '.join(f'count({k}) AS c_{k}' for k in _K)} FROM kpi))""", "kpi")
_p95 = lambda e, n: r6(f"coalesce(quantile_cont({e}, 0.95), 0.0)", n, 5)
SQL["response_kpis"] = query(f"""
SELECT f.scenario_id, {_p95('greatest(0.0, -accel)', 'kpi__sdc_hard_decel_p95')}, {r6('coalesce(min(accel), 0.0)', 'kpi__sdc_min_longitudinal_accel', 5)},
  {_p95('abs(jerk)', 'kpi__sdc_abs_jerk_p95')}, {_p95('abs(yaw)', 'kpi__sdc_abs_yaw_rate_p95')}, {_p95('abs(speed * yaw)', 'kpi__sdc_lateral_accel_p95')}, {r6('max(rad)', 'kpi__radial_closing_decel_proxy_max', 5)}
FROM (SELECT scenario_id, coalesce(max(CASE WHEN exposed AND d_cl > 0 THEN d_cl * d_cl / (2 * greatest(0.5, d_clr)) END), 0.0) AS rad FROM frames GROUP BY 1) f
LEFT JOIN (SELECT * FROM kin WHERE is_sdc) k ON f.scenario_id = k.scenario_id GROUP BY f.scenario_id""", "frames", "kin")
SQL["response_kpis"] = SQL["response_kpis"].replace("quantile_cont(greatest(0.0, -accel), 0.95)", "quantile_cont(CASE WHEN accel IS NOT NULL THEN greatest(0.0, -accel) END, 0.95)")

add_cte("cont", ["kin", "agent_state", "map_feature", "ids"], """
SELECT i.scenario_id, max_jump_m, max_velocity_rel_error, max_accel_rel_error, max_heading_jump_rad, box_range_m, max_cte_change_m, n_tracks, n_fragmented,
  round(coalesce(n_fragmented / n_tracks, 0.0), 4) AS fragmentation_ratio FROM ids i LEFT JOIN (
SELECT scenario_id, round(coalesce(max(jump), 0.0), 4) AS max_jump_m, round(coalesce(max(v_err), 0.0), 4) AS max_velocity_rel_error, round(coalesce(max(a_err), 0.0), 4) AS max_accel_rel_error,
  round(coalesce(max(abs(turn)), 0.0), 4) AS max_heading_jump_rad, round(greatest(coalesce(max(length) - min(length), 0.0), coalesce(max(width) - min(width), 0.0)), 4) AS box_range_m,
  round(coalesce(max(dcte), 0.0), 4) AS max_cte_change_m FROM (
  SELECT scenario_id, length, width, sqrt(sx * sx + sy * sy) AS jump, (dh2 + pi()) - 2 * pi() * floor((dh2 + pi()) / (2 * pi())) - pi() AS turn, dcte,
    CASE WHEN sp > 0.5 THEN abs(fd - sp) / greatest(sp, 1.0) END AS v_err,
    abs((fd - lag(fd) OVER (PARTITION BY scenario_id ORDER BY time_index)) / dt2 - accel) / greatest(abs(accel), 0.5) AS a_err
    FROM (SELECT *, sqrt(pow(sx / dt2, 2) + pow(sy / dt2, 2)) AS fd FROM (
    SELECT k.scenario_id, k.time_index, length, width, accel, sqrt(velocity_x * velocity_x + velocity_y * velocity_y) AS sp, center_x - lag(center_x) OVER w AS sx, center_y - lag(center_y) OVER w AS sy,
      greatest(timestamp_seconds - lag(timestamp_seconds) OVER w, 1e-12) AS dt2, heading - lag(heading) OVER w AS dh2, abs(cte - lag(cte) OVER w) AS dcte
    FROM kin k LEFT JOIN (SELECT e.scenario_id, e.time_index, min(sqrt(pow(x - e.center_x, 2) + pow(y - e.center_y, 2))) AS cte FROM agent_state e JOIN map_feature m
      ON e.scenario_id = m.scenario_id AND feature_type = 'lane' WHERE is_sdc AND valid AND x IS NOT NULL GROUP BY ALL) c ON k.scenario_id = c.scenario_id AND k.time_index = c.time_index
    WHERE k.is_sdc WINDOW w AS (PARTITION BY k.scenario_id ORDER BY k.time_index)))) GROUP BY 1) a ON i.scenario_id = a.scenario_id
LEFT JOIN (SELECT scenario_id, count(*) AS n_tracks, count(*) FILTER (WHERE g > 5) AS n_fragmented FROM (SELECT scenario_id, track_id, max(gap) AS g FROM (
  SELECT scenario_id, track_id, time_index - lag(time_index) OVER (PARTITION BY scenario_id, track_id ORDER BY time_index) AS gap FROM agent_state WHERE valid) GROUP BY ALL) GROUP BY 1) t ON i.scenario_id = t.scenario_id""")
_OK = {"position_ok": ("max_jump_m", 2.0), "velocity_ok": ("max_velocity_rel_error", 0.10), "acceleration_ok": ("max_accel_rel_error", 0.20), "heading_ok": ("max_heading_jump_rad", 0.5),
       "box_ok": ("box_range_m", 0.01), "map_ok": ("max_cte_change_m", 1.0), "topology_ok": ("fragmentation_ratio", 0.2)}
#: On the scattered and the steady scenarios; oracles.learning adds the tables.
CONTINUITY = {"motion_continuity": f"""
SELECT scenario_id, n_tracks, n_fragmented, {', '.join(r6(c, c, 3) for c in ('max_jump_m', 'max_velocity_rel_error', 'max_accel_rel_error', 'max_heading_jump_rad', 'box_range_m', 'max_cte_change_m', 'fragmentation_ratio'))},
  {', '.join(f'coalesce({c} < {t}, TRUE) AS {n}' for n, (c, t) in _OK.items())} FROM cont""", "continuity_pass_rates": f"""
SELECT k AS check_name, v AS n_passed, n, round(v / n, 4) AS pass_rate FROM (SELECT n, unnest({list(_OK)!r}) AS k, unnest([{', '.join('c_' + k for k in _OK)}]) AS v FROM (
SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE coalesce({c} < {t}, TRUE)) AS c_{k}' for k, (c, t) in _OK.items())} FROM cont))"""}

SQL["write_read_table"] = query(f"""SELECT object_type, count(*) AS n_rows, count(DISTINCT scenario_id) AS n_scenarios, count(*) FILTER (WHERE valid) AS n_valid, {r6('avg(center_x)', 'mean_x', 5)}
FROM agent_state GROUP BY 1""", "agent_state")
SQL["read_scenario_slice"] = query(f"""SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, CAST(track_id AS BIGINT) AS track_id, {r6('center_x')}, valid
FROM agent_state WHERE scenario_id IN ('2', '7')""", "agent_state")
SQL["scenario_ids"] = query("SELECT DISTINCT scenario_id FROM agent_state", "agent_state")
SQL["incremental_pairs"] = query("""SELECT status AS kind, count(*) AS n_frames, count(DISTINCT s.scenario_id) AS n_scenarios FROM (
SELECT s.scenario_id, CASE WHEN NOT any_valid THEN 'invalid_frame' WHEN NOT ego_ok THEN 'invalid_ego_state' WHEN n_near IS NULL THEN 'no_exposure'
  WHEN n_over + n_future > 0 THEN 'contact' ELSE 'right_censored' END AS status
FROM spine s LEFT JOIN (SELECT scenario_id, time_index, count(*) AS n_near, count(*) FILTER (WHERE pair_valid AND overlap_now) AS n_over,
  count(*) FILTER (WHERE pair_valid AND hit AND NOT overlap_now AND ttc > 1e-9) AS n_future FROM pairs_raw GROUP BY ALL) p
  ON s.scenario_id = p.scenario_id AND s.time_index = p.time_index) s GROUP BY 1""", "spine", "pairs_raw")
SQL["recomputed_outputs"] = query("""SELECT s.scenario_id, CAST(s.time_index AS BIGINT) AS time_index, status AS kind,
  CASE WHEN status IN ('contact', 'right_censored') THEN n_valid ELSE 0 END AS n_eligible_pairs, coalesce(n_near, 0) AS n_pairs FROM (
SELECT s.scenario_id, s.time_index, n_near, n_valid, CASE WHEN NOT any_valid THEN 'invalid_frame' WHEN NOT ego_ok THEN 'invalid_ego_state' WHEN n_near IS NULL THEN 'no_exposure'
  WHEN n_over + n_future > 0 THEN 'contact' ELSE 'right_censored' END AS status
FROM spine s LEFT JOIN (SELECT scenario_id, time_index, count(*) AS n_near, count(*) FILTER (WHERE pair_valid) AS n_valid, count(*) FILTER (WHERE pair_valid AND overlap_now) AS n_over,
  count(*) FILTER (WHERE pair_valid AND hit AND NOT overlap_now AND ttc > 1e-9) AS n_future FROM pairs_raw GROUP BY ALL) p
  ON s.scenario_id = p.scenario_id AND s.time_index = p.time_index) s""", "spine", "pairs_raw")
SQL["read_scenarios"] = SQL["flatten_scenario"].replace(" AS duration_seconds", " AS duration_seconds, 'a' AS split")
