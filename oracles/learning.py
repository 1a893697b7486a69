"""SQL twins of nearmiss.plans.learning."""
from nearmiss.constants import C_ODD, MODEL_FEATURES, Z_STATE
from nearmiss.operators.landmark import CONTEXT_13, ENV_HIST_7, ENV_INST_13, PHYSICS_16, PHYSICS_21
from oracles import analysis as AN, statistics as ST  # noqa: F401  (define the CTEs used here)
from oracles.base import RAW, _TYPES, _pairs, add_cte, query, r6
from oracles.context import KEY
from oracles.core import SQL as CORE
from oracles.tables import CONTINUITY, SPLIT, _hex, _m

SQL = {}
add_cte("fctx", ["agent_state"], """
SELECT scenario_id, time_index, count(*) FILTER (WHERE valid) AS n_valid_agents, count(*) FILTER (WHERE valid AND object_type = 'TYPE_VEHICLE') AS n_vehicles,
  count(*) FILTER (WHERE valid AND object_type = 'TYPE_PEDESTRIAN') AS n_pedestrians, count(*) FILTER (WHERE valid AND object_type = 'TYPE_CYCLIST') AS n_cyclists FROM agent_state GROUP BY ALL""")
SQL["frame_context"] = query(f"SELECT * REPLACE (CAST(time_index AS BIGINT) AS time_index) FROM fctx", "fctx")
_MAPC = {"odd_n_lanes": "lane", "odd_n_road_lines": "road_line", "odd_n_road_edges": "road_edge", "odd_n_crosswalks": "crosswalk", "odd_n_stop_signs": "stop_sign", "odd_n_speed_bumps": "speed_bump", "odd_n_driveways": "driveway"}
add_cte("mapc", ["map_feature"], "SELECT scenario_id, count(DISTINCT feature_id) AS odd_n_map_features, " + ", ".join(
    f"count(DISTINCT feature_id) FILTER (WHERE feature_type = '{t}') AS {n}" for n, t in _MAPC.items()) + " FROM map_feature GROUP BY 1")
SQL["map_feature_counts"] = query("SELECT * FROM mapc", "mapc")
add_cte("sigr", ["dynamic_signal"], """
SELECT scenario_id, time_index, CAST(1 AS BIGINT) AS odd_has_signal, count(*) AS odd_n_active_signals,
  avg(CASE WHEN signal_state IN ('LANE_STATE_GO', 'LANE_STATE_ARROW_GO') THEN 1.0 ELSE 0.0 END) AS odd_signal_go_ratio,
  avg(CASE WHEN signal_state IN ('LANE_STATE_STOP', 'LANE_STATE_ARROW_STOP', 'LANE_STATE_FLASHING_STOP') THEN 1.0 ELSE 0.0 END) AS odd_signal_stop_ratio FROM dynamic_signal GROUP BY ALL""")
SQL["signal_ratios"] = query(f"SELECT {KEY}, odd_has_signal, odd_n_active_signals, {r6('odd_signal_go_ratio')}, {r6('odd_signal_stop_ratio')} FROM sigr", "sigr")
SQL["ego_state_features"] = query(f"SELECT {KEY}, {r6('speed', 'ego_speed_mps')}, {r6('speed / 13.4', 'ego_speed_ratio')} FROM kin WHERE is_sdc", "kin")
SQL["scaler_stats"] = query(" UNION ALL ".join(f"""
SELECT '{f}' AS feature, {r6(f'avg({f})', 'mean')}, {r6(f'stddev_samp({f})', 'std')}, {r6(f'min({f})', 'min')}, {r6(f'max({f})', 'max')}, count({f}) AS n_non_null, count(*) AS n_total FROM ws WHERE split = 'train'"""
    for f in ("p_base", "p_full", "gap_m", "n_lines")), "ws")

add_cte("mt", ["targets_log", "fctx", "mapc", "sigr", "kin"], f"""
SELECT t.*, CASE WHEN m < 7000 THEN 'train' WHEN m < 8500 THEN 'internal_val' ELSE 'internal_holdout' END AS split FROM (
SELECT t.scenario_id, t.time_index, t.ts, t.y_log_ttc, t.ttc_censored, t.exposure_flag, t.target_status, {', '.join('m.' + c for c in C_ODD[:8])}, n_valid_agents AS odd_n_valid_agents, n_vehicles AS odd_n_vehicles,
  n_pedestrians AS odd_n_pedestrians, n_cyclists AS odd_n_cyclists, coalesce(odd_has_signal, 0) AS odd_has_signal, coalesce(odd_n_active_signals, 0) AS odd_n_active_signals,
  coalesce(odd_signal_go_ratio, 0) AS odd_signal_go_ratio, coalesce(odd_signal_stop_ratio, 0) AS odd_signal_stop_ratio, k.speed AS ego_speed_mps, k.speed / 13.4 AS ego_speed_ratio, {_m.replace('scenario_id', 't.scenario_id')} AS m
FROM targets_log t LEFT JOIN fctx f ON t.scenario_id = f.scenario_id AND t.time_index = f.time_index LEFT JOIN mapc m ON t.scenario_id = m.scenario_id
LEFT JOIN sigr s ON t.scenario_id = s.scenario_id AND t.time_index = s.time_index LEFT JOIN kin k ON k.is_sdc AND t.scenario_id = k.scenario_id AND t.time_index = k.time_index) t""")
_z = lambda f: r6(f"({f} - (SELECT avg({f}) FROM mt WHERE split = 'train')) / (SELECT CASE WHEN stddev_samp({f}) < 1e-12 THEN 1.0 ELSE stddev_samp({f}) END FROM mt WHERE split = 'train')", f + "_z")
_ints = C_ODD[:14]
SQL["model_table"] = query(f"""
SELECT {KEY}, {r6('ts', 'timestamp_seconds')}, split, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _ints)}, {', '.join(r6(c) for c in C_ODD[14:] + Z_STATE)}, {', '.join(_z(f) for f in MODEL_FEATURES)},
  {r6('y_log_ttc')}, ttc_censored, CAST(exposure_flag AS BIGINT) AS exposure_flag, target_status FROM mt""", "mt")
SQL["hurdle_unconditional"] = query(f"""
SELECT 'M0' AS model, split, {r6('avg(pow(g - exposure_flag, 2))', 'gate_brier')},
  {r6("avg(CASE WHEN exposure_flag = 1 THEN CASE WHEN target_status = 'event' THEN ln(s) + 0.5 * ln(2 * pi()) + pow((y_log_ttc - u) / s, 2) / 2 ELSE -ln(1 - p) END END)", 'censored_nll')}, count(*) AS n_frames
FROM (SELECT *, {AN.phi('((y_log_ttc - u) / s)')} AS p FROM mt, (SELECT avg(exposure_flag) AS g, avg(y_log_ttc) FILTER (WHERE target_status = 'event') AS u,
  stddev_samp(y_log_ttc) FILTER (WHERE target_status = 'event') AS s FROM mt WHERE split = 'train')) WHERE split <> 'internal_holdout' GROUP BY split""", "mt")

add_cte("ft", ["spine", "pairs_raw"], "SELECT" + CORE["frame_targets"].rsplit("\n\nSELECT", 1)[1])
add_cte("r2", ["ft", "kin", "pairs", "fctx"], """
SELECT f.scenario_id, f.time_index, target_status, ttc_obb_swept_s, right_censored, overlap_now_flag, ttc_method, censor_time_s, speed AS ego_speed_mps, accel AS ego_accel_mps2, yaw AS ego_yaw_rate_rps, n_eligible_pairs,
  min_pair_distance_m, max_closing_speed_mps, n_valid_agents AS traffic_n_valid_agents FROM ft f LEFT JOIN kin k ON k.is_sdc AND f.scenario_id = k.scenario_id AND f.time_index = k.time_index
LEFT JOIN (SELECT scenario_id, time_index, min(dist) AS min_pair_distance_m, max(closing) AS max_closing_speed_mps FROM pairs GROUP BY ALL) p ON f.scenario_id = p.scenario_id AND f.time_index = p.time_index
LEFT JOIN fctx c ON f.scenario_id = c.scenario_id AND f.time_index = c.time_index""")
SQL["r2_features"] = query(f"""
SELECT {KEY}, target_status, ttc_obb_swept_s, right_censored, overlap_now_flag, ttc_method, censor_time_s, {', '.join(r6(c) for c in ('ego_speed_mps', 'ego_accel_mps2', 'ego_yaw_rate_rps', 'min_pair_distance_m', 'max_closing_speed_mps'))},
  n_eligible_pairs, traffic_n_valid_agents FROM r2""", "r2")
add_cte("cb", ["r2"], f"""
SELECT tau, (p - y) * (p - y) AS b, y, p, right_censored, censor_time_s FROM (SELECT *, CASE WHEN NOT right_censored AND ttc_obb_swept_s <= tau THEN 1.0 ELSE 0.0 END AS y, {AN.phi('(ln(tau) - (1.5 + min_pair_distance_m * 0.02))')} AS p
FROM r2, (SELECT unnest([2.0, 3.0, 5.0])::DOUBLE AS tau) WHERE target_status IN ('future_contact_event', 'right_censored'))""")
SQL["conditional_brier"] = query(f"""
SELECT tau, {r6('CASE WHEN min(censor_time_s) >= tau THEN avg(b) END', 'brier_score')}, count(*) AS n_samples, CAST(sum(y) AS BIGINT) AS n_events_at_tau, count(*) FILTER (WHERE right_censored) AS n_censored, {r6('avg(p)', 'mean_pred')},
  CASE WHEN min(censor_time_s) >= tau THEN 'naive_binary' ELSE 'IPCW_REQUIRED' END AS brier_method FROM cb GROUP BY tau""", "cb")

add_cte("prosp", ["frames"], """
SELECT *, coalesce(ttc, 10.0) > 3 AS calm FROM (SELECT *, min(ttc) OVER (PARTITION BY scenario_id ORDER BY time_index ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS t1,
  min(ttc) OVER (PARTITION BY scenario_id ORDER BY time_index ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS t2,
  coalesce(max(sev) OVER (PARTITION BY scenario_id ORDER BY time_index ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), 0.0) AS pk FROM frames) WHERE time_index = 10 AND status NOT IN ('invalid_frame', 'invalid_ego_state')""")
_PRO = f"""CAST(calm AND coalesce(t2 <= 3, FALSE) AS BIGINT) AS y_onset_3s_h2s, CAST(calm AND coalesce(t1 <= 3, FALSE) AS BIGINT) AS y_onset_3s_h1s"""
SQL["prospective_outcome"] = query(f"SELECT {KEY}, status AS current_status, {_PRO}, {r6('pk', 'future_peak_c_h2s')}, {r6('pk - coalesce(sev, 0.0)', 'delta_future_peak_c_h2s')} FROM prosp", "prosp")

add_cte("smooth", ["smooth_track"], """
SELECT scenario_id, time_index, track_id, time_index / 10.0 AS timestamp_seconds, track_id = 1 AS is_sdc, CASE WHEN track_id <= 4 THEN 'TYPE_VEHICLE' WHEN track_id = 5 THEN 'TYPE_PEDESTRIAN'
  WHEN track_id = 6 THEN 'TYPE_CYCLIST' ELSE 'TYPE_OTHER' END AS object_type, TRUE AS valid, v * time_index / 10.0 + (track_id - 1) * 2.0 AS center_x,
  (track_id - 1) * 2.5 + bend * sin(time_index / 15.0) AS center_y, v AS velocity_x, CAST(0 AS DOUBLE) AS velocity_y, CAST(0 AS DOUBLE) AS heading,
  CASE WHEN track_id <= 4 THEN CAST(4.5 AS DOUBLE) ELSE CAST(1.8 AS DOUBLE) END AS length, CASE WHEN track_id <= 4 THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS width
FROM (SELECT *, CAST(u AS INT) AS time_index FROM smooth_track, range(91) r(u)) WHERE time_index < n_frames AND time_index <> missing""")
# Scattered and steady scenarios together.
_MIXED = {"agent_state": (["smooth"], f"""
SELECT * FROM ({RAW['agent_state']}) UNION ALL BY NAME SELECT * REPLACE ('s' || scenario_id AS scenario_id), FALSE AS is_object_of_interest, CAST(0 AS DOUBLE) AS center_z, CAST(1.5 AS DOUBLE) AS height FROM smooth""")}
add_cte("far_pairs", ["full_state"], _pairs(True, _TYPES).replace("WHERE dist <= 70.0", "WHERE e_idx BETWEEN 10 AND 30").replace("SELECT e.scenario_id, e.time_index, e.track_id AS ego_id", "SELECT e.scenario_id, e.time_index, e.time_index AS e_idx, e.track_id AS ego_id"))
add_cte("follow", ["far_pairs", "full_state"], """
SELECT l.*, ev.f AS ev_f, ev.ttc AS ev_ttc, ev.o AS ev_o, lost, CASE WHEN l.dist > 70 THEN 'OUT_OF_RADIUS' WHEN l.overlap_now THEN 'INDEX_OVERLAP' WHEN l.ttc <= 3 THEN 'INDEX_ALREADY_CRITICAL' END AS reason
FROM (SELECT * FROM far_pairs WHERE time_index = 10) l
LEFT JOIN (SELECT scenario_id, target_id, min(time_index) AS f, arg_min(ttc, time_index) AS ttc, arg_min(overlap_now, time_index) AS o FROM far_pairs WHERE time_index > 10 AND (overlap_now OR ttc <= 3) GROUP BY ALL) ev
  ON l.scenario_id = ev.scenario_id AND l.target_id = ev.target_id
LEFT JOIN (SELECT a.scenario_id, a.target_id, min(u) AS lost FROM (SELECT scenario_id, target_id FROM far_pairs WHERE time_index = 10) a CROSS JOIN range(11, 31) r(u)
           WHERE NOT EXISTS (SELECT 1 FROM far_pairs q WHERE q.scenario_id = a.scenario_id AND q.target_id = a.target_id AND q.time_index = u) GROUP BY ALL) g
  ON l.scenario_id = g.scenario_id AND l.target_id = g.target_id""")
add_cte("followed", ["follow"], """
SELECT *, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN ev_f IS NOT NULL AND (lost IS NULL OR ev_f < lost) THEN 'positive' WHEN lost IS NOT NULL THEN 'incomplete' ELSE 'negative' END AS label FROM follow""")
_MIXED_MAP = {"map_feature": ([], f"SELECT * FROM ({RAW['map_feature']}) UNION ALL SELECT * REPLACE ('s' || scenario_id AS scenario_id) FROM ({RAW['map_feature']})")}
SQL |= {n: query(q, "cont", swap={**_MIXED, **_MIXED_MAP}) for n, q in CONTINUITY.items()}
SQL["followup_labels"] = query(f"""
SELECT f.scenario_id, CAST(target_id AS BIGINT) AS target_track_id, target_type, {r6('dist', 'index_distance_m')}, {r6('clearance', 'index_clearance_m')}, {r6('ttc', 'index_ttc_s')}, {r6('closing', 'index_closing_speed_mps')}, reason IS NULL AS is_eligible,
  reason AS exclusion_reason, label, CAST(CASE WHEN label = 'positive' THEN ev_f END AS BIGINT) AS event_time_index, {r6("CASE WHEN label = 'positive' THEN ev_ttc END", 'event_ttc_s')},
  CASE WHEN label = 'positive' THEN CASE WHEN ev_o THEN 'OVERLAP' ELSE 'TTC_LE_3S' END END AS event_type, CASE WHEN label = 'incomplete' THEN lost END AS incomplete_time_index,
  CASE WHEN label = 'incomplete' THEN CASE WHEN EXISTS (SELECT 1 FROM full_state s WHERE s.is_sdc AND s.scenario_id = f.scenario_id AND s.time_index = lost) THEN 'TARGET_LOST' ELSE 'EGO_LOST' END END AS incomplete_reason FROM followed f""", "followed", "full_state", swap=_MIXED)
SQL["eligible_landmarks"] = query("""SELECT target_type, label, count(*) AS n, CAST(sum(CASE WHEN label = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM followed WHERE label IN ('positive', 'negative') GROUP BY ALL""", "followed", swap=_MIXED)
SQL["anchor_vs_open_set"] = query("""
SELECT a.scenario_id, CAST(target_id AS BIGINT) AS anchor_track_id, label AS anchor_label, CASE WHEN d_id IS NULL THEN 'negative' ELSE 'positive' END AS open_set_frame_min_label,
  label <> CASE WHEN d_id IS NULL THEN 'negative' ELSE 'positive' END AS anchor_vs_open_disagreement, CAST(d_id AS BIGINT) AS open_set_first_critical_track_id, coalesce(d_id <> target_id, FALSE) AS open_target_switch_or_new_entrant
FROM (SELECT * FROM followed WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY ttc, clearance, dist, target_id) = 1) a
LEFT JOIN (SELECT scenario_id, d_id FROM frames WHERE time_index BETWEEN 11 AND 30 AND ttc <= 3 QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY time_index) = 1) o ON a.scenario_id = o.scenario_id""", "followed", "frames", swap=_MIXED)

# Third parties by direct pairing of every landmark with every other actor.
add_cte("around", ["actors", "full_state"], "SELECT p.*, sqrt(t_vx * t_vx + t_vy * t_vy) AS spd FROM actors p WHERE time_index = 10")


def third(base: str, skip: str) -> str:
    return f"""
SELECT b.scenario_id, b.k, count(a.dist) AS n70, count(*) FILTER (WHERE a.dist <= 30) AS n30, count(*) FILTER (WHERE a.dist <= 50) AS n50, count(*) FILTER (WHERE a.target_type = 'TYPE_VEHICLE') AS veh,
  count(*) FILTER (WHERE a.target_type = 'TYPE_PEDESTRIAN') AS ped, count(*) FILTER (WHERE a.target_type = 'TYPE_CYCLIST') AS cyc, coalesce(min(a.dist), 70.0) AS nearest, coalesce(avg(spd), 0.0) AS ms, coalesce(stddev_pop(spd), 0.0) AS sd,
  CASE WHEN count(a.dist) > 0 THEN greatest(0.0, least(1.0, 1 - sqrt(pow(avg(cos(a.t_heading)), 2) + pow(avg(sin(a.t_heading)), 2)))) ELSE 0.0 END AS disp,
  coalesce(max(CASE WHEN a.dist > 1e-6 THEN greatest(0.0, a.closing) END), 0.0) AS pmax, coalesce(sum(CASE WHEN a.dist > 1e-6 THEN greatest(0.0, a.closing) / greatest(1.0, a.dist) END), 0.0) AS psum,
  count(*) FILTER (WHERE a.dist > 1e-6 AND a.closing > 0) AS ncl, CASE WHEN count(a.dist) = 0 THEN 1.0 ELSE 0.0 END AS empty
FROM {base} b LEFT JOIN around a ON a.scenario_id = b.scenario_id AND coalesce(a.target_id <> {skip}, TRUE) GROUP BY b.scenario_id, b.k"""


add_cte("lm3", ["followed", "around"], third("(SELECT scenario_id, target_id AS k FROM followed WHERE dist <= 70)", "b.k"))
_P21 = ["greatest(0.0, least(10.0, l.ttc))", "CAST(l.ttc < 10 AS INT)", "CAST(l.ttc >= 10 AS INT)", "l.dist", "l.closing", "l.dx * l.ec + l.dy * l.es", "-l.dx * l.es + l.dy * l.ec", "l.dvx * l.ec + l.dvy * l.es", "-l.dvx * l.es + l.dvy * l.ec",
        "sqrt(l.e_vx * l.e_vx + l.e_vy * l.e_vy)", "sqrt(l.t_vx * l.t_vx + l.t_vy * l.t_vy)", "sin(l.t_heading - l.e_heading)", "cos(l.t_heading - l.e_heading)", "coalesce(ke.accel, 0)", "CAST(ke.accel IS NOT NULL AS INT)", "coalesce(kt.accel, 0)",
        "CAST(kt.accel IS NOT NULL AS INT)", "l.e_len", "l.e_wid", "l.t_len", "l.t_wid"]
_C13 = ["n30", "n50", "n70", "veh", "ped", "cyc", "nearest", "ms", "sd", "disp", "pmax", "psum", "empty"]
SQL["landmark_pair_features"] = query(f"""
SELECT l.scenario_id, CAST(l.target_id AS BIGINT) AS target_track_id, {', '.join(r6(e, n, 5) for e, n in zip(_P21, PHYSICS_21))}, {', '.join(r6('x.' + e, n, 5) for e, n in zip(_C13, CONTEXT_13))}
FROM followed l JOIN lm3 x ON l.scenario_id = x.scenario_id AND l.target_id = x.k LEFT JOIN kin ke ON ke.scenario_id = l.scenario_id AND ke.time_index = 10 AND ke.track_id = l.ego_id
LEFT JOIN kin kt ON kt.scenario_id = l.scenario_id AND kt.time_index = 10 AND kt.track_id = l.target_id""", "followed", "lm3", "kin", swap=_MIXED)

add_cte("dom3", ["frames", "around"], third("(SELECT scenario_id, d_id AS k FROM frames WHERE time_index = 10)", "b.k"))
add_cte("hist36", ["frames", "agent_state"], """
SELECT f.scenario_id, avg(n) AS h_mean, stddev_pop(n) AS h_std, (max(CASE WHEN f.time_index = 10 THEN n END) - max(CASE WHEN f.time_index = 0 THEN n END)) / 1.1 AS h_slope, avg(coalesce(s, 0.0)) AS h_speed, sum(chg) AS h_turn
FROM (SELECT f.*, s, CASE WHEN f.time_index > 0 AND coalesce(ids, []) IS DISTINCT FROM coalesce(lag(ids) OVER (PARTITION BY f.scenario_id ORDER BY f.time_index), []) THEN 1 ELSE 0 END AS chg FROM frames f
  LEFT JOIN (SELECT scenario_id, time_index, list_sort(list(DISTINCT track_id)) AS ids, avg(sqrt(velocity_x * velocity_x + velocity_y * velocity_y)) FILTER (WHERE valid AND NOT is_sdc) AS s FROM agent_state GROUP BY ALL) i
  ON f.scenario_id = i.scenario_id AND f.time_index = i.time_index) f WHERE f.time_index <= 10 GROUP BY 1""")
_P16 = ["coalesce(f.sev, 0)", "coalesce(f.ttc, 10)", "coalesce(f.d_clr, 70)", "coalesce(f.d_dist, 70)", "coalesce(f.d_cl, 0)", "sqrt(e.velocity_x * e.velocity_x + e.velocity_y * e.velocity_y)", "coalesce(k.accel, 0)", "coalesce(k.yaw, 0)",
        "coalesce(a.dx * a.ec + a.dy * a.es, 0)", "coalesce(-a.dx * a.es + a.dy * a.ec, 0)", "coalesce(a.dvx * a.ec + a.dvy * a.es, 0)", "coalesce(-a.dvx * a.es + a.dvy * a.ec, 0)", "coalesce(a.spd, 0)",
        "CASE WHEN f.d_type = 'TYPE_VEHICLE' THEN 1 ELSE 0 END", "CASE WHEN f.d_type = 'TYPE_PEDESTRIAN' THEN 1 ELSE 0 END", "CASE WHEN f.d_type = 'TYPE_CYCLIST' THEN 1 ELSE 0 END"]
_I13 = ["x.n30", "x.n50", "f.n", "f.n_veh", "f.n_ped", "f.n_cyc", "x.ncl", "x.nearest", "x.ms", "x.sd", "x.disp", "x.pmax", "x.psum"]
_H7 = ["h_mean", "h_std", "h_slope", "x.psum", "x.pmax", "h_speed", "h_turn"]
SQL["landmark_features"] = query(f"""
SELECT f.scenario_id, CAST(f.time_index AS BIGINT) AS time_index, f.status AS current_status, {_PRO}, {r6('pk', 'future_peak_c_h2s', 5)}, {r6('pk - coalesce(f.sev, 0.0)', 'delta_future_peak_c_h2s', 5)},
  {', '.join(r6(e, n, 5) for e, n in zip(_P16 + _I13 + _H7, PHYSICS_16 + ENV_INST_13 + ENV_HIST_7))}
FROM prosp f JOIN full_state e ON e.is_sdc AND e.scenario_id = f.scenario_id AND e.time_index = 10 LEFT JOIN kin k ON k.is_sdc AND k.scenario_id = f.scenario_id AND k.time_index = 10
LEFT JOIN around a ON a.scenario_id = f.scenario_id AND a.target_id = f.d_id LEFT JOIN dom3 x ON x.scenario_id = f.scenario_id LEFT JOIN hist36 h ON h.scenario_id = f.scenario_id""", "prosp", "full_state", "kin", "around", "dom3", "hist36")

_u13 = lambda e: f"(CAST({_hex(e, 1, 13)} AS DOUBLE) / 4503599627370496.0)"
_h = lambda tag: _u13(f"md5('42{tag}|' || scenario_id || '|' || time_index)")
add_cte("strata_p", ["ws"], f"""
SELECT *, CAST(gap_m > (SELECT quantile_cont(gap_m, 0.25) FROM ws) AS BIGINT) + CAST(gap_m > (SELECT quantile_cont(gap_m, 0.5) FROM ws) AS BIGINT) + CAST(gap_m > (SELECT quantile_cont(gap_m, 0.75) FROM ws) AS BIGINT) AS band FROM ws""")
add_cte("placed", ["strata_p"], f"""
SELECT *, row_number() OVER (PARTITION BY split, band ORDER BY {_h('a')}, CAST(scenario_id AS STRING), CAST(time_index AS STRING)) AS a, row_number() OVER (PARTITION BY split, band ORDER BY {_h('b')}, CAST(scenario_id AS STRING), CAST(time_index AS STRING)) AS b FROM strata_p""")
SQL["permute_within_strata"] = query(f"""
SELECT x.scenario_id, CAST(x.time_index AS BIGINT) AS time_index, x.split, x.band, {r6('x.p_base', 'p_base')}, {r6('y.p_full', 'p_full')}, y.n_lines FROM placed x JOIN placed y ON x.split = y.split AND x.band = y.band AND x.a = y.b""", "placed")

_W = "OVER (PARTITION BY scenario_id, track_id ORDER BY time_index)"
_rate = lambda c, out: f"""CASE WHEN lag({c}) {_W} IS NULL THEN (lead({c}) {_W} - {c}) / 0.1 WHEN lead({c}) {_W} IS NULL THEN ({c} - lag({c}) {_W}) / 0.1
  ELSE (lead({c}) {_W} - lag({c}) {_W}) / 0.2 END AS {out}"""
add_cte("to_warp", ["smooth", "splits"], f"""
SELECT a.*, row_number() {_W} - 1 AS i FROM smooth a SEMI JOIN (SELECT * FROM splits WHERE warp) s ON a.scenario_id = s.scenario_id WHERE NOT is_sdc""")
add_cte("warp_kind", ["to_warp"], f"""
SELECT scenario_id, track_id, count(*) AS n, CASE WHEN count(*) < 10 THEN 'TRACK_TOO_SHORT' WHEN max(time_index) - min(time_index) + 1 > count(*) THEN 'NON_CONTIGUOUS_TIMESTEPS'
  WHEN sum(hop) < 2.0 THEN 'STATIONARY_OR_TOO_SHORT' END AS refused
FROM (SELECT *, sqrt(pow(center_x - lag(center_x) {_W}, 2) + pow(center_y - lag(center_y) {_W}, 2)) AS hop FROM to_warp) GROUP BY ALL""")
add_cte("warp_moved", ["to_warp", "warp_kind"], f"""
SELECT c.scenario_id, c.track_id, c.time_index, p.center_x + (spot - floor(spot)) * (q.center_x - p.center_x) AS mx, p.center_y + (spot - floor(spot)) * (q.center_y - p.center_y) AS my
FROM (SELECT a.*, n, least(greatest(i + 0.75 * pow(sin(pi() * i / (n - 1)), 2), 0), n - 1) AS spot FROM to_warp a JOIN warp_kind k ON a.scenario_id = k.scenario_id AND a.track_id = k.track_id AND refused IS NULL) c
JOIN to_warp p ON p.scenario_id = c.scenario_id AND p.track_id = c.track_id AND p.i = floor(spot) JOIN to_warp q ON q.scenario_id = c.scenario_id AND q.track_id = c.track_id AND q.i = least(floor(spot) + 1, n - 1)""")
add_cte("warp_motion", ["warp_moved"], f"""
SELECT *, coalesce(ahead, lag(ahead) {_W}) AS turned, sqrt(vx * vx + vy * vy) AS speed FROM (
SELECT *, {_rate('mx', 'vx')}, {_rate('my', 'vy')}, atan2(lead(my) {_W} - my, lead(mx) {_W} - mx) AS ahead, sqrt(pow(mx - lag(mx) {_W}, 2) + pow(my - lag(my) {_W}, 2)) AS step FROM warp_moved)""")
add_cte("warp_verdict", ["warp_motion", "warp_kind", "to_warp"], f"""
SELECT k.scenario_id, k.track_id, coalesce(refused, CASE WHEN broken = '' THEN 'OK' ELSE 'PHYSICAL_GATES_FAILED:' || broken END) AS reason FROM warp_kind k LEFT JOIN (
SELECT scenario_id, track_id, concat_ws(',', CASE WHEN max(step) >= 2.0 THEN 'POSITION' END, CASE WHEN max(abs(path - speed) / greatest(speed, 1.0)) > 0.10 THEN 'VELOCITY' END,
  CASE WHEN max(abs(acc)) > 8.0 THEN 'ACCELERATION' END, CASE WHEN max(abs(jerk)) > 15.0 THEN 'JERK' END, CASE WHEN max(abs(turn - 2 * pi() * round(turn / (2 * pi())))) >= 0.5 THEN 'HEADING' END,
  CASE WHEN max(off) >= 1.0 THEN 'CROSS_TRACK' END) AS broken
FROM (SELECT *, {_rate('acc', 'jerk')} FROM (SELECT *, {_rate('speed', 'acc')}, turned - lag(turned) {_W} AS turn, coalesce((step + lead(step) {_W}) / 2, step, lead(step) {_W}) / 0.1 AS path,
  (SELECT min(sqrt(pow(o.center_x - m.mx, 2) + pow(o.center_y - m.my, 2))) FROM to_warp o WHERE o.scenario_id = m.scenario_id AND o.track_id = m.track_id) AS off FROM warp_motion m)) GROUP BY ALL
) b ON k.scenario_id = b.scenario_id AND k.track_id = b.track_id""")
add_cte("warped", ["smooth", "warp_motion", "warp_verdict"], """
SELECT s.* REPLACE (coalesce(m.mx, center_x) AS center_x, coalesce(m.my, center_y) AS center_y, coalesce(m.vx, velocity_x) AS velocity_x, coalesce(m.vy, velocity_y) AS velocity_y, coalesce(m.turned, heading) AS heading), reason
FROM smooth s LEFT JOIN warp_verdict w ON s.scenario_id = w.scenario_id AND s.track_id = w.track_id
LEFT JOIN warp_motion m ON w.reason = 'OK' AND s.scenario_id = m.scenario_id AND s.track_id = m.track_id AND s.time_index = m.time_index""")
SQL["warp_tracks"] = query(f"""
SELECT reason, count(DISTINCT (scenario_id, track_id)) AS n_tracks, count(*) AS n_rows, {', '.join(r6(f'avg({c})', f'mean_{c}', 5) for c in ('center_x', 'center_y', 'velocity_x', 'velocity_y', 'heading'))}
FROM warped WHERE reason IS NOT NULL GROUP BY 1""", "warped")
for _name in ("smooth", "warped"):
    add_cte(f"full_{_name}", [_name], f"SELECT * FROM {_name}")
    add_cte(f"pairs_{_name}", [f"full_{_name}"], _pairs(True, _TYPES).replace("full_state", f"full_{_name}"))
_peak = lambda pairs: f"""(SELECT s.scenario_id, coalesce(max(sv), 0.0) AS pk FROM (SELECT DISTINCT scenario_id FROM smooth) s LEFT JOIN (
  SELECT scenario_id, time_index, CASE WHEN bool_or(overlap_now) THEN 1.0 ELSE 1 - min(ttc) / 10 END AS sv FROM {pairs} GROUP BY ALL) p ON s.scenario_id = p.scenario_id GROUP BY 1)"""
SQL["warp_response_accounting"] = query(f"""
SELECT count(*) FILTER (WHERE d > 1e-12) AS delta_peak_c_positive_count, count(*) FILTER (WHERE abs(d) <= 1e-12) AS delta_peak_c_zero_count, count(*) FILTER (WHERE d < -1e-12) AS delta_peak_c_negative_count,
  {r6('count(*) FILTER (WHERE d > 1e-12) / count(*)', 'true_increase_rate')}, {r6('count(*) FILTER (WHERE abs(d) <= 1e-12) / count(*)', 'unchanged_rate')}
FROM (SELECT b.pk - a.pk AS d FROM {_peak('pairs_smooth')} a JOIN {_peak('pairs_warped')} b ON a.scenario_id = b.scenario_id)""", "smooth", "pairs_smooth", "pairs_warped")
