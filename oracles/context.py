"""SQL twins of nearmiss.plans.context."""
from nearmiss.constants import E_DYNAMIC, E_HIST, E_STATIC, P_CLEAN
from oracles import core  # noqa: F401  (defines the CTEs used here)
from oracles.base import add_cte, query, r6

SQL = {}
KEY = "scenario_id, CAST(time_index AS BIGINT) AS time_index"

add_cte("kin", ["agent_state"], """
SELECT *, CASE WHEN step AND dt > 0 AND lag(accel) OVER w IS NOT NULL THEN (accel - lag(accel) OVER w) / dt END AS jerk FROM (
SELECT *, CASE WHEN step AND dt > 0 THEN dv / dt END AS accel,
  CASE WHEN step AND dt > 0 THEN (((dh + pi()) - 2 * pi() * floor((dh + pi()) / (2 * pi()))) - pi()) / dt END AS yaw FROM (
SELECT *, ok AND coalesce(lag(ok) OVER w, FALSE) AS step, timestamp_seconds - lag(timestamp_seconds) OVER w AS dt,
  speed - lag(speed) OVER w AS dv, heading - lag(heading) OVER w AS dh FROM (
SELECT *, valid AND velocity_x IS NOT NULL AND velocity_y IS NOT NULL AS ok,
  CASE WHEN valid THEN sqrt(velocity_x * velocity_x + velocity_y * velocity_y) END AS speed FROM agent_state) a
WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY time_index)) b) c
WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY time_index)""")

SQL["kinematics"] = query(f"""
SELECT {KEY}, CAST(track_id AS BIGINT) AS track_id, {r6('speed', 'derived_speed_mps')}, {r6('accel', 'derived_accel_mps2')},
  {r6('yaw', 'derived_yaw_rate_rps')}, {r6('jerk', 'derived_jerk_mps3')},
  speed IS NOT NULL AND accel IS NOT NULL AND yaw IS NOT NULL AND jerk IS NOT NULL AS derived_kinematic_valid FROM kin""", "kin")

add_cte("path_t", ["agent_state"], """
SELECT *, sum(step) OVER (PARTITION BY scenario_id, track_id ORDER BY time_index) AS path FROM (
SELECT *, coalesce(sqrt(pow(center_x - lag(center_x) OVER w, 2) + pow(center_y - lag(center_y) OVER w, 2)), 0.0) AS step
FROM agent_state WHERE valid WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY time_index))""")
SQL["path_length"] = query(f"""SELECT {KEY}, CAST(track_id AS BIGINT) AS track_id, {r6('step', 'step_m', 5)}, {r6('path', 'path_m', 5)} FROM path_t""", "path_t")

add_cte("ego_pos", ["full_state"], "SELECT scenario_id, time_index, center_x AS x0, center_y AS y0 FROM full_state WHERE is_sdc")
add_cte("nearest", ["ego_pos", "map_feature"], """
SELECT e.scenario_id, e.time_index, feature_type, sqrt(min(pow(x - x0, 2) + pow(y - y0, 2))) AS d
FROM ego_pos e JOIN map_feature m ON e.scenario_id = m.scenario_id WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
SQL["nearest_map_point"] = query(f"SELECT {KEY}, feature_type, {r6('d', 'distance_m')} FROM nearest", "nearest")

add_cte("lanes", ["map_feature"], """
SELECT *, coalesce(ahead, lag(ahead) OVER (PARTITION BY scenario_id, feature_id ORDER BY point_index), 0.0) AS hd FROM (
SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS ahead FROM map_feature WHERE feature_type = 'lane' AND x IS NOT NULL
WINDOW w AS (PARTITION BY scenario_id, feature_id ORDER BY point_index))""")
SQL["lane_heading"] = query(f"""SELECT scenario_id, feature_id, CAST(point_index AS BIGINT) AS point_index, {r6('hd', 'lane_heading')} FROM lanes""", "lanes")
add_cte("lane_ctx", ["ego_pos", "lanes"], """
SELECT e.scenario_id, e.time_index, count(*) AS n,
  CASE WHEN count(*) > 2 THEN greatest(0.0, least(1.0, 1 - sqrt(pow(avg(cos(hd)), 2) + pow(avg(sin(hd)), 2)))) ELSE 0.0 END AS disp
FROM ego_pos e JOIN lanes l ON e.scenario_id = l.scenario_id AND (x - x0) * (x - x0) + (y - y0) * (y - y0) <= 2500.0 GROUP BY ALL""")
SQL["lane_points_in_radius"] = query(f"SELECT {KEY}, {r6('n', 'lane_points')}, {r6('disp', 'lane_dispersion')} FROM lane_ctx", "lane_ctx")
add_cte("signal_ctx", ["ego_pos", "dynamic_signal"], """
SELECT e.scenario_id, e.time_index, sqrt(min(pow(stop_point_x - x0, 2) + pow(stop_point_y - y0, 2))) AS d,
  count(*) FILTER (WHERE (signal_state LIKE '%STOP%' OR signal_state LIKE '%RED%')
    AND (stop_point_x - x0) * (stop_point_x - x0) + (stop_point_y - y0) * (stop_point_y - y0) <= 4900.0) AS n
FROM ego_pos e JOIN dynamic_signal s ON e.scenario_id = s.scenario_id AND e.time_index = s.time_index
WHERE stop_point_x IS NOT NULL AND stop_point_y IS NOT NULL GROUP BY ALL""")
SQL["signals_in_radius"] = query(f"SELECT {KEY}, {r6('d', 'signal_m')}, {r6('n', 'stop_signals')} FROM signal_ctx", "signal_ctx")

# Every usable actor at u in [t-10, t] against the ego of t; no grid, no salt.
add_cte("past", ["full_state", "frames"], """
SELECT e.scenario_id, e.time_index, a.time_index AS u, a.track_id, a.object_type, f.f_id, e.heading AS eh,
  a.center_x - e.center_x AS dx, a.center_y - e.center_y AS dy, a.velocity_x - e.velocity_x AS dvx, a.velocity_y - e.velocity_y AS dvy,
  sqrt(pow(a.center_x - e.center_x, 2) + pow(a.center_y - e.center_y, 2)) AS d,
  sqrt(a.velocity_x * a.velocity_x + a.velocity_y * a.velocity_y) AS spd, a.heading AS th,
  coalesce(a.track_id = f.f_id, FALSE) AS focal
FROM full_state e JOIN frames f ON e.scenario_id = f.scenario_id AND e.time_index = f.time_index
JOIN full_state a ON a.scenario_id = e.scenario_id AND a.time_index BETWEEN e.time_index - 10 AND e.time_index AND NOT a.is_sdc
WHERE e.is_sdc AND sqrt((a.center_x - e.center_x) * (a.center_x - e.center_x) + (a.center_y - e.center_y) * (a.center_y - e.center_y)) <= 70.0""")
add_cte("past_cl", ["past"], """
SELECT *, CASE WHEN d > 1e-4 THEN greatest(0.0, -(dvx * dx / d + dvy * dy / d)) END AS pos FROM past""")
add_cte("pressure_u", ["past_cl"], """
SELECT scenario_id, time_index, u, sum(CASE WHEN NOT focal THEN pos / greatest(1.0, d) END) AS p FROM past_cl GROUP BY ALL""")
add_cte("pressure", ["pressure_u", "ego_pos"], """
SELECT e.scenario_id, e.time_index, least(e.time_index, 10) AS steps, coalesce(sum(p), 0.0) AS tot, coalesce(max(p), 0.0) AS peak,
  coalesce(max(CASE WHEN u = e.time_index THEN p END), 0.0) AS p_now,
  coalesce(max(CASE WHEN u = greatest(e.time_index - 10, 0) THEN p END), 0.0) AS p_first
FROM ego_pos e LEFT JOIN pressure_u p ON e.scenario_id = p.scenario_id AND e.time_index = p.time_index GROUP BY e.scenario_id, e.time_index""")
add_cte("dyn", ["past_cl", "ego_pos", "pressure"], """
SELECT e.scenario_id, e.time_index, coalesce(n30, 0) AS n30, coalesce(n50, 0) AS n50, coalesce(n70, 0) AS n70,
  CASE WHEN n70 > 0 THEN veh / n70 ELSE 0.0 END AS vp, CASE WHEN n70 > 0 THEN (ped + cyc) / n70 ELSE 0.0 END AS up,
  CASE WHEN n70 > 0 THEN - (CASE WHEN veh > 0 THEN veh / n70 * ln(veh / n70) ELSE 0.0 END + CASE WHEN ped > 0 THEN ped / n70 * ln(ped / n70) ELSE 0.0 END
     + CASE WHEN cyc > 0 THEN cyc / n70 * ln(cyc / n70) ELSE 0.0 END) ELSE 0.0 END AS ent,
  coalesce(nearest, 70.0) AS nearest, coalesce(ms, 0.0) AS ms, coalesce(sd, 0.0) AS sd,
  CASE WHEN n3 > 0 THEN greatest(0.0, least(1.0, 1 - sqrt(mc * mc + msn * msn))) ELSE 0.0 END AS disp,
  coalesce(pmax, 0.0) AS pmax, p_now
FROM ego_pos e JOIN pressure q ON e.scenario_id = q.scenario_id AND e.time_index = q.time_index LEFT JOIN (
  SELECT scenario_id, time_index, count(*) FILTER (WHERE d <= 30) AS n30, count(*) FILTER (WHERE d <= 50) AS n50, count(*) AS n70,
    count(*) FILTER (WHERE object_type = 'TYPE_VEHICLE') AS veh, count(*) FILTER (WHERE object_type = 'TYPE_PEDESTRIAN') AS ped,
    count(*) FILTER (WHERE object_type = 'TYPE_CYCLIST') AS cyc, count(*) FILTER (WHERE NOT focal) AS n3,
    min(CASE WHEN NOT focal THEN d END) AS nearest, avg(CASE WHEN NOT focal THEN spd END) AS ms, stddev_pop(CASE WHEN NOT focal THEN spd END) AS sd,
    avg(CASE WHEN NOT focal THEN cos(th) END) AS mc, avg(CASE WHEN NOT focal THEN sin(th) END) AS msn, max(CASE WHEN NOT focal THEN pos END) AS pmax
  FROM past_cl WHERE u = time_index GROUP BY ALL) a ON e.scenario_id = a.scenario_id AND e.time_index = a.time_index""")
_DYN = ["n30", "n50", "n70", "vp", "up", "ent", "nearest", "ms", "sd", "disp", "pmax", "p_now"]
_dyn = ", ".join(r6(a, b) for a, b in zip(_DYN, E_DYNAMIC))
SQL["e_dynamic_features"] = query(f"SELECT {KEY}, {_dyn} FROM dyn", "dyn")

add_cte("phys", ["full_state", "frames", "past", "kin"], """
SELECT e.scenario_id, e.time_index, sqrt(e.velocity_x * e.velocity_x + e.velocity_y * e.velocity_y) AS spd, coalesce(accel, 0.0) AS acc, coalesce(yaw, 0.0) AS yaw,
  coalesce(dx * cos(eh) + dy * sin(eh), 0.0) AS lon, coalesce(-dx * sin(eh) + dy * cos(eh), 0.0) AS lat,
  coalesce(dvx * cos(eh) + dvy * sin(eh), 0.0) AS vlon, coalesce(-dvx * sin(eh) + dvy * cos(eh), 0.0) AS vlat, coalesce(p.spd, 0.0) AS fspd,
  coalesce(f_clr, 70.0) AS clr, coalesce(f_dist, 70.0) AS fd, CASE WHEN f_type = 'TYPE_VEHICLE' THEN 1.0 ELSE 0.0 END AS isv,
  CASE WHEN f_type IN ('TYPE_PEDESTRIAN', 'TYPE_CYCLIST') THEN 1.0 ELSE 0.0 END AS isu
FROM full_state e JOIN frames f ON e.scenario_id = f.scenario_id AND e.time_index = f.time_index
LEFT JOIN kin k ON e.scenario_id = k.scenario_id AND e.time_index = k.time_index AND k.is_sdc
LEFT JOIN (SELECT * FROM past WHERE focal AND u = time_index) p ON e.scenario_id = p.scenario_id AND e.time_index = p.time_index
WHERE e.is_sdc""")
_PHYS = ["spd", "acc", "yaw", "lon", "lat", "vlon", "vlat", "fspd", "clr", "fd", "isv", "isu"]
_phys = ", ".join(r6(a, b) for a, b in zip(_PHYS, P_CLEAN))
SQL["p_clean_features"] = query(f"SELECT {KEY}, {_phys} FROM phys", "phys")

add_cte("stat", ["ego_pos", "nearest", "lane_ctx", "signal_ctx"], """
SELECT e.scenario_id, e.time_index, coalesce(cw, 100.0) AS cw, coalesce(ss, 100.0) AS ss, coalesce(sb, 100.0) AS sb, coalesce(re, 100.0) AS re,
  coalesce(l.n, 0) AS ln, coalesce(disp, 0.0) AS ld, coalesce(s.d, 100.0) AS sd, coalesce(s.n, 0) AS sn
FROM ego_pos e LEFT JOIN (SELECT scenario_id, time_index, min(CASE WHEN feature_type = 'crosswalk' THEN d END) AS cw,
  min(CASE WHEN feature_type = 'stop_sign' THEN d END) AS ss, min(CASE WHEN feature_type = 'speed_bump' THEN d END) AS sb,
  min(CASE WHEN feature_type = 'road_edge' THEN d END) AS re FROM nearest GROUP BY ALL) n ON e.scenario_id = n.scenario_id AND e.time_index = n.time_index
LEFT JOIN lane_ctx l ON e.scenario_id = l.scenario_id AND e.time_index = l.time_index
LEFT JOIN signal_ctx s ON e.scenario_id = s.scenario_id AND e.time_index = s.time_index""")
_STAT = ["cw", "ss", "sb", "re", "ln", "ld", "sd"]
_stat = ", ".join(r6(a, b) for a, b in zip(_STAT, E_STATIC)) + ", " + r6("sn", E_DYNAMIC[-1])
SQL["e_static_features"] = query(f"SELECT {KEY}, {_stat} FROM stat", "stat")

# Set comparison with lists, the direct form of the turnover.
add_cte("turn", ["spine", "agent_state", "frames"], """
SELECT scenario_id, time_index, avg(n) OVER w AS n_mean, stddev_pop(n) OVER w AS n_std,
  CASE WHEN time_index > 0 THEN (n - first_value(n) OVER w) / greatest(0.1, least(time_index, 10) * 0.1) ELSE 0.0 END AS n_slope,
  coalesce(sum(chg) OVER (PARTITION BY scenario_id ORDER BY time_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS turns
FROM (SELECT f.scenario_id, f.time_index, f.n,
        CASE WHEN f.time_index > 0 AND coalesce(ids, []) IS DISTINCT FROM coalesce(lag(ids) OVER (PARTITION BY f.scenario_id ORDER BY f.time_index), []) THEN 1 ELSE 0 END AS chg
      FROM frames f LEFT JOIN (SELECT scenario_id, time_index, list_sort(list(DISTINCT track_id)) AS ids FROM agent_state WHERE NOT is_sdc GROUP BY ALL) i
      ON f.scenario_id = i.scenario_id AND f.time_index = i.time_index)
WINDOW w AS (PARTITION BY scenario_id ORDER BY time_index ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""")
SQL["composition_turnover"] = query(f"SELECT {KEY}, {r6('n_mean')}, {r6('n_std')}, {r6('n_slope')}, {r6('turns', 'turnover')} FROM turn", "turn")

add_cte("hist", ["ego_pos", "turn", "pressure"], """
SELECT e.scenario_id, e.time_index, n_mean, n_std, n_slope, tot / (steps + 1) AS p_mean, peak,
  CASE WHEN steps > 0 THEN (p_now - p_first) / greatest(0.1, steps * 0.1) ELSE 0.0 END AS p_slope, turns
FROM ego_pos e JOIN turn t ON e.scenario_id = t.scenario_id AND e.time_index = t.time_index
JOIN pressure p ON e.scenario_id = p.scenario_id AND e.time_index = p.time_index""")
_HIST = ["n_mean", "n_std", "n_slope", "p_mean", "peak", "p_slope", "turns"]
_hist = ", ".join(r6(a, b) for a, b in zip(_HIST, E_HIST))
SQL["e_hist_features"] = query(f"SELECT {KEY}, {_hist} FROM hist", "hist")

_all = ", ".join([*[f'p.{a} AS "{b}"' for a, b in zip(_PHYS, P_CLEAN)], *[f'st.{a} AS "{b}"' for a, b in zip(_STAT, E_STATIC)], f'st.sn AS "{E_DYNAMIC[-1]}"',
                  *[f'd.{a} AS "{b}"' for a, b in zip(_DYN, E_DYNAMIC)], *[f'h.{a} AS "{b}"' for a, b in zip(_HIST, E_HIST)]])
add_cte("features", ["labels_t", "phys", "stat", "dyn", "hist"], f"""
SELECT l.scenario_id, l.time_index, l.status, t_ttc, t_c, w, {_all} FROM labels_t l
LEFT JOIN phys p ON l.scenario_id = p.scenario_id AND l.time_index = p.time_index
LEFT JOIN stat st ON l.scenario_id = st.scenario_id AND l.time_index = st.time_index
LEFT JOIN dyn d ON l.scenario_id = d.scenario_id AND l.time_index = d.time_index
LEFT JOIN hist h ON l.scenario_id = h.scenario_id AND l.time_index = h.time_index""")
FEATURES = P_CLEAN + E_STATIC + E_DYNAMIC + E_HIST
SQL["frame_feature_table"] = query(f"""
SELECT {KEY}, status, {r6('t_ttc', 'target_ttc_s')}, {r6('t_c', 'target_c_t')}, CAST(t_ttc <= 2 AS BIGINT) AS target_y_tau_2s,
  CAST(t_ttc <= 3 AS BIGINT) AS target_y_tau_3s, CAST(t_ttc <= 5 AS BIGINT) AS target_y_tau_5s, {r6('w', 'weight_scenario_equal')},
  {', '.join(r6(f) for f in FEATURES)} FROM features""", "features")
SQL["scenario_feature_means"] = query(f"""SELECT scenario_id, {', '.join(r6(f'avg({f})', f + '_mean') for f in FEATURES)} FROM features GROUP BY 1""", "features")
