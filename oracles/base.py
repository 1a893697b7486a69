"""Shared CTEs of the comparison SQL, written independently of the engine's expressions."""
from nearmiss.sources.fixture import VIEWS

RAW = {name: sql.replace("{lineitem}", "lineitem") for name, sql in VIEWS.items()}

_FULL = ("valid AND center_x IS NOT NULL AND center_y IS NOT NULL AND velocity_x IS NOT NULL AND velocity_y IS NOT NULL "
         "AND heading IS NOT NULL AND length > 0 AND width > 0")


def _pairs(only_full_targets: bool, types: str) -> str:
    """Ego x target rows with TTC, clearance and closing speed."""
    return f"""
SELECT *, CASE WHEN hit AND enter_s <= 1e-9 THEN TRUE ELSE FALSE END AS overlap_now,
       CASE WHEN hit THEN enter_s ELSE 10.0 END AS ttc,
       CASE WHEN apart THEN sqrt(least(c1,c2,c3,c4,c5,c6,c7,c8)) ELSE 0.0 END AS clearance
FROM (
SELECT *, enter_s <= leave_s + 1e-9 AS hit,
  abs(o0) > r0 + 1e-9 OR abs(o1) > r1 + 1e-9 OR abs(o2) > r2 + 1e-9 OR abs(o3) > r3 + 1e-9 AS apart,
  {_corner('-o2', '-o3', 'ehl', 'ehw', 'thl', 'thw', 'rc', 'rs')},
  {_corner('o0', 'o1', 'thl', 'thw', 'ehl', 'ehw', 'rc', '(-rs)', 5)}
FROM (
SELECT *, greatest(0.0, {', '.join(_enter(k) for k in range(4))}) AS enter_s,
          least(10.0, {', '.join(_leave(k) for k in range(4))}) AS leave_s
FROM (
SELECT *, ehl + abs(rc) * thl + abs(rs) * thw AS r0, ehw + abs(rs) * thl + abs(rc) * thw AS r1,
       thl + abs(rc) * ehl + abs(rs) * ehw AS r2, thw + abs(rs) * ehl + abs(rc) * ehw AS r3,
       dx * ec + dy * es AS o0, dx * (-es) + dy * ec AS o1, dx * tc + dy * ts AS o2, dx * (-ts) + dy * tc AS o3,
       dvx * ec + dvy * es AS v0, dvx * (-es) + dvy * ec AS v1, dvx * tc + dvy * ts AS v2, dvx * (-ts) + dvy * tc AS v3
FROM (
SELECT *, ec * tc + es * ts AS rc, ec * ts - es * tc AS rs, sqrt(dx * dx + dy * dy) AS dist,
       CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6 THEN
         -(dvx * (dx / sqrt(dx * dx + dy * dy)) + dvy * (dy / sqrt(dx * dx + dy * dy))) ELSE 0.0 END AS closing
FROM (
SELECT e.scenario_id, e.time_index, e.track_id AS ego_id, t.track_id AS target_id, t.object_type AS target_type,
       ({_FULL.replace('valid', 't.valid', 1).replace('center', 't.center').replace('velocity', 't.velocity').replace('heading', 't.heading').replace('length', 't.length').replace('width', 't.width')}) AS pair_valid,
       t.center_x - e.center_x AS dx, t.center_y - e.center_y AS dy,
       t.velocity_x - e.velocity_x AS dvx, t.velocity_y - e.velocity_y AS dvy,
       cos(e.heading) AS ec, sin(e.heading) AS es, cos(t.heading) AS tc, sin(t.heading) AS ts,
       e.length / 2 AS ehl, e.width / 2 AS ehw, t.length / 2 AS thl, t.width / 2 AS thw,
       e.heading AS e_heading, t.heading AS t_heading, t.velocity_x AS t_vx, t.velocity_y AS t_vy,
       e.velocity_x AS e_vx, e.velocity_y AS e_vy, e.length AS e_len, e.width AS e_wid, t.length AS t_len, t.width AS t_wid
FROM full_state e JOIN {'full_state' if only_full_targets else '(SELECT * FROM agent_state WHERE valid)'} t
  ON e.scenario_id = t.scenario_id AND e.time_index = t.time_index AND e.is_sdc AND NOT t.is_sdc {types}
) a) b WHERE dist <= 70.0) c) d) e"""


def _corner(ox, oy, hl, hw, bl, bw, rc, rs, start=1):
    out = []
    for a in ("", "-"):
        for b in ("", "-"):
            x = f"({ox} + ({a}{hl}) * {rc} + ({b}{hw}) * {rs})"
            y = f"({oy} - ({a}{hl}) * {rs} + ({b}{hw}) * {rc})"
            out.append(f"pow(greatest(abs({x}) - {bl}, 0.0), 2) + pow(greatest(abs({y}) - {bw}, 0.0), 2) AS c{start + len(out)}")
    return ", ".join(out)


def _enter(k):
    return (f"CASE WHEN abs(v{k}) < 1e-12 THEN CASE WHEN abs(o{k}) <= r{k} + 1e-9 THEN 0.0 ELSE CAST('Infinity' AS DOUBLE) END "
            f"ELSE least((-r{k} - o{k}) / v{k}, (r{k} - o{k}) / v{k}) END")


def _leave(k):
    return (f"CASE WHEN abs(v{k}) < 1e-12 THEN CASE WHEN abs(o{k}) <= r{k} + 1e-9 THEN 10.0 ELSE CAST('-Infinity' AS DOUBLE) END "
            f"ELSE greatest((-r{k} - o{k}) / v{k}, (r{k} - o{k}) / v{k}) END")


_TYPES = "AND t.object_type IN ('TYPE_VEHICLE', 'TYPE_PEDESTRIAN', 'TYPE_CYCLIST')"

_CTES = {
    **{name: ([], sql) for name, sql in RAW.items()},
    "full_state": (["agent_state"], f"SELECT * FROM agent_state WHERE {_FULL}"),
    "pairs": (["full_state"], _pairs(True, _TYPES)),
    "pairs_raw": (["full_state"], _pairs(False, _TYPES)),
    "actors": (["full_state"], _pairs(True, "")),
    "presence": (["agent_state"], f"""
SELECT scenario_id, time_index, count(*) > 0 AS any_row, bool_or(valid) AS any_valid, bool_or(is_sdc AND valid) AS ego_flagged,
       bool_or(is_sdc AND {_FULL}) AS ego_ok FROM agent_state GROUP BY ALL"""),
    "spine": (["presence"], """
SELECT g.scenario_id, g.time_index, g.ego_track_id, g.time_index * CAST(0.1 AS DOUBLE) AS ts, coalesce(any_row, FALSE) AS any_row,
       coalesce(any_valid, FALSE) AS any_valid, coalesce(ego_flagged, FALSE) AS ego_flagged, coalesce(ego_ok, FALSE) AS ego_ok
FROM (SELECT scenario_id, ego_track_id, CAST(u AS INT) AS time_index
      FROM (SELECT scenario_id, max(CASE WHEN is_sdc THEN track_id END) AS ego_track_id FROM agent_state GROUP BY 1), range(91) r(u)) g
LEFT JOIN presence p ON g.scenario_id = p.scenario_id AND g.time_index = p.time_index"""),
    "frames": (["pairs", "spine"], """
SELECT s.scenario_id, s.time_index, s.ts, s.status, ttc, sev,
       coalesce(ttc <= 3.0, FALSE) AS is_critical, status IN ('current_geometry_overlap', 'future_contact_event', 'right_censored') AS exposed,
       f_id, f_type, f_clr, f_dist, f_cl, d_id, d_type, d_clr, d_dist, d_cl,
       coalesce(n, 0) AS n, coalesce(n_veh, 0) AS n_veh, coalesce(n_ped, 0) AS n_ped, coalesce(n_cyc, 0) AS n_cyc
FROM (
SELECT *, CASE WHEN status = 'right_censored' THEN 10.0 WHEN status IN ('current_geometry_overlap', 'future_contact_event') THEN d_ttc END AS ttc,
       CASE WHEN status = 'right_censored' THEN 0.0 WHEN status = 'current_geometry_overlap' THEN 1.0
            WHEN status = 'future_contact_event' THEN greatest(0.0, least(1.0, 1.0 - (d_ttc - 0.0) / 10.0)) END AS sev
FROM (
SELECT s.*, f.* EXCLUDE (scenario_id, time_index), d.* EXCLUDE (scenario_id, time_index), m.* EXCLUDE (scenario_id, time_index),
       CASE WHEN NOT any_row THEN 'invalid_frame' WHEN NOT ego_ok THEN 'invalid_ego_state' WHEN d_id IS NULL THEN 'no_exposure'
            WHEN d_overlap OR d_ttc <= 1e-6 THEN 'current_geometry_overlap'
            WHEN d_hit AND d_ttc < 10.0 THEN 'future_contact_event' ELSE 'right_censored' END AS status
FROM spine s
LEFT JOIN (SELECT scenario_id, time_index, target_id AS f_id, target_type AS f_type, clearance AS f_clr, dist AS f_dist, closing AS f_cl
           FROM pairs QUALIFY row_number() OVER (PARTITION BY scenario_id, time_index ORDER BY clearance, dist, target_id) = 1) f
  ON s.scenario_id = f.scenario_id AND s.time_index = f.time_index
LEFT JOIN (SELECT scenario_id, time_index, target_id AS d_id, target_type AS d_type, clearance AS d_clr, dist AS d_dist, closing AS d_cl,
                  ttc AS d_ttc, overlap_now AS d_overlap, hit AS d_hit
           FROM pairs QUALIFY row_number() OVER (PARTITION BY scenario_id, time_index ORDER BY ttc, clearance, dist, target_id) = 1) d
  ON s.scenario_id = d.scenario_id AND s.time_index = d.time_index
LEFT JOIN (SELECT scenario_id, time_index, count(*) AS n, count(*) FILTER (WHERE target_type = 'TYPE_VEHICLE') AS n_veh,
                  count(*) FILTER (WHERE target_type = 'TYPE_PEDESTRIAN') AS n_ped, count(*) FILTER (WHERE target_type = 'TYPE_CYCLIST') AS n_cyc
           FROM pairs GROUP BY ALL) m ON s.scenario_id = m.scenario_id AND s.time_index = m.time_index
)) s"""),
    "episodes": (["frames"], """
SELECT scenario_id, episode, min(s) AS s, max(e) AS e, max(e) - min(s) AS dur FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY scenario_id ORDER BY s) AS episode FROM (
    SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY scenario_id ORDER BY s) <= 0.5 THEN 0 ELSE 1 END AS fresh FROM (
      SELECT scenario_id, min(ts) AS s, max(ts) + CAST(0.1 AS DOUBLE) AS e FROM (
        SELECT scenario_id, ts, time_index - row_number() OVER (PARTITION BY scenario_id ORDER BY time_index) AS island
        FROM frames WHERE is_critical) GROUP BY scenario_id, island)))
GROUP BY scenario_id, episode HAVING max(e) - min(s) >= 0.5"""),
    "recovery": (["frames"], """
SELECT scenario_id, greatest(coalesce(min(CASE WHEN streak >= 5 THEN ts END) - CAST(0.5 AS DOUBLE), max(last_ts)) - max(peak), 0.0) AS recovery,
       min(CASE WHEN streak >= 5 THEN ts END) IS NULL AS censored
FROM (SELECT *, CASE WHEN NOT is_critical THEN row_number() OVER (PARTITION BY scenario_id, resets ORDER BY time_index)
                 - CASE WHEN resets > 0 THEN 1 ELSE 0 END END AS streak
      FROM (SELECT *, sum(CASE WHEN is_critical THEN 1 ELSE 0 END) OVER (PARTITION BY scenario_id ORDER BY time_index) AS resets
            FROM (SELECT f.*, peak, max(f.ts) OVER (PARTITION BY f.scenario_id) AS last_ts FROM frames f
                  JOIN (SELECT scenario_id, ts AS peak FROM frames WHERE exposed
                        QUALIFY row_number() OVER (PARTITION BY scenario_id ORDER BY sev DESC, time_index) = 1) p
                  ON f.scenario_id = p.scenario_id) WHERE ts >= peak))
GROUP BY scenario_id"""),
    "profile": (["frames", "episodes", "recovery"], """
SELECT a.scenario_id, total_frames, valid_frames, exposed_frames, valid_frames / total_frames AS valid_frame_fraction,
       CASE WHEN valid_frames > 0 THEN exposed_frames / valid_frames ELSE 0.0 END AS exposure_frame_fraction,
       coalesce(peak, 0.0) AS criticality_peak, coalesce(auc, 0.0) AS criticality_auc_s, coalesce(mean_sev, 0.0) AS criticality_mean_exposed,
       coalesce(tet1, 0.0) AS tet_1s_s, coalesce(tet2, 0.0) AS tet_2s_s, coalesce(tet3, 0.0) AS tet_3s_s, coalesce(tet5, 0.0) AS tet_5s_s,
       coalesce(n_ep, 0) AS episode_count_3s, coalesce(max_ep, 0.0) AS max_episode_duration_3s_s,
       coalesce(recovery, 0.0) AS recovery_time_3s_s, coalesce(censored, TRUE) AS recovery_censored_3s,
       coalesce(turns, 0) AS dominant_actor_turnover_count,
       CASE WHEN exposed_frames > 0 THEN coalesce(turns, 0) / exposed_frames ELSE 0.0 END AS dominant_actor_turnover_rate,
       CASE WHEN exposed_frames > 0 THEN veh / exposed_frames ELSE 0.0 END AS fraction_dominant_vehicle,
       CASE WHEN exposed_frames > 0 THEN ped / exposed_frames ELSE 0.0 END AS fraction_dominant_pedestrian,
       CASE WHEN exposed_frames > 0 THEN cyc / exposed_frames ELSE 0.0 END AS fraction_dominant_cyclist
FROM (SELECT scenario_id, count(*) AS total_frames, count(*) FILTER (WHERE status NOT IN ('invalid_frame', 'invalid_ego_state')) AS valid_frames,
        count(*) FILTER (WHERE exposed) AS exposed_frames, max(sev) AS peak, avg(sev) AS mean_sev, sum(sev * dt) AS auc,
        sum(CASE WHEN ttc <= 1 THEN dt END) AS tet1, sum(CASE WHEN ttc <= 2 THEN dt END) AS tet2,
        sum(CASE WHEN ttc <= 3 THEN dt END) AS tet3, sum(CASE WHEN ttc <= 5 THEN dt END) AS tet5,
        count(*) FILTER (WHERE d_type = 'TYPE_VEHICLE') AS veh, count(*) FILTER (WHERE d_type = 'TYPE_PEDESTRIAN') AS ped,
        count(*) FILTER (WHERE d_type = 'TYPE_CYCLIST') AS cyc
      FROM (SELECT *, CASE WHEN nxt IS NULL THEN 0.1 ELSE greatest(0.01, least(0.5, nxt - ts)) END AS dt
            FROM (SELECT *, lead(ts) OVER (PARTITION BY scenario_id ORDER BY time_index) AS nxt FROM frames))
      GROUP BY scenario_id) a
LEFT JOIN (SELECT scenario_id, count(*) AS n_ep, max(dur) AS max_ep FROM episodes GROUP BY 1) e ON a.scenario_id = e.scenario_id
LEFT JOIN recovery r ON a.scenario_id = r.scenario_id
LEFT JOIN (SELECT scenario_id, count(*) FILTER (WHERE d_id <> prev) AS turns FROM (
             SELECT scenario_id, d_id, lag(d_id) OVER (PARTITION BY scenario_id ORDER BY time_index) AS prev FROM frames WHERE exposed) GROUP BY 1) t
  ON a.scenario_id = t.scenario_id"""),
}


def add_cte(name: str, needs: list, sql: str) -> None:
    _CTES[name] = (needs, sql)


def query(select: str, *needs: str, swap: dict | None = None) -> str:
    """Prefix a select with the CTEs it needs, dependencies first; `swap` gives some of them as other {name: (needs, SQL)}."""
    order: list = []
    ctes = {**_CTES, **(swap or {})}

    def visit(n):
        if n not in order:
            for d in ctes[n][0]:
                visit(d)
            if n not in order:
                order.append(n)

    for n in needs:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ctes[n][1]})" for n in order) + "\n" + select


def r6(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded double without negative zero, aliased."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name or expr}"
