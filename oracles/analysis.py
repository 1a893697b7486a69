"""SQL twins of nearmiss.plans.analysis."""
from oracles import statistics as ST
from oracles.base import add_cte, query, r6
from oracles.context import KEY
from oracles.statistics import spear
from oracles.tables import SPLIT, SQL as TABLES, _u, _hex

SQL = {}


def phi(z: str) -> str:
    """Normal CDF by its power series in DuckDB lists."""
    return (f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * "
            f"list_sum(list_transform(range(0, 90), lambda k: pow(abs({z}), 2 * k + 1) * sqrt(pi()) / (pow(2.0, k + 1) * gamma(k + 1.5)))))")


add_cte("pred_z", ["predictions"], "SELECT *, (ln(3.0) - pred_mu) / pred_sigma AS z3, (y_log_ttc - pred_mu) / pred_sigma AS zy FROM predictions")
add_cte("curve", ["pred_z"], f"""
SELECT *, timestamp_seconds - first_value(timestamp_seconds) OVER (PARTITION BY scenario_id ORDER BY time_index) AS rel, pred_p_exposure * {phi('z3')} AS rt,
  CASE WHEN exposure_flag = 1 AND target_status = 'event' THEN -ln(greatest({phi('zy')}, 1e-12)) END AS st FROM pred_z""")
SQL["risk_curve"] = query(f'SELECT {KEY}, {r6("rel", "timestamp_rel")}, {r6("rt", chr(34) + "Rt" + chr(34))}, {r6("st", chr(34) + "St" + chr(34))} FROM curve', "curve")


def events(source: str, part: str, on="0.7", off="0.3") -> str:
    """Raw hysteresis events, merged and filtered, from a curve with columns rel and rt."""
    return f"""
SELECT {part}, grp, min(s) AS s, max(e) AS e, max(e) - min(s) AS dur FROM (
SELECT *, sum(fresh) OVER (PARTITION BY {part} ORDER BY s) AS grp FROM (
SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY {part} ORDER BY s) <= 0.5 THEN 0 ELSE 1 END AS fresh FROM (
SELECT {part}, run, min(rel) AS s, max(nxt) AS e FROM (
SELECT *, sum(CASE WHEN inside AND NOT coalesce(prev, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY time_index) AS run FROM (
SELECT *, lag(inside) OVER (PARTITION BY {part} ORDER BY time_index) AS prev, coalesce(lead(rel) OVER (PARTITION BY {part} ORDER BY time_index), rel) AS nxt FROM (
SELECT *, coalesce(last_value(CASE WHEN rt >= {on} THEN TRUE WHEN rt < {off} THEN FALSE END IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY time_index), FALSE) AS inside
FROM {source}))) WHERE inside GROUP BY {part}, run))) GROUP BY {part}, grp HAVING max(e) - min(s) >= 0.3"""


add_cte("ev", ["curve"], events("curve", "scenario_id"))
SQL["hysteresis_events"] = query(f"SELECT scenario_id, {r6('s', 'start_s')}, {r6('e', 'end_s')}, {r6('dur', 'duration_s')} FROM ev", "ev")


def vectors(source: str, ev: str, part: str, on="0.7", off="0.3") -> str:
    on_part = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in part.split(","))
    cols = ", ".join(f"b.{k.strip()}" for k in part.split(","))
    return f"""
SELECT {cols}, round(peak, 6) AS peak, round(exc, 4) AS exceedance_duration, coalesce(n_ev, 0) AS event_count, round(coalesce(mx, 0.0), 4) AS max_event_duration,
  round(coalesce(coalesce(held, last_rel) - e, 0.0), 4) AS recovery_time, round(unc, 6) AS predictive_uncertainty, e IS NOT NULL AND held IS NULL AS recovery_censored,
  round(lse, 4) AS lse_score, round(mean_rt, 6) AS mean_rt FROM (
SELECT {part}, max(rt) AS peak, coalesce(sum(CASE WHEN rt >= {on} THEN step END), 0.0) AS exc, avg(pred_sigma) * 2.563103131089201 AS unc,
  ln(sum(CASE WHEN rt > 0 THEN rt ELSE 1e-30 END)) AS lse, avg(rt) AS mean_rt
FROM (SELECT *, rel - lag(rel) OVER (PARTITION BY {part} ORDER BY time_index) AS step FROM {source}) GROUP BY {part}) b
LEFT JOIN (SELECT {part}, count(*) AS n_ev, max(dur) AS mx, max(e) AS e FROM {ev} GROUP BY {part}) v ON {on_part('b', 'v')}
LEFT JOIN (SELECT {part}, min(CASE WHEN low AND rel - since >= 0.5 THEN rel END) AS held, max(rel) AS last_rel FROM (
  SELECT *, min(CASE WHEN low THEN rel END) OVER (PARTITION BY {part}, resets) AS since FROM (
    SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY {part} ORDER BY time_index) AS resets FROM (
      SELECT c.*, rt < {off} AS low FROM {source} c JOIN (SELECT {part}, max(e) AS e FROM {ev} GROUP BY {part}) l ON {on_part('c', 'l')} WHERE rel > e))) GROUP BY {part}) h ON {on_part('b', 'h')}"""


add_cte("vec", ["curve", "ev"], vectors("curve", "ev", "scenario_id"))
_V = ["peak", "exceedance_duration", "max_event_duration", "recovery_time", "predictive_uncertainty", "lse_score"]
SQL["diagnostic_vector"] = query(f"""SELECT scenario_id, event_count, recovery_censored, {', '.join(r6(v) for v in _V)}, {r6('mean_rt', '"mean_Rt"')} FROM vec""", "vec")

add_cte("cal", ["predictions"], f"""
SELECT tau, avg(CASE WHEN target_status = 'event' AND y_log_ttc <= ln(tau) + 1e-9 THEN 1.0 ELSE 0.0 END) AS o, avg(pred_p_exposure * {phi('((ln(tau) - pred_mu) / pred_sigma)')}) AS p, count(*) AS n
FROM predictions, (SELECT unnest([1.0, 2.0, 3.0, 5.0, 7.0, 10.0])::DOUBLE AS tau) WHERE exposure_flag = 1 GROUP BY tau""")
SQL["tau_calibration"] = query(f"SELECT tau, {r6('o', 'observed_rate')}, {r6('p', 'predicted_rate')}, n AS n_samples, {r6('abs(o - p)', 'absolute_error')} FROM cal", "cal")
add_cte("pit", ["pred_z"], f"""
SELECT CASE WHEN target_status = 'event' THEN 'uncensored_pit' ELSE 'censored_pit' END AS kind, CASE WHEN target_status = 'event' THEN {phi('zy')} ELSE 1 - {phi('zy')} END AS v
FROM pred_z WHERE exposure_flag = 1 AND target_status <> 'no_exposure'""")
SQL["pit_histogram"] = query(f"""SELECT kind, count(*) AS n_samples, {r6('avg(v)', 'mean')}, {r6('stddev_pop(v)', 'std')},
  {', '.join(f'count(*) FILTER (WHERE least(floor(v * 10), 9) = {b}) AS bin_{b}' for b in range(10))} FROM pit GROUP BY 1""", "pit")
_Q = {0.05: -1.6448536269514729, 0.10: -1.2815515655446004, 0.25: -0.6744897501960817, 0.50: 0.0}
SQL["quantile_coverage"] = query(" UNION ALL ".join(f"""
SELECT CAST({q} AS DOUBLE) AS nominal, {r6(f'avg(CASE WHEN y_log_ttc <= pred_mu + pred_sigma * ({z}) THEN 1.0 ELSE 0.0 END)', 'actual_coverage')}, count(*) AS n_events,
  {r6(f'avg(CASE WHEN y_log_ttc <= pred_mu + pred_sigma * ({z}) THEN 1.0 ELSE 0.0 END) - {q}', 'gap')} FROM predictions WHERE exposure_flag = 1 AND target_status = 'event'""" for q, z in _Q.items()), "predictions")
SQL["stratified_gate"] = query(f"""
SELECT d AS dimension, s AS stratum, count(*) AS n_frames, {r6('avg(pow(pred_p_exposure - exposure_flag, 2))', 'brier')}, {r6('avg(exposure_flag)', 'exposure_rate')} FROM (
SELECT *, 'phase' AS d, CASE WHEN time_index <= 45 THEN 'early' ELSE 'late' END AS s FROM predictions
UNION ALL SELECT *, 'spread', CASE WHEN pred_sigma > 0.9 THEN 'wide' ELSE 'narrow' END FROM predictions) GROUP BY 1, 2""", "predictions")

add_cte("pred_split", ["pred_z", "ids_p"], f"SELECT p.*, split FROM pred_z p JOIN ids_p i ON p.scenario_id = i.scenario_id WHERE exposure_flag = 1")
add_cte("ids_p", ["predictions"], f"SELECT scenario_id, {SPLIT.format(u='u')} AS split FROM (SELECT scenario_id, {_u} AS u FROM (SELECT DISTINCT scenario_id FROM predictions))")
_EV = "target_status = 'event'"
_nll_parts = lambda e, c, form: f"""
SELECT split, '{form}' AS form, {r6(f'avg(CASE WHEN {_EV} THEN {e} END)', 'nll_event')}, {r6(f'avg(CASE WHEN NOT {_EV} THEN {c} END)', 'nll_censored')},
  {r6(f'avg(CASE WHEN {_EV} THEN {e} ELSE {c} END)', 'nll_total')}, count(*) FILTER (WHERE {_EV}) AS n_event, count(*) FILTER (WHERE NOT {_EV}) AS n_censored, count(*) AS n_total FROM pred_split GROUP BY 1"""
_gauss = "(ln(pred_sigma) + 0.5 * ln(2 * pi()) + 0.5 * zy * zy)"
SQL["censored_nll"] = query(_nll_parts(f"({_gauss} + y_log_ttc)", f"(-ln(1 - {phi('((ln(10.0) - pred_mu) / pred_sigma)')}))", "ttc_scale")
                            + " UNION ALL " + _nll_parts(_gauss, f"(-ln(1 - {phi('zy')}))", "log_scale"), "pred_split")

_every = lambda k: f"(SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY time_index) AS rn FROM curve QUALIFY (rn - 1) % {k} = 0)"
SQL["subsample_hz"] = query(f"""
SELECT a.scenario_id, a.n AS n_5hz, a.l AS last_n_5hz, b.n AS n_2hz, b.l AS last_n_2hz FROM (SELECT scenario_id, count(*) AS n, CAST(max(time_index) AS BIGINT) AS l FROM {_every(2)} GROUP BY 1) a
JOIN (SELECT scenario_id, count(*) AS n, CAST(max(time_index) AS BIGINT) AS l FROM {_every(5)} GROUP BY 1) b ON a.scenario_id = b.scenario_id""", "curve")
_u13 = lambda e: f"(CAST({_hex(e, 1, 13)} AS DOUBLE) / 4503599627370496.0)"
_drop = lambda rate: f"""(SELECT * FROM curve QUALIFY {_u13("md5('42|' || scenario_id || '|' || time_index)")} >= {rate}
  OR time_index = min(time_index) OVER (PARTITION BY scenario_id) OR time_index = max(time_index) OVER (PARTITION BY scenario_id))"""
SQL["frame_dropout"] = query(f"SELECT {KEY} FROM {_drop(0.10)}", "curve")
add_cte("theta", ["curve"], """SELECT q, greatest(t, 0.01) AS on_, greatest(t * 0.5, 0.005) AS off_ FROM (
SELECT unnest([0.9, 0.95, 0.99])::DOUBLE AS q, unnest(quantile_cont(rt, [0.9, 0.95, 0.99])) AS t FROM curve)""")
SQL["threshold_from_quantile"] = query(f"SELECT q, {r6('on_', 'theta_on')}, {r6('off_', 'theta_off')} FROM theta", "theta")

_cols = "scenario_id, time_index, timestamp_seconds, rt, pred_sigma"
add_cte("exper", ["curve", "theta"], f"""
SELECT *, timestamp_seconds - first_value(timestamp_seconds) OVER (PARTITION BY experiment, scenario_id ORDER BY time_index) AS rel FROM (
SELECT 'original' AS experiment, {_cols}, 0.7 AS on_, 0.3 AS off_ FROM curve UNION ALL SELECT '5hz', {_cols}, 0.7, 0.3 FROM {_every(2)}
UNION ALL SELECT '2hz', {_cols}, 0.7, 0.3 FROM {_every(5)} UNION ALL SELECT 'dropout_5pct', {_cols}, 0.7, 0.3 FROM {_drop(0.05)}
UNION ALL SELECT 'dropout_10pct', {_cols}, 0.7, 0.3 FROM {_drop(0.10)}
UNION ALL SELECT 'theta_q' || CAST(round(q * 100) AS INT), {_cols}, theta.on_, theta.off_ FROM curve, theta)""")
add_cte("exper_ev", ["exper"], events("exper", "experiment, scenario_id", "on_", "off_"))
add_cte("exper_vec", ["exper", "exper_ev"], vectors("exper", "exper_ev", "experiment, scenario_id", "on_", "off_"))
add_cte("versus", ["exper_vec"], """SELECT x.*, o.peak AS ref_peak, o.event_count AS ref_event_count, o.exceedance_duration AS ref_exceedance_duration, o.max_event_duration AS ref_max_event_duration,
  o.recovery_time AS ref_recovery_time, o.predictive_uncertainty AS ref_predictive_uncertainty FROM exper_vec x JOIN exper_vec o ON o.experiment = 'original' AND x.scenario_id = o.scenario_id""")
SQL["ref_vs_perturbed"] = query(f"SELECT experiment, scenario_id, {r6('peak', 'peak', 4)}, {r6('ref_peak', 'ref_peak', 4)}, event_count, ref_event_count FROM versus", "versus")
_COMP = ["peak", "exceedance_duration", "event_count", "max_event_duration", "recovery_time", "predictive_uncertainty"]
SQL["component_relative_error"] = query(" UNION ALL ".join(f"""
SELECT experiment, '{k}' AS component, {r6(f'avg(abs(ref_{k} - {k}) / greatest(abs(ref_{k}), 1e-12))', 'mean_rel_error', 4)}, {r6(f'max(abs(ref_{k} - {k}) / greatest(abs(ref_{k}), 1e-12))', 'max_rel_error', 4)},
  {r6(f'quantile_cont(abs(ref_{k} - {k}) / greatest(abs(ref_{k}), 1e-12), 0.5)', 'median_rel_error', 4)} FROM versus GROUP BY experiment""" for k in _COMP), "versus")
SQL["icc_2_1"] = query(f"""
SELECT n, k, {r6('(msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)', 'icc', 4)} FROM (
SELECT n, k, rows / (n - 1) AS msr, cols / (k - 1) AS msc, (total - rows - cols) / ((n - 1) * (k - 1)) AS mse FROM (
SELECT count(DISTINCT scenario_id) AS n, count(DISTINCT experiment) AS k, sum(pow(peak - g, 2)) AS total, sum(pow(rm - g, 2)) AS rows, sum(pow(cm - g, 2)) AS cols FROM (
SELECT *, avg(peak) OVER () AS g, avg(peak) OVER (PARTITION BY scenario_id) AS rm, avg(peak) OVER (PARTITION BY experiment) AS cm FROM exper_vec)))""", "exper_vec")

_RESP = ["kpi__radial_closing_decel_proxy_max", "kpi__sdc_hard_decel_p95", "kpi__sdc_min_longitudinal_accel", "kpi__sdc_abs_jerk_p95", "kpi__sdc_abs_yaw_rate_p95", "kpi__sdc_lateral_accel_p95"]
add_cte("resp", ["frames", "kin"], TABLES["response_kpis"].split("\nSELECT f.scenario_id", 1)[1].join(["SELECT f.scenario_id", ""]).replace(", 5) + CAST(0 AS DOUBLE)", ", 15)"))
add_cte("pk", ["profile", "resp"], "SELECT p.* EXCLUDE (criticality_peak, criticality_auc_s, tet_1s_s, tet_2s_s, tet_3s_s, tet_5s_s), r.scenario_id AS rid, "
        + ", ".join(f"round({x}, 9) AS {x}" for x in ["criticality_peak", "criticality_auc_s", "tet_1s_s", "tet_2s_s", "tet_3s_s", "tet_5s_s", *_RESP]) + " FROM profile p JOIN resp r ON p.scenario_id = r.scenario_id")
_CMP = ["criticality_peak", "criticality_auc_s", "tet_3s_s"]
SQL["score_vectors"] = query(f"""SELECT v.scenario_id, {r6('peak', '"Ds_risk"', 4)}, {r6('max_event_duration', '"Bs_response"', 4)}, {r6('t', '"Ds_tail"', 4)} FROM vec v
LEFT JOIN (SELECT scenario_id, avg(st) AS t FROM curve GROUP BY 1) c ON v.scenario_id = c.scenario_id""", "vec", "curve")
_rho = lambda a, b: f"(SELECT rho FROM ({spear('', a, b, 'pk')}))"
SQL["kpi_direction"] = query(" UNION ALL ".join(f"""
SELECT 'criticality_peak' AS score, '{k}' AS kpi, {r6(_rho('criticality_peak', k), 'spearman')}, (SELECT count(*) FROM pk) AS n_valid, '{cat}' AS category, '{d}' AS expected_direction,
  coalesce({_rho('criticality_peak', k)} {'>' if d == 'positive' else '<'} 0, FALSE) AS direction_concordant"""
    for k, cat, d in __import__("nearmiss.operators.validity", fromlist=["KPI_REGISTRY"]).KPI_REGISTRY), "pk")
SQL["tau_rank_stability"] = query(" UNION ALL ".join(f"SELECT '{a}' AS score, 'tet_3s_s' AS kpi, {r6(_rho(a, 'tet_3s_s'), 'rho')}, (SELECT count(*) FROM pk) AS n" for a in ("tet_1s_s", "tet_2s_s", "tet_5s_s")), "pk")
_tau = lambda a, b: f"""(SELECT sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / sqrt(count(*) FILTER (WHERE x.{a} <> y.{a})::DOUBLE * count(*) FILTER (WHERE x.{b} <> y.{b})) FROM pk x JOIN pk y ON x.scenario_id < y.scenario_id)"""
SQL["correlation_matrix"] = query(" UNION ALL ".join(f"SELECT '{a}' AS score, '{b}' AS kpi, {r6(_rho(a, b), 'spearman')}, (SELECT count(*) FROM pk) AS n_valid, {r6(_tau(a, b), 'kendall')}" for a in _CMP for b in _RESP), "pk")
_topn = lambda s, f: f"(SELECT scenario_id FROM pk ORDER BY {s} DESC, scenario_id LIMIT (SELECT CAST(greatest(5, floor(count(*) * {f})) AS BIGINT) FROM pk))"
_ov = lambda a, b, f: r6(f"(SELECT count(*) FROM {_topn(a, f)} q WHERE scenario_id IN {_topn(b, f)}) / greatest(5, floor((SELECT count(*) FROM pk) * {f}))", "x").rsplit(" AS ", 1)[0]
SQL["top_fraction_overlap"] = query(" UNION ALL ".join(f"""SELECT CAST({f} AS DOUBLE) AS top_k_fraction, CAST(greatest(5, floor((SELECT count(*) FROM pk) * {f})) AS BIGINT) AS k,
  {_ov('criticality_peak', 'criticality_auc_s', f)} AS overlap_peak_vs_auc, {_ov('criticality_auc_s', 'tet_3s_s', f)} AS overlap_auc_vs_tet3""" for f in (0.01, 0.05, 0.1)), "pk")
_hi, _lo = "criticality_peak >= (SELECT quantile_cont(criticality_peak, 0.75) FROM pk)", "criticality_peak <= (SELECT quantile_cont(criticality_peak, 0.25) FROM pk)"
SQL["known_groups"] = query(" UNION ALL ".join(f"""SELECT '{k}' AS kpi, {r6('a', 'top_quartile_mean', 5)}, {r6('b', 'bottom_quartile_mean', 5)}, {r6('a - b', 'difference', 5)},
  {r6('(a - b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))', 'cohens_d', 5)} FROM (SELECT avg({k}) FILTER (WHERE {_hi}) AS a, avg({k}) FILTER (WHERE {_lo}) AS b,
  var_samp({k}) FILTER (WHERE {_hi}) AS va, var_samp({k}) FILTER (WHERE {_lo}) AS vb, count(*) FILTER (WHERE {_hi}) AS na, count(*) FILTER (WHERE {_lo}) AS nb FROM pk)""" for k in _RESP), "pk")
add_cte("disc", ["pk"], "SELECT criticality_auc_s AS x, kpi__sdc_hard_decel_p95 >= (SELECT quantile_cont(kpi__sdc_hard_decel_p95, 0.8) FROM pk) AS ev FROM pk")
SQL["event_discrimination"] = query(" UNION ALL ".join(f"""
SELECT CAST({f} AS DOUBLE) AS fpr, {r6('max(t)', 'score_threshold')}, {r6('count(*) FILTER (WHERE ev AND x >= t) / count(*) FILTER (WHERE ev)', 'sensitivity')}, count(*) FILTER (WHERE ev) AS n_events, count(*) FILTER (WHERE NOT ev) AS n_non_events
FROM disc, (SELECT x AS t FROM (SELECT x, row_number() OVER (ORDER BY x DESC) AS rn, floor({f} * count(*) OVER ()) AS want FROM disc WHERE NOT ev) WHERE rn = want)""" for f in (0.05, 0.1)), "disc")

# One control, so the ridge has a closed form.
add_cte("rin", ["ws"], "SELECT * EXCLUDE (n_lines), CAST(n_lines AS DOUBLE) AS n_lines FROM ws")
_T3 = ["n_lines", "p_base", "p_full"]
add_cte("rfit", ["rin"], "SELECT " + ", ".join(f"""
  (sum(w * gap_m * {t}) - sum(w * gap_m) * sum(w * {t}) / sum(w)) / (sum(w * gap_m * gap_m) - sum(w * gap_m) * sum(w * gap_m) / sum(w) + 1.0) AS b_{t}, sum(w * {t}) / sum(w) AS m_{t}""" for t in _T3)
        + ", sum(w * gap_m) / sum(w) AS m_x FROM rin WHERE split = 'train'")
add_cte("rres", ["rin", "rfit"], "SELECT rin.*, " + ", ".join(f"{t} - (m_{t} - b_{t} * m_x + b_{t} * gap_m) AS res_{t}" for t in _T3) + " FROM rin, rfit")
SQL["ridge_residual"] = query(f"SELECT {KEY}, {', '.join(r6(f'res_{t}') for t in _T3)} FROM rres WHERE split = 'internal_val'", "rres")
add_cte("rlong", ["rres"], """SELECT scenario_id, split, w, 'n_lines' AS feature_name, res_n_lines AS res_e, res_p_full AS res_c FROM rres
UNION ALL SELECT scenario_id, split, w, 'p_base', res_p_base, res_p_full FROM rres""")


def draws_of(ids: str, n: int = 1000) -> str:
    """Resampled multiplicities of the scenarios in a select."""
    idx = f"(SELECT scenario_id, row_number() OVER (ORDER BY {_u13('md5(scenario_id)')}, scenario_id) - 1 AS idx, count(*) OVER () AS n FROM ({ids}))"
    return f"""(SELECT replicate, i.scenario_id, m FROM (SELECT replicate, CAST(floor({_u13("md5('42|' || replicate || '|' || idx)")} * n) AS BIGINT) AS drawn, count(*) AS m
      FROM {idx}, range({n}) r(replicate) GROUP BY ALL) d JOIN {idx} i ON d.drawn = i.idx)"""


def effect(split: str, rlong: str = "rlong") -> str:
    """Training and evaluation effects with their resampled interval."""
    draws = draws_of(f"SELECT DISTINCT scenario_id FROM {rlong} WHERE split = '{split}'")
    boot = f"(SELECT replicate, feature_name, res_e, res_c, w, m FROM {rlong} r JOIN {draws} d ON r.scenario_id = d.scenario_id)"
    return f"""
SELECT t.feature_name, t.rho AS train, e.rho AS point, mean, lo, hi, p FROM ({spear('feature_name', 'res_e', 'res_c', f"(SELECT * FROM {rlong} WHERE split = 'train')", w='w0')}) t
JOIN ({spear('feature_name', 'res_e', 'res_c', f"(SELECT * FROM {rlong} WHERE split = '{split}')", w='w0')}) e ON t.feature_name = e.feature_name
JOIN (SELECT feature_name, avg(rho) AS mean, quantile_cont(rho, 0.025) AS lo, quantile_cont(rho, 0.975) AS hi,
        least((2 * least(count(*) FILTER (WHERE rho <= 0), count(*) FILTER (WHERE rho >= 0)) + 1) / (count(*) + 1), 1.0) AS p
      FROM (SELECT * REPLACE (round(rho, 12) AS rho) FROM ({spear('replicate, feature_name', 'res_e', 'res_c', boot, w='w0', f='m')})) GROUP BY 1) b ON t.feature_name = b.feature_name"""


add_cte("eff_val", ["rlong"], effect("internal_val"))
add_cte("eff_hold", ["rlong"], effect("internal_holdout"))
_TIER = """CASE WHEN feature_name <> 'n_lines' THEN 'EXCLUDED_MEASUREMENT_LIMITATION' WHEN sign(train) <> sign(point) THEN 'DISCORDANT' WHEN lo * hi <= 0 THEN 'UNSUPPORTED'
  WHEN abs(point) >= 0.03 THEN 'CORE_CANDIDATE' ELSE 'CONTEXT_CANDIDATE' END"""
SQL["conditional_effect"] = query(f"""
SELECT feature_name, feature_name = 'n_lines' AS primary_eligible, {r6('train', 'train_conditional_effect')}, {r6('point', 'val_conditional_effect')}, {r6('mean', 'bootstrap_mean')}, {r6('lo', 'ci_lower_95')}, {r6('hi', 'ci_upper_95')},
  {r6('p', 'p_value_empirical_bootstrap')}, lo * hi > 0 AS ci_excludes_zero, sign(train) = sign(point) AS train_val_sign_concordant, point BETWEEN lo - 1e-12 AND hi + 1e-12 AS point_inside_ci, {_TIER} AS frame_validity_tier FROM eff_val""", "eff_val")
SQL["feature_confirmation"] = query(f"""
SELECT v.feature_name, {r6('v.point', 'dev_conditional_effect')}, dev_validity_tier, {r6('h.point', 'holdout_conditional_effect')}, {r6('h.lo', 'ci_lower_95')}, {r6('h.hi', 'ci_upper_95')}, h.lo * h.hi > 0 AS ci_excludes_zero,
  sign(v.point) = sign(h.point) AS dev_holdout_sign_concordant, CASE WHEN sign(v.point) = sign(h.point) AND h.lo * h.hi > 0 AND dev_validity_tier IN ('CORE_CANDIDATE', 'CONTEXT_CANDIDATE') THEN 'CONFIRMED'
  WHEN sign(v.point) = sign(h.point) THEN 'DIRECTION_CONFIRMED' ELSE 'UNCONFIRMED' END AS confirmed_status
FROM (SELECT *, {_TIER} AS dev_validity_tier FROM eff_val) v JOIN eff_hold h ON v.feature_name = h.feature_name""", "eff_val", "eff_hold")


_ci = lambda v: f"""avg({v}) AS mean, quantile_cont({v}, 0.025) AS lo, quantile_cont({v}, 0.975) AS hi,
  least((2 * least(count(*) FILTER (WHERE {v} <= 0), count(*) FILTER (WHERE {v} >= 0)) + 1) / (count(*) + 1), 1.0) AS p, count(*) AS n"""
add_cte("pk_draws", ["pk"], f"SELECT * FROM {draws_of('SELECT DISTINCT scenario_id FROM pk', 1000)} q")
add_cte("pk_boot", ["pk", "pk_draws"], "SELECT replicate, m, pk.* FROM pk_draws d JOIN pk ON d.scenario_id = pk.scenario_id")
SQL["correlation_intervals"] = query(" UNION ALL ".join(f"""
SELECT '{c}' AS score, '{k}' AS kpi, {r6('mean')}, {r6('lo', 'ci_lower')}, {r6('hi', 'ci_upper')}, {r6('p', 'p_value')}, n AS n_replicates
FROM (SELECT {_ci('rho')} FROM ({spear('replicate', c, k, 'pk_boot', f='m')}))""" for c in _CMP for k in _RESP), "pk_boot")

add_cte("vs_boot", ["versus"], f"SELECT replicate, m, v.* FROM {draws_of('SELECT DISTINCT scenario_id FROM versus', 1000)} d JOIN versus v ON d.scenario_id = v.scenario_id")
_tops = ", ".join(f"CASE WHEN count(*) >= {k} THEN count(*) FILTER (WHERE a <= {k} AND b <= {k}) / {k}.0 END AS top_{k}_overlap" for k in (10, 20, 50))
SQL["robustness_suite"] = query(f"""
SELECT r.experiment, {r6('rho', 'spearman', 4)}, r.n AS n_scenarios, {r6('tau', 'kendall', 4)}, {r6('lo', 'ci_lower', 4)}, {r6('hi', 'ci_upper', 4)}, {r6('mean', 'boot_mean', 4)}, {', '.join(r6(f'top_{k}_overlap', f'top_{k}_overlap', 4) for k in (10, 20, 50))} FROM ({spear('experiment', 'ref_peak', 'peak', 'versus')}) r
JOIN (SELECT x.experiment, sum(sign(x.ref_peak - y.ref_peak) * sign(x.peak - y.peak)) / sqrt(count(*) FILTER (WHERE x.ref_peak <> y.ref_peak)::DOUBLE * count(*) FILTER (WHERE x.peak <> y.peak)) AS tau
      FROM versus x JOIN versus y ON x.experiment = y.experiment AND x.scenario_id < y.scenario_id GROUP BY 1) k ON r.experiment = k.experiment
JOIN (SELECT experiment, {_ci('rho')} FROM ({spear('replicate, experiment', 'ref_peak', 'peak', 'vs_boot', f='m')}) GROUP BY 1) b ON r.experiment = b.experiment
JOIN (SELECT experiment, {_tops} FROM (SELECT experiment, row_number() OVER (PARTITION BY experiment ORDER BY ref_peak DESC, scenario_id) AS a,
        row_number() OVER (PARTITION BY experiment ORDER BY peak DESC, scenario_id) AS b FROM versus) GROUP BY 1) t ON r.experiment = t.experiment""", "versus", "vs_boot")

# Scenario grain: means of control and features against two profile targets.
add_cte("sm", ["rin"], "SELECT scenario_id, split, avg(gap_m) AS gap_m, avg(n_lines) AS n_lines, avg(p_base) AS p_base, max(p_full) AS top, avg(p_full) AS level FROM rin GROUP BY ALL")
_S4 = ["n_lines", "p_base", "top", "level"]
add_cte("sfit", ["sm"], "SELECT " + ", ".join(f"""
  (sum(gap_m * {t}) - sum(gap_m) * sum({t}) / count(*)) / (sum(gap_m * gap_m) - sum(gap_m) * sum(gap_m) / count(*) + 1.0) AS b_{t}, avg({t}) AS m_{t}""" for t in _S4) + ", avg(gap_m) AS m_x FROM sm WHERE split = 'train'")
add_cte("sres", ["sm", "sfit"], "SELECT sm.scenario_id, split, 1.0 AS w, " + ", ".join(f"{t} - (m_{t} - b_{t} * m_x + b_{t} * gap_m) AS res_{t}" for t in _S4) + " FROM sm, sfit")
for _t in ("top", "level"):
    add_cte(f"slong_{_t}", ["sres"], f"""SELECT scenario_id, split, w, 'n_lines' AS feature_name, res_n_lines AS res_e, res_{_t} AS res_c FROM sres
UNION ALL SELECT scenario_id, split, w, 'p_base', res_p_base, res_{_t} FROM sres""")
    add_cte(f"seff_{_t}", [f"slong_{_t}"], effect("internal_val", f"slong_{_t}"))
_TIER2 = "CASE WHEN sign(train) <> sign(point) THEN 'DISCORDANT' WHEN lo * hi <= 0 THEN 'UNSUPPORTED' WHEN abs(point) >= 0.03 THEN 'CORE_CANDIDATE' ELSE 'CONTEXT_CANDIDATE' END"
SQL["scenario_association"] = query(" UNION ALL ".join(f"""
SELECT feature_name, TRUE AS primary_eligible, {r6('train', 'train_conditional_effect')}, {r6('point', 'val_conditional_effect')}, {r6('mean', 'bootstrap_mean')}, {r6('lo', 'ci_lower_95')}, {r6('hi', 'ci_upper_95')},
  {r6('p', 'p_value_empirical_bootstrap')}, lo * hi > 0 AS ci_excludes_zero, sign(train) = sign(point) AS train_val_sign_concordant, point BETWEEN lo - 1e-12 AND hi + 1e-12 AS point_inside_ci, {_TIER2} AS frame_validity_tier, '{t}' AS profile_target FROM seff_{t}"""
    for t in ("top", "level")), "seff_top", "seff_level")
SQL["cross_level_class"] = query(f"""
SELECT f.feature_name, {r6('f.point', 'frame_effect')}, f.lo * f.hi > 0 AS frame_sig, {r6('s.point', 'scenario_effect')}, s.lo * s.hi > 0 AS scenario_sig,
  CASE WHEN sign(f.point) <> sign(s.point) AND abs(f.point) > 0.02 AND abs(s.point) > 0.02 THEN 'DISCORDANT_SIGN' WHEN f.lo * f.hi > 0 AND s.lo * s.hi > 0 THEN 'CROSS_LEVEL_STABLE' WHEN f.lo * f.hi > 0 THEN 'FRAME_LOCAL'
  WHEN s.lo * s.hi > 0 THEN 'TEMPORAL_EXPOSURE_SPECIFIC' ELSE 'UNSUPPORTED_BOTH' END AS cross_level_classification FROM eff_val f JOIN seff_top s ON f.feature_name = s.feature_name""", "eff_val", "seff_top")
