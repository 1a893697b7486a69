"""SQL twins of nearmiss.plans.statistics, with plain global windows and pair joins."""
from oracles import core, tables  # noqa: F401  (define the CTEs used here)
from oracles.base import add_cte, query, r6
from oracles.tables import _hex, _u, SPLIT

SQL = {}
add_cte("score_ids", ["scores"], "SELECT DISTINCT scenario_id FROM scores")
add_cte("score_split", ["score_ids"], f"SELECT scenario_id, {SPLIT.format(u='u')} AS split FROM (SELECT scenario_id, {_u} AS u FROM score_ids)")
add_cte("ws", ["scores", "score_split"], """
SELECT s.*, split, 1.0 / count(*) OVER (PARTITION BY s.scenario_id) AS w FROM scores s JOIN score_split p ON s.scenario_id = p.scenario_id""")
add_cte("stacked", ["ws"], """
SELECT *, 'base' AS model, p_base AS p FROM ws UNION ALL SELECT *, 'full' AS model, p_full AS p FROM ws""")

SQL["scenario_weight"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, {r6('w * (SELECT count(*) / count(DISTINCT scenario_id) FROM ws)', 'weight')} FROM ws""", "ws")


def curve(keys: str, source: str) -> str:
    """Metrics from row-level ordered windows with RANGE frames (ties share a step)."""
    k = keys
    return f"""
SELECT {k}, CASE WHEN min(y) < max(y) THEN sum(w * y * tp / al) / sum(w * y) END AS pr_auc,
  CASE WHEN min(y) < max(y) THEN sum(w * y * (below + 0.5 * tied)) / (sum(w * y) * sum(w * (1 - y))) END AS auroc,
  CASE WHEN min(y) < max(y) THEN max(f1) END AS best_f1, CASE WHEN min(y) < max(y) THEN arg_max(p, (f1, -p)) END AS best_threshold FROM (
SELECT *, 2 * tp / (al + sum(w * y) OVER (PARTITION BY {k})) AS f1 FROM (
SELECT *, sum(w * y) OVER d AS tp, sum(w) OVER d AS al, coalesce(sum(w * (1 - y)) OVER b, 0) AS below,
  sum(w * (1 - y)) OVER (PARTITION BY {k}, p) AS tied FROM {source}
WINDOW d AS (PARTITION BY {k} ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY {k} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND 0.000001 PRECEDING))) GROUP BY {k}"""


def pointwise(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, sum(w * (p - y) * (p - y)) / sum(w) AS brier,
  sum(w * -(y * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, p))))) / sum(w) AS log_loss,
  sum(w * y) / sum(w) AS weighted_prevalence, avg(y) AS prevalence, count(*) AS n FROM {source} GROUP BY {keys}"""


def ece(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, sum(n * abs(o - m)) / sum(n) AS ece FROM (
SELECT {keys}, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS o FROM {source} GROUP BY {keys}, bin) GROUP BY {keys}"""


_CURVE = ["pr_auc", "auroc", "best_f1", "best_threshold"]
_POINT = ["brier", "log_loss", "weighted_prevalence", "prevalence"]
_rs = lambda names: ", ".join(r6(n) for n in names)
SQL["weighted_ap_auroc"] = query(f"SELECT model, split, {_rs(_CURVE)} FROM ({curve('model, split', 'stacked')})", "stacked")
SQL["brier_log_loss"] = query(f"SELECT model, split, {_rs(_POINT)}, n FROM ({pointwise('model, split', 'stacked')})", "stacked")
SQL["calibration_bins"] = query(f"""
SELECT model, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, {r6('avg(p)', 'mean_predicted')}, {r6('avg(y)', 'observed_rate')} FROM stacked GROUP BY 1, 2""", "stacked")
SQL["expected_calibration_error"] = query(f"SELECT model, split, {r6('ece')} FROM ({ece('model, split', 'stacked')})", "stacked")


def full_metrics(keys: str, source: str) -> str:
    on = lambda a: " AND ".join(f"c.{k.strip()} = {a}.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {cols}, {_rs(_CURVE)}, {_rs(_POINT)}, n, {r6('ece')} FROM ({curve(keys, source)}) c
JOIN ({pointwise(keys, source)}) p ON {on('p')} JOIN ({ece(keys, source)}) e ON {on('e')}"""


SQL["per_split_evaluation"] = query(full_metrics("model, split", "stacked"), "stacked")
add_cte("named_signal", ["dynamic_signal"], "SELECT DISTINCT scenario_id, time_index FROM dynamic_signal WHERE signal_state NOT LIKE '%UNKNOWN%'")
add_cte("strata", ["stacked", "named_signal", "targets_log"], """
SELECT s.*, unnest(['traffic', 'distance_band', 'signal', 'object_type']) AS dimension, unnest([
  CASE WHEN n_lines <= (SELECT quantile_cont(n_lines, 0.5) FROM stacked) THEN 'low_traffic' ELSE 'high_traffic' END,
  CASE WHEN gap_m < 20 THEN '0_20m' WHEN gap_m < 40 THEN '20_40m' ELSE '40_70m' END,
  CASE WHEN g.time_index IS NULL THEN 'no_signal' ELSE 'has_signal' END,
  coalesce(target_object_type, 'NO_TARGET')]) AS stratum
FROM stacked s LEFT JOIN named_signal g ON s.scenario_id = g.scenario_id AND s.time_index = g.time_index
LEFT JOIN targets_log t ON s.scenario_id = t.scenario_id AND s.time_index = t.time_index""")
SQL["stratified_metrics"] = query(full_metrics("model, dimension, stratum", "strata"), "strata")

SQL["exact_quantiles"] = query(f"""
SELECT split, q, {r6('v', 'quantile')} FROM (SELECT split, unnest([0.0, 0.025, 0.25, 0.5, 0.8, 0.975, 1.0])::DOUBLE AS q,
  unnest(quantile_cont(gap_m, [0.0, 0.025, 0.25, 0.5, 0.8, 0.975, 1.0])) AS v FROM ws GROUP BY split)""", "ws")

# Average ranks with multiplicity f and moment weight w.
def spear(keys: str, x: str, y: str, source: str, w="1.0", f="1.0") -> str:
    k = f"PARTITION BY {keys}" if keys else ""
    kx = f"PARTITION BY {keys + ',' if keys else ''} {x}"
    ky = f"PARTITION BY {keys + ',' if keys else ''} {y}"
    sel = f"{keys}," if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {sel} (sum(w * rx * ry) / sum(w) - sum(w * rx) / sum(w) * (sum(w * ry) / sum(w)))
  / sqrt((sum(w * rx * rx) / sum(w) - pow(sum(w * rx) / sum(w), 2)) * (sum(w * ry * ry) / sum(w) - pow(sum(w * ry) / sum(w), 2))) AS rho, CAST(sum(f) AS BIGINT) AS n FROM (
SELECT *, sum(f) OVER ({k} ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(f) OVER ({kx}) + (sum(f) OVER ({kx}) + 1) / 2 AS rx,
  sum(f) OVER ({k} ORDER BY {y} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(f) OVER ({ky}) + (sum(f) OVER ({ky}) + 1) / 2 AS ry
FROM (SELECT * EXCLUDE (w, f), w * f AS w, f FROM (SELECT *, {w} AS w, {f} AS f FROM (SELECT {sel} {x}, {y}, {'w AS w0' if 'w0' in w else '1 AS w0'}, {'m' if f == 'm' else '1 AS m'} FROM {source})))) {grp}"""


SQL["spearman"] = query(f"SELECT split, {r6('rho')}, n FROM ({spear('split', 'p_base', 'gap_m', 'ws')})", "ws")
SQL["weighted_spearman"] = query(f"SELECT split, {r6('rho')}, n FROM ({spear('split', 'p_base', 'n_lines', 'ws', w='w0')})", "ws")
add_cte("per_scen", ["ws"], """
SELECT scenario_id, split, max(p_base) AS peak_base, CAST(sum(y) AS BIGINT) AS hits, round(avg(gap_m), 9) AS mean_gap FROM ws GROUP BY 1, 2""")
SQL["kendall_tau_b"] = query(f"""
SELECT split, {r6('CASE WHEN (n0 - n1) * (n0 - n2) > 0 THEN s / sqrt((n0 - n1) * (n0 - n2)) END', 'tau')}, n FROM (
SELECT a.split, sum(sign(a.peak_base - b.peak_base) * sign(a.hits - b.hits)) AS s, count(*) AS n0,
  count(*) FILTER (WHERE a.peak_base = b.peak_base) AS n1, count(*) FILTER (WHERE a.hits = b.hits) AS n2,
  (SELECT count(*) FROM per_scen c WHERE c.split = a.split) AS n
FROM per_scen a JOIN per_scen b ON a.split = b.split AND a.scenario_id < b.scenario_id GROUP BY a.split)""", "per_scen")
_top = lambda s, k: f"(SELECT scenario_id FROM per_scen ORDER BY {s} DESC, scenario_id LIMIT {k})"
SQL["top_k_overlap"] = query(" UNION ALL ".join(f"""
SELECT CAST({k} AS BIGINT) AS k, {r6(f'CASE WHEN (SELECT count(*) FROM per_scen) >= {k} THEN (SELECT count(*) FROM {_top("peak_base", k)} x WHERE scenario_id IN {_top("hits", k)}) / {k}.0 END', 'overlap')}"""
    for k in (10, 20, 50, 100000)), "per_scen")

_u13 = lambda e: f"(CAST({_hex(e, 1, 13)} AS DOUBLE) / 4503599627370496.0)"
add_cte("indexed", ["score_ids"], f"""
SELECT scenario_id, row_number() OVER (ORDER BY {_u13('md5(scenario_id)')}, scenario_id) - 1 AS idx, count(*) OVER () AS n FROM score_ids""")
_draws = lambda n: f"""
SELECT replicate, i.scenario_id, m FROM (SELECT replicate, CAST(floor({_u13("md5('42|' || replicate || '|' || idx)")} * n) AS BIGINT) AS drawn, count(*) AS m
  FROM indexed, range({n}) r(replicate) GROUP BY ALL) d JOIN indexed i ON d.drawn = i.idx"""
add_cte("draws", ["indexed"], _draws(25))
add_cte("draws_full", ["indexed"], _draws(1000))
SQL["bootstrap_draws"] = query("SELECT replicate, scenario_id, m FROM draws_full", "draws_full")

NESTED = {"M_P": "p_base", "M_P_Eall": "p_full", "M_P_Estatic": "(p_base * 3 + p_full) / 4", "M_P_Ecomp": "(p_base + p_full) / 2", "M_P_Einteract": "(p_base + p_full * 3) / 4",
          "M_P_Eall_Ehist": "(p_full * 7 + CAST(n_lines % 5 AS DOUBLE) / 5) / 8"}
PAIRS = [("M_P_Eall", "M_P"), ("M_P_Einteract", "M_P"), ("M_P_Estatic", "M_P"), ("M_P_Ecomp", "M_P"), ("M_P_Eall_Ehist", "M_P_Eall")]
add_cte("nested_mass", ["ws"], "SELECT scenario_id, model, p, sum(w * y) AS pos, sum(w) AS al FROM (" + " UNION ALL ".join(
    f"SELECT scenario_id, '{m}' AS model, {e} AS p, y, w FROM ws" for m, e in NESTED.items()) + ") GROUP BY ALL")
add_cte("boot_steps", ["draws_full", "nested_mass"], """
SELECT replicate, model, p, sum(pos * m) AS pos, sum(al * m) AS al FROM (
  SELECT replicate, model, p, pos, al, m FROM draws_full d JOIN nested_mass s ON d.scenario_id = s.scenario_id
  UNION ALL SELECT -1, model, p, pos, al, 1 FROM nested_mass) GROUP BY ALL""")
add_cte("boot_curves", ["boot_steps"], """
SELECT replicate, model, CASE WHEN sum(pos) > 0 AND sum(al - pos) > 1e-9 THEN sum(pos * tp / ta) / sum(pos) END AS pr_auc,
  CASE WHEN sum(pos) > 0 AND sum(al - pos) > 1e-9 THEN sum(pos * (below + 0.5 * (al - pos))) / (sum(pos) * sum(al - pos)) END AS auroc
FROM (SELECT *, sum(pos) OVER d AS tp, sum(al) OVER d AS ta, coalesce(sum(al - pos) OVER (PARTITION BY replicate, model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM boot_steps WINDOW d AS (PARTITION BY replicate, model ORDER BY p DESC)) GROUP BY 1, 2""")
add_cte("boot_delta", ["boot_curves"], " UNION ALL ".join(
    f"SELECT '{b}_minus_{a}' AS contrast, '{b}' AS model_2, '{a}' AS model_1, x.replicate, round(x.pr_auc - z.pr_auc, 12) AS d, round(x.auroc - z.auroc, 12) AS a "
    f"FROM boot_curves x JOIN boot_curves z ON x.replicate = z.replicate AND x.model = '{b}' AND z.model = '{a}'" for b, a in PAIRS))
SQL["paired_delta_ci"] = query(f"""
SELECT contrast, model_2, model_1, {_rs(['point_delta_pr_auc', 'bootstrap_mean_delta', 'ci_lower_95', 'ci_upper_95', 'p_value_empirical_bootstrap', 'point_delta_auroc', 'auroc_ci_lower_95', 'auroc_ci_upper_95'])},
  ci_lower_95 > 0 AS statistically_significant_positive,
  CASE WHEN point_delta_pr_auc > 0 AND ci_lower_95 > 0 THEN 'SUPPORTED' WHEN point_delta_pr_auc > 0 THEN 'MIXED_POSITIVE' ELSE 'NOT_CONFIRMED' END AS verdict_status
FROM (SELECT contrast, model_2, model_1, max(CASE WHEN replicate < 0 THEN d END) AS point_delta_pr_auc, avg(CASE WHEN replicate >= 0 THEN d END) AS bootstrap_mean_delta,
  quantile_cont(CASE WHEN replicate >= 0 THEN d END, 0.025) AS ci_lower_95, quantile_cont(CASE WHEN replicate >= 0 THEN d END, 0.975) AS ci_upper_95,
  least((2 * least(count(*) FILTER (WHERE replicate >= 0 AND d <= 0), count(*) FILTER (WHERE replicate >= 0 AND d >= 0)) + 1) / (count(d) FILTER (WHERE replicate >= 0) + 1), 1.0) AS p_value_empirical_bootstrap,
  max(CASE WHEN replicate < 0 THEN a END) AS point_delta_auroc, quantile_cont(CASE WHEN replicate >= 0 THEN a END, 0.025) AS auroc_ci_lower_95,
  quantile_cont(CASE WHEN replicate >= 0 THEN a END, 0.975) AS auroc_ci_upper_95 FROM boot_delta GROUP BY 1, 2, 3)""", "boot_delta")

add_cte("nll", ["ws"], """
SELECT scenario_id, avg(-ln(greatest(CASE WHEN y = 1 THEN p_base ELSE 1 - p_base END, 1e-12))) - avg(-ln(greatest(CASE WHEN y = 1 THEN p_full ELSE 1 - p_full END, 1e-12))) AS delta FROM ws GROUP BY 1""")
SQL["paired_nll_ci"] = query(f"""
SELECT {r6('avg(delta)', 'delta_mean')}, count(*) AS n_scenarios, {r6('median(delta)', 'delta_median')},
  {r6('(SELECT quantile_cont(d, 0.025) FROM (SELECT sum(delta * m) / sum(m) AS d FROM draws_full x JOIN nll y ON x.scenario_id = y.scenario_id GROUP BY replicate))', 'ci_lower')},
  {r6('(SELECT quantile_cont(d, 0.975) FROM (SELECT sum(delta * m) / sum(m) AS d FROM draws_full x JOIN nll y ON x.scenario_id = y.scenario_id GROUP BY replicate))', 'ci_upper')} FROM nll""", "nll", "draws_full")
add_cte("boot_scen", ["draws_full", "per_scen"], "SELECT replicate, m, peak_base, mean_gap FROM draws_full d JOIN per_scen s ON d.scenario_id = s.scenario_id")
SQL["bootstrap_correlation_ci"] = query(f"""
SELECT {r6('avg(rho)', 'mean')}, {r6('quantile_cont(rho, 0.025)', 'ci_lower')}, {r6('quantile_cont(rho, 0.975)', 'ci_upper')},
  {r6('least((2 * least(count(*) FILTER (WHERE rho <= 0), count(*) FILTER (WHERE rho >= 0)) + 1) / (count(*) + 1), 1.0)', 'p_value')}, count(*) AS n_replicates
FROM ({spear('replicate', 'peak_base', 'mean_gap', 'boot_scen', f='m')})""", "boot_scen")
add_cte("tests", ["ws"], """
SELECT split || '|' || k AS feature_name, least((2 * least(count(*) FILTER (WHERE d <= 0), count(*) FILTER (WHERE d >= 0)) + 1) / (count(*) + 1), 1.0) AS p
FROM (SELECT split, unnest(['full', 'base']) AS k, unnest([avg(p_full - p_base), avg(y - p_base)]) AS d FROM ws GROUP BY scenario_id, split) GROUP BY 1""")
SQL["bh_fdr"] = query(f"""
SELECT feature_name, {r6('p')}, {r6('least(1.0, min(raw) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'fdr_q')} FROM (
SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature_name) AS raw, row_number() OVER (ORDER BY p, feature_name) AS rk FROM tests)""", "tests")

# Guards, reports and feature sets over the score table.
SQL["split_guard"] = query("""
SELECT k AS split, k NOT IN ('train', 'internal_val') AS refused, count(*) FILTER (WHERE s.split = k AND k IN ('train', 'internal_val')) AS n_rows,
  CAST(sum(y) FILTER (WHERE s.split = k AND k IN ('train', 'internal_val')) AS BIGINT) AS n_positive
FROM ws s, (SELECT unnest(['train', 'internal_val', 'internal_holdout', 'external']) AS k) GROUP BY k""", "ws")
SQL["source_role_guard"] = query("""
SELECT ['training', 'validation', 'testing'][CAST(scenario_id AS INT) % 3 + 1] AS role, bool_or(CAST(scenario_id AS INT) % 3 > 0) AS blocked, count(*) AS n_rows FROM scores GROUP BY 1""", "scores")
SQL["write_reports"] = query(f"""
SELECT split, scenario_id, count(*) AS n_rows, {r6('avg(p_full)', 'mean_p_full')}, format FROM ws, (SELECT unnest(['csv', 'json', 'parquet']) AS format) GROUP BY split, scenario_id, format""", "ws")
SQL["select_feature_set"] = query(f"""
SELECT scenario_id, CAST(time_index AS BIGINT) AS time_index, {r6('gap_m')}, {r6('n_lines')}, {r6('p_base')}, {r6('gap_m * n_lines', 'gap_m__x__n_lines')}, {r6('gap_m * p_base', 'gap_m__x__p_base')} FROM scores""", "scores")
