"""Catalog: risk diagnostics, calibration, robustness, validity and conditional association."""
from pyspark.sql import functions as F

from nearmiss.operators import censored as CN, diagnostics as D, linear as L, ranking as RK, resample as RS, robustness as RB, validity as V
from nearmiss.operators.frames import scene_criticality
from nearmiss.operators.kpi import response_kpis
from nearmiss.operators.pairs import frame_presence
from nearmiss.operators.profile import scenario_profile
from nearmiss.operators.splits import assign_split
from nearmiss.plans.catalog import query, rounded
from nearmiss.plans.statistics import FULL, weighted
from nearmiss.session import durable
from nearmiss.sources.fixture import predictions, states


def curves(spark, sf_dir):
    return D.risk_curve(predictions(spark, sf_dir))


@query
def risk_curve(spark, sf_dir):
    return rounded(curves(spark, sf_dir).select("scenario_id", "time_index", "timestamp_rel", "Rt", "St"))


@query
def hysteresis_events(spark, sf_dir):
    return rounded(D.hysteresis_events(curves(spark, sf_dir)).drop("event"))


@query
def diagnostic_vector(spark, sf_dir):
    return rounded(D.diagnostic_vector(curves(spark, sf_dir)))


@query
def tau_calibration(spark, sf_dir):
    return rounded(D.tau_calibration(predictions(spark, sf_dir)))


@query
def pit_histogram(spark, sf_dir):
    return rounded(D.pit_histogram(predictions(spark, sf_dir)))


@query
def quantile_coverage(spark, sf_dir):
    return rounded(D.quantile_coverage(predictions(spark, sf_dir)))


@query
def stratified_gate(spark, sf_dir):
    df = predictions(spark, sf_dir)
    early = F.when(F.col("time_index") <= 45, "early").otherwise("late")
    wide = F.when(F.col("pred_sigma") > 0.9, "wide").otherwise("narrow")
    return rounded(D.stratified_gate(df, {"phase": early, "spread": wide}))


@query
def censored_nll(spark, sf_dir):
    """Event / censored NLL by split, log-normal with Jacobian and the Gaussian form."""
    c = F.col
    df = assign_split(predictions(spark, sf_dir)).filter(c("exposure_flag") == 1)
    cens = c("target_status") != "event"
    full = CN.with_nll(df, c("y_log_ttc"), F.lit(2.302585092994046), cens, c("pred_mu"), c("pred_sigma"))
    plain = CN.with_gaussian_nll(df, c("y_log_ttc"), ~cens, c("pred_mu"), c("pred_sigma"))
    a = CN.nll_components(full, ["split"], "nll", cens).withColumn("form", F.lit("ttc_scale"))
    b = CN.nll_components(plain, ["split"], "nll", cens).withColumn("form", F.lit("log_scale"))
    return rounded(a.unionByName(b))


@query
def subsample_hz(spark, sf_dir):
    df = predictions(spark, sf_dir)
    five, two = (RB.subsample_hz(df, hz).groupBy("scenario_id").agg(F.count("*").alias(n), F.max("time_index").alias(f"last_{n}"))
                 for hz, n in ((5.0, "n_5hz"), (2.0, "n_2hz")))
    return rounded(five.join(two, "scenario_id"))


@query
def frame_dropout(spark, sf_dir):
    return rounded(RB.frame_dropout(predictions(spark, sf_dir), 0.10).select("scenario_id", "time_index"))


@query
def threshold_from_quantile(spark, sf_dir):
    return rounded(RB.threshold_from_quantile(curves(spark, sf_dir), [0.90, 0.95, 0.99]))


def vectors(spark, sf_dir):
    return RB.experiment_vectors(predictions(spark, sf_dir))


@query
def ref_vs_perturbed(spark, sf_dir):
    both = RB.ref_vs_perturbed(durable(vectors(spark, sf_dir)))
    return rounded(both.select("experiment", "scenario_id", "peak", "ref_peak", "event_count", "ref_event_count"), 4)


@query
def component_relative_error(spark, sf_dir):
    return rounded(RB.component_relative_error(durable(RB.ref_vs_perturbed(durable(vectors(spark, sf_dir))))), 4)


@query
def icc_2_1(spark, sf_dir):
    return rounded(RB.icc_2_1(durable(vectors(spark, sf_dir)), "peak"), 4)


@query
def robustness_suite(spark, sf_dir):
    return rounded(RB.robustness_suite(predictions(spark, sf_dir), n_boot=FULL), 4)


def scored_kpis(spark, sf_dir):
    """Profile components next to response indicators, per scenario."""
    s = states(spark, sf_dir)
    presence = durable(frame_presence(s))
    frames = durable(scene_criticality(s, presence))
    both = scenario_profile(frames).join(response_kpis(presence, frames), "scenario_id")
    # Sums of equal parts must tie in the ranks whatever the order of addition.
    return durable(rounded(both, 9))


COMPONENTS = ["criticality_peak", "criticality_auc_s", "tet_3s_s"]
RESPONSE = [k for k, _, _ in V.KPI_REGISTRY]


@query
def score_vectors(spark, sf_dir):
    c = durable(curves(spark, sf_dir))
    return rounded(V.score_vectors(D.diagnostic_vector(c), c), 4)


@query
def correlation_matrix(spark, sf_dir):
    return rounded(V.correlation_matrix(scored_kpis(spark, sf_dir), COMPONENTS, RESPONSE))


@query
def correlation_intervals(spark, sf_dir):
    return rounded(V.correlation_intervals(scored_kpis(spark, sf_dir), COMPONENTS, RESPONSE, n_boot=FULL))


@query
def scenario_association_unadjusted(spark, sf_dir):
    return rounded(V.associations(scored_kpis(spark, sf_dir), RESPONSE, COMPONENTS))


@query
def kpi_direction(spark, sf_dir):
    return rounded(V.kpi_direction(scored_kpis(spark, sf_dir)))


@query
def tau_rank_stability(spark, sf_dir):
    return rounded(V.tau_rank_stability(scored_kpis(spark, sf_dir)))


@query
def top_fraction_overlap(spark, sf_dir):
    return rounded(V.top_fraction_overlap(scored_kpis(spark, sf_dir)))


@query
def known_groups(spark, sf_dir):
    return rounded(V.known_groups(scored_kpis(spark, sf_dir), RESPONSE), 5)


@query
def event_discrimination(spark, sf_dir):
    return rounded(V.event_discrimination(scored_kpis(spark, sf_dir), "criticality_auc_s", "kpi__sdc_hard_decel_p95"))


def ridge_input(spark, sf_dir):
    return durable(assign_split(weighted(spark, sf_dir)).withColumn("n_lines", F.col("n_lines").cast("double")))


FEATURES = ["n_lines", "p_base"]


@query
def ridge_residual(spark, sf_dir):
    df = ridge_input(spark, sf_dir)
    fits = L.ridge_fits(df.filter("split = 'train'"), ["gap_m"], [*FEATURES, "p_full"], weight="weight")
    return rounded(df.filter("split = 'internal_val'").select("scenario_id", "time_index", *[fits[t].residual().alias(f"res_{t}") for t in [*FEATURES, "p_full"]]))


def effects(spark, sf_dir, split):
    df = ridge_input(spark, sf_dir)
    return L.conditional_effects(df.filter("split = 'train'"), df.filter(F.col("split") == split), ["gap_m"], FEATURES, "p_full",
                                 weight="weight", primary=FEATURES[:1], n_boot=FULL)


@query
def conditional_effect(spark, sf_dir):
    return rounded(effects(spark, sf_dir, "internal_val"))


@query
def feature_confirmation(spark, sf_dir):
    return rounded(L.feature_confirmation(effects(spark, sf_dir, "internal_val"), effects(spark, sf_dir, "internal_holdout")))


@query
def scenario_association(spark, sf_dir):
    df = ridge_input(spark, sf_dir)
    prof = assign_split(df.groupBy("scenario_id").agg(F.max("p_full").alias("top"), F.avg("p_full").alias("level")))
    return rounded(L.scenario_association(df, prof, ["gap_m"], FEATURES, ("top", "level"), n_boot=FULL))


@query
def cross_level_class(spark, sf_dir):
    df = ridge_input(spark, sf_dir)
    prof = assign_split(df.groupBy("scenario_id").agg(F.max("p_full").alias("top")))
    scen = L.scenario_association(df, prof, ["gap_m"], FEATURES, ("top",), n_boot=FULL)
    pick = lambda d: d.select("feature_name", F.col("val_conditional_effect").alias("effect"), "ci_excludes_zero")
    return rounded(L.cross_level_class(pick(effects(spark, sf_dir, "internal_val")), pick(scen)))
