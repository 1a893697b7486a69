"""Risk curves, hysteresis events and per-scenario diagnostic vectors.

Every function takes the grouping `keys` (scenario, or experiment and
scenario); thresholds may be columns, so several settings run in one pass.
A group is one scenario's frames, at most one row per frame.
"""
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.constants import CONTACT_TOL, QUANTILE_LEVELS, T_MIN_S, TAU_LEVELS
from nearmiss.functions import normal as N
from nearmiss.functions.columns import flag

DEFAULTS = {"theta_on": 0.7, "theta_off": 0.3, "merge_gap_s": 0.5, "min_duration_s": 0.3, "hold_s": 0.5, "tau": 3.0, "epsilon": 1e-12}
KEYS = ["scenario_id"]
COMPONENTS = ["peak", "exceedance_duration", "event_count", "max_event_duration", "recovery_time", "predictive_uncertainty"]


def exceedance_z(mu: Column, sigma: Column, tau: float) -> Column:
    """z of P(TTC <= tau) under a log-normal prediction; tau is floored at 0.05 s."""
    return (F.lit(math.log(max(tau, T_MIN_S))) - mu) / F.greatest(sigma, F.lit(1e-12))


def risk_curve(pred: DataFrame, *, keys=KEYS, tau: float = 3.0, epsilon: float = 1e-12) -> DataFrame:
    """R_t, S_t and time from the start of the scenario."""
    c = F.col
    w = W.partitionBy(*keys).orderBy("time_index")
    if "timestamp_seconds" not in pred.columns:
        pred = pred.withColumn("timestamp_seconds", F.lit(None).cast("double"))
    clock = c("timestamp_seconds") - F.first("timestamp_seconds").over(w)
    pred = N.with_normal(pred, exceedance_z(c("pred_mu"), c("pred_sigma"), tau), p_tau="cdf")
    pred = N.with_normal(pred, (c("y_log_ttc") - c("pred_mu")) / F.greatest(c("pred_sigma"), F.lit(1e-12)), p_obs="cdf")
    scored = (c("exposure_flag") == 1) & (c("target_status") == "event") & c("y_log_ttc").isNotNull()
    return pred.withColumns({
        "timestamp_rel": F.coalesce(clock, c("time_index") * F.lit(0.1)),
        "Rt": c("pred_p_exposure") * c("p_tau"),
        "St": F.when(scored, -F.log(F.greatest(c("p_obs"), F.lit(epsilon))))}).drop("p_tau", "p_obs")


def _with_thresholds(curve: DataFrame, on: float, off: float) -> DataFrame:
    missing = {n: F.lit(v) for n, v in (("theta_on", on), ("theta_off", off)) if n not in curve.columns}
    return curve.withColumns(missing) if missing else curve


def hysteresis_events(curve: DataFrame, *, keys=KEYS, theta_on=0.7, theta_off=0.3, merge_gap_s=0.5, min_duration_s=0.3) -> DataFrame:
    """Events that start at R >= on, end at the first R < off, merged over short gaps.

    Between the thresholds a frame keeps the state of the last crossing.
    """
    c = F.col
    curve = _with_thresholds(curve, theta_on, theta_off)
    w = W.partitionBy(*keys).orderBy("time_index")
    past = w.rowsBetween(W.unboundedPreceding, 0)
    crossing = F.when(c("Rt") >= c("theta_on"), F.lit(True)).when(c("Rt") < c("theta_off"), F.lit(False))
    rows = curve.withColumn("inside", F.coalesce(F.last(crossing, True).over(past), F.lit(False)))
    starts = c("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False))
    rows = rows.withColumns({"event": F.sum(starts.cast("int")).over(past),
                             "until": F.coalesce(F.lead("timestamp_rel").over(w), c("timestamp_rel"))})
    raw = rows.filter("inside").groupBy(*keys, "event").agg(F.min("timestamp_rel").alias("start_s"), F.max("until").alias("end_s"))
    order = W.partitionBy(*keys).orderBy("start_s")
    fresh = F.coalesce(c("start_s") - F.lag("end_s").over(order) > merge_gap_s, F.lit(True)).cast("int")
    merged = raw.withColumn("fresh", fresh).withColumn("event", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return (merged.groupBy(*keys, "event").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
            .withColumn("duration_s", c("end_s") - c("start_s")).filter(c("duration_s") >= min_duration_s))


def hold_recovery(curve: DataFrame, events: DataFrame, *, keys=KEYS, theta_off=0.3, hold_s=0.5) -> DataFrame:
    """Time from the end of the last event to the first hold below theta_off; censored at the end."""
    c = F.col
    curve = _with_thresholds(curve, 0.7, theta_off)
    w = W.partitionBy(*keys).orderBy("time_index")
    last = events.groupBy(*keys).agg(F.max("end_s").alias("end_s"))
    rows = curve.select(*keys, "time_index", "timestamp_rel", "Rt", "theta_off").join(last, keys)
    after = rows.filter(c("timestamp_rel") > c("end_s")).withColumn("low", flag(c("Rt") < c("theta_off")))
    after = after.withColumn("resets", F.sum((~c("low")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    since = F.min(F.when(c("low"), c("timestamp_rel"))).over(W.partitionBy(*keys, "resets"))
    held = c("low") & (c("timestamp_rel") - c("since") >= hold_s)
    per = after.withColumn("since", since).groupBy(*keys).agg(
        F.min(F.when(held, c("timestamp_rel"))).alias("held_s"), F.max("timestamp_rel").alias("last_s"))
    out = last.join(per, keys, "left")
    return out.select(*keys, F.coalesce(F.coalesce("held_s", "last_s") - c("end_s"), F.lit(0.0)).alias("recovery_time"),
                      c("held_s").isNull().alias("recovery_censored"))


def diagnostic_vector(curve: DataFrame, *, keys=KEYS, theta_on=0.7, theta_off=0.3, merge_gap_s=0.5, min_duration_s=0.3, hold_s=0.5) -> DataFrame:
    """Six components plus log-sum and mean risk, one row per scenario."""
    c = F.col
    curve = _with_thresholds(curve, theta_on, theta_off)
    w = W.partitionBy(*keys).orderBy("time_index")
    events = hysteresis_events(curve, keys=keys, merge_gap_s=merge_gap_s, min_duration_s=min_duration_s)
    step = c("timestamp_rel") - F.lag("timestamp_rel").over(w)
    width = N.quantile(0.9) - N.quantile(0.1)
    base = curve.withColumn("step", step).groupBy(*keys).agg(
        F.max("Rt").alias("peak"), F.coalesce(F.sum(F.when(c("Rt") >= c("theta_on"), c("step"))), F.lit(0.0)).alias("exceedance_duration"),
        (F.avg("pred_sigma") * F.lit(width)).alias("predictive_uncertainty"),
        F.log(F.sum(F.when(c("Rt") > 0, c("Rt")).otherwise(F.lit(1e-30)))).alias("lse_score"), F.avg("Rt").alias("mean_Rt"))
    per_event = events.groupBy(*keys).agg(F.count("*").alias("event_count"), F.max("duration_s").alias("max_event_duration"))
    out = base.join(per_event, keys, "left").join(hold_recovery(curve, events, keys=keys, hold_s=hold_s), keys, "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    return out.select(
        *keys, F.round("peak", 6).alias("peak"), F.round("exceedance_duration", 4).alias("exceedance_duration"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"), F.round(zero("max_event_duration"), 4).alias("max_event_duration"),
        F.round(zero("recovery_time"), 4).alias("recovery_time"), F.round("predictive_uncertainty", 6).alias("predictive_uncertainty"),
        F.coalesce("recovery_censored", F.lit(False)).alias("recovery_censored"), F.round("lse_score", 4).alias("lse_score"),
        F.round("mean_Rt", 6).alias("mean_Rt"))


# Calibration of predicted distributions.

def tau_calibration(pred: DataFrame, taus=TAU_LEVELS) -> DataFrame:
    """Observed and predicted P(TTC <= tau) over exposed frames."""
    c = F.col
    level = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.lit(math.log(max(t, T_MIN_S))).alias("log_tau")) for t in taus]))
    rows = pred.filter(c("exposure_flag") == 1).withColumn("t", level)
    rows = N.with_normal(rows, (c("t.log_tau") - c("pred_mu")) / F.greatest(c("pred_sigma"), F.lit(1e-12)), p_tau="cdf")
    p = c("pred_p_exposure") * c("p_tau")
    hit = ((c("target_status") == "event") & (c("y_log_ttc") <= c("t.log_tau") + 1e-9)).cast("double")
    out = rows.groupBy(c("t.tau").alias("tau")).agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("observed_rate"), F.avg(p).alias("predicted_rate"), F.count("*").alias("n_samples"))
    return out.withColumn("absolute_error", F.abs(c("observed_rate") - c("predicted_rate")))


def pit_histogram(pred: DataFrame) -> DataFrame:
    """Ten-bin histograms: F(y) of events and S(y) of censored exposed frames."""
    c = F.col
    z = (c("y_log_ttc") - c("pred_mu")) / F.greatest(c("pred_sigma"), F.lit(1e-12))
    rows = pred.filter((c("exposure_flag") == 1) & c("target_status").isin("event", "right_censored"))
    rows = N.with_normal(rows, z, lower="cdf", upper="sf").withColumns({
        "kind": F.when(c("target_status") == "event", "uncensored_pit").otherwise("censored_pit"),
        "value": F.when(c("target_status") == "event", c("lower")).otherwise(c("upper"))})
    counts = [F.count_if(F.least(F.floor(c("value") * 10), F.lit(9)) == b).alias(f"bin_{b}") for b in range(10)]
    return rows.groupBy("kind").agg(F.count("*").alias("n_samples"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), *counts)


def quantile_coverage(pred: DataFrame, levels=QUANTILE_LEVELS) -> DataFrame:
    """Share of events at or below each predicted quantile."""
    c = F.col
    events = pred.filter((c("exposure_flag") == 1) & (c("target_status") == "event"))
    level = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(N.quantile(q)).alias("z")) for q in levels]))
    rows = events.withColumn("l", level)
    return rows.groupBy(c("l.q").alias("nominal")).agg(
        F.avg((c("y_log_ttc") <= c("pred_mu") + c("pred_sigma") * c("l.z")).cast("double")).alias("actual_coverage"),
        F.count("*").alias("n_events")).withColumn("gap", c("actual_coverage") - c("nominal"))


def stratified_gate(pred: DataFrame, strata: dict) -> DataFrame:
    """Brier score of the exposure probability per stratum {dimension: column}."""
    c = F.col
    rows = pred.withColumn("s", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), col.alias("stratum")) for d, col in strata.items()])))
    y = c("exposure_flag").cast("double")
    return rows.groupBy("s.dimension", "s.stratum").agg(
        F.count("*").alias("n_frames"), F.avg((c("pred_p_exposure") - y) * (c("pred_p_exposure") - y)).alias("brier"), F.avg(y).alias("exposure_rate"))


def conditional_brier(df: DataFrame, mu: Column, sigma: Column, tau: float) -> DataFrame:
    """Brier score of P(TTC <= tau) on the primary risk set; NULL if a row is censored before tau.

    A contact at tau counts also where the rounding of sines and cosines puts it just behind.
    """
    c = F.col
    y = (~c("right_censored") & (c("ttc_obb_swept_s") <= tau + CONTACT_TOL)).cast("double")
    out = N.with_normal(df, exceedance_z(mu, sigma, tau), p_="cdf").withColumn("y_", y).agg(
        F.avg((c("p_") - c("y_")) * (c("p_") - c("y_"))).alias("naive"), F.count("*").alias("n_samples"), F.sum("y_").cast("long").alias("n_events_at_tau"),
        F.count_if("right_censored").alias("n_censored"), F.avg("p_").alias("mean_pred"), F.min("censor_time_s").alias("min_censor"))
    known = F.coalesce(c("min_censor") >= tau, F.lit(True))
    return out.select(F.lit(tau).alias("tau"), F.when(known, c("naive")).alias("brier_score"), "n_samples", "n_events_at_tau", "n_censored",
                      "mean_pred", F.when(known, "naive_binary").otherwise("IPCW_REQUIRED").alias("brier_method"))
