"""Construct validity of scenario scores against indicators."""
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nearmiss.operators import ranking as RK, resample as RS
from nearmiss.session import durable

# Indicator, category, expected direction.
KPI_REGISTRY = [
    ("kpi__radial_closing_decel_proxy_max", "Convergent Shared-Input Proxy", "positive"),
    ("kpi__sdc_hard_decel_p95", "Vehicle-Response Hard Decel", "positive"),
    ("kpi__sdc_min_longitudinal_accel", "Vehicle-Response Min Accel", "negative"),
    ("kpi__sdc_abs_jerk_p95", "Vehicle-Response Jerk Stability", "positive"),
    ("kpi__sdc_abs_yaw_rate_p95", "Vehicle-Response Yaw Rate Stability", "positive"),
    ("kpi__sdc_lateral_accel_p95", "Vehicle-Response Lateral Accel", "positive"),
]


def score_vectors(vectors: DataFrame, curves: DataFrame) -> DataFrame:
    """Peak risk, longest event and mean surprise per scenario."""
    tail = curves.groupBy("scenario_id").agg(F.avg("St").alias("Ds_tail"))
    return vectors.select("scenario_id", F.col("peak").alias("Ds_risk"), F.col("max_event_duration").alias("Bs_response")).join(tail, "scenario_id", "left")


def _crossed(df: DataFrame, left: list, right: list, keep: list, names=("score", "kpi")) -> DataFrame:
    """One row per (row, score, kpi): a fixed number of column pairs, no join."""
    cells = [F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
             for a in left for b in right]
    return df.select(*keep, F.inline(F.array(*cells))).filter("x is not null and y is not null")


def correlation_matrix(df: DataFrame, scores: list, kpis: list, *, keys=(), kendall: bool = True, min_n: int = 3) -> DataFrame:
    """Spearman and Kendall for every score x indicator; NULL below min_n complete rows."""
    keys = [*keys, "score", "kpi"]
    long = durable(_crossed(df, scores, kpis, ["scenario_id", *keys[:-2]]))
    out = RK.spearman(long, keys, "x", "y").withColumnRenamed("rho", "spearman")
    if kendall:
        out = out.join(RK.kendall_tau_b(long, keys, "x", "y").drop("n"), keys).withColumnRenamed("tau", "kendall")
    return out.withColumns({c: F.when(F.col("n") >= min_n, F.col(c)) for c in ("spearman", "kendall") if c in out.columns}).withColumnRenamed("n", "n_valid")


def correlation_intervals(df: DataFrame, scores: list, kpis: list, *, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    long = durable(_crossed(df, scores, kpis, ["scenario_id"]))
    draws = RS.bootstrap_draws(df, n_boot=n_boot, seed=seed)
    reps = RS.bootstrap_spearman(long, ["score", "kpi"], "x", "y", draws)
    return RS.percentile_interval(reps, ["score", "kpi"], "rho")


@F.pandas_udf(T.DoubleType())
def _t_two_sided(rho, n):
    """Two-sided p of a rank correlation from Student's t; one small row per test."""
    import math

    def beta_cf(a, b, x):
        c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
        h = d
        for m in range(1, 500):
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            h *= d * c
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    def p_value(r, k):
        if r is None or k is None or k < 3 or r != r:
            return None
        if abs(r) >= 1.0 or r == 0.0:
            return float(r == 0.0)
        df = k - 2.0
        x = df / (df + r * r * df / (1.0 - r * r))
        a, b = df / 2.0, 0.5
        log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
        if x < (a + 1.0) / (a + b + 2.0):
            return min(1.0, math.exp(log_front) * beta_cf(a, b, x) / a)
        return max(0.0, 1.0 - math.exp(log_front) * beta_cf(b, a, 1.0 - x) / b)

    import pandas as pd
    return pd.Series([p_value(None if r is None or r != r else float(r), None if k is None else float(k)) for r, k in zip(rho, n)], dtype="float64")


def spearman_p(rho: Column, n: Column) -> Column:
    return _t_two_sided(rho.cast("double"), n.cast("double"))


def associations(df: DataFrame, features: list, components: list, *, min_n: int = 20) -> DataFrame:
    """Unadjusted rank associations with p-values and FDR, for pairs with enough complete rows."""
    m = correlation_matrix(df, features, components, kendall=False, min_n=min_n + 1).filter("spearman is not null")
    m = m.withColumn("p_value", spearman_p(F.col("spearman"), F.col("n_valid"))).withColumn("test", F.concat_ws("|", "score", "kpi"))
    return RS.bh_fdr(m, "p_value", name="test").drop("test")


def kpi_direction(df: DataFrame, component: str = "criticality_peak", registry=KPI_REGISTRY) -> DataFrame:
    """Sign of each rank association against the expected one."""
    names = [k for k, _, _ in registry]
    m = correlation_matrix(df, [component], names, kendall=False)
    expected = df.sparkSession.createDataFrame(registry, "kpi string, category string, expected_direction string")
    out = m.join(F.broadcast(expected), "kpi")
    sign = F.when(F.col("spearman") > 0, "positive").when(F.col("spearman") < 0, "negative")
    return out.withColumn("direction_concordant", F.coalesce(sign == F.col("expected_direction"), F.lit(False)))


def tau_rank_stability(profile: DataFrame) -> DataFrame:
    return RK.spearman(_crossed(profile, ["tet_1s_s", "tet_2s_s", "tet_5s_s"], ["tet_3s_s"], []), ["score", "kpi"], "x", "y")


def top_fraction_overlap(profile: DataFrame, fractions=(0.01, 0.05, 0.10), least: int = 5) -> DataFrame:
    """Overlap of the top scenarios by peak, integrated severity and time exposed, at least 5."""
    n = profile.count()
    ks = [max(least, int(n * f)) for f in fractions]
    ab = RK.top_k_overlap(profile, profile, "criticality_peak", "criticality_auc_s", sorted(set(ks)))
    bc = RK.top_k_overlap(profile, profile, "criticality_auc_s", "tet_3s_s", sorted(set(ks)))
    both = ab.select("k", F.col("overlap").alias("overlap_peak_vs_auc")).join(bc.select("k", F.col("overlap").alias("overlap_auc_vs_tet3")), "k")
    rows = profile.sparkSession.createDataFrame([(f, k) for f, k in zip(fractions, ks)], "top_k_fraction double, k long")
    return rows.join(both, "k").select("top_k_fraction", "k", "overlap_peak_vs_auc", "overlap_auc_vs_tet3")


def known_groups(df: DataFrame, kpis: list, by: str = "criticality_peak") -> DataFrame:
    """Indicator means of the top and bottom quartile, their difference and Cohen's d."""
    q = RK.exact_quantiles(df, [], by, [0.25, 0.75])
    cut = q.agg(F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("lo"), F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("hi")).first()
    long = df.select(F.col(by).alias("by"), F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("v")) for k in kpis])))
    top, low = F.when(F.col("by") >= cut["hi"], F.col("v")), F.when(F.col("by") <= cut["lo"], F.col("v"))
    out = long.groupBy("kpi").agg(F.avg(top).alias("top_quartile_mean"), F.avg(low).alias("bottom_quartile_mean"),
                                  F.var_samp(top).alias("va"), F.var_samp(low).alias("vb"), F.count(top).alias("na"), F.count(low).alias("nb"))
    diff = F.col("top_quartile_mean") - F.col("bottom_quartile_mean")
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / F.greatest(F.col("na") + F.col("nb") - 2, F.lit(1)))
    return out.select("kpi", "top_quartile_mean", "bottom_quartile_mean", diff.alias("difference"),
                      F.when(pooled > 0, diff / F.greatest(pooled, F.lit(1e-300))).alias("cohens_d"))


def event_discrimination(df: DataFrame, score: str, kpi: str, fprs=(0.05, 0.10)) -> DataFrame:
    """Sensitivity for top-quintile indicator values at fixed false-positive rates; empty below 10 rows."""
    rows = durable(df.select(F.col(score).cast("double").alias("x"), F.col(kpi).cast("double").alias("k")).filter("x is not null and k is not null"))
    cut = RK.exact_quantiles(rows, [], "k", [0.8]).first()
    if cut is None or rows.count() < 10:
        return df.sparkSession.createDataFrame([], "fpr double, sensitivity double, score_threshold double, n_events long, n_non_events long")
    rows = rows.withColumn("event", F.col("k") >= cut["quantile"])
    n_neg = rows.filter(~F.col("event")).count()
    negatives = RK.prefix_sums(rows.filter(~F.col("event")).withColumn("desc", -F.col("x")), [], "desc", {"n": F.lit(1.0)})
    out = []
    for fpr in fprs:
        n_fp = int(fpr * n_neg)
        if 0 < n_fp < n_neg:
            at = negatives.filter((F.col("n_before") < n_fp) & (F.col("n_before") + F.col("n") >= n_fp)).select(-F.col("desc")).first()[0]
        else:
            at = RK.exact_quantiles(rows, [], "x", [1 - fpr]).first()["quantile"]
        out.append((float(fpr), float(at)))
    level = F.explode(F.array(*[F.struct(F.lit(f).alias("fpr"), F.lit(t).alias("t")) for f, t in out]))
    hit = rows.withColumn("l", level)
    return hit.groupBy(F.col("l.fpr").alias("fpr"), F.col("l.t").alias("score_threshold")).agg(
        (F.count_if(F.col("event") & (F.col("x") >= F.col("l.t"))) / F.greatest(F.count_if("event"), F.lit(1))).alias("sensitivity"),
        F.count_if("event").alias("n_events"), F.count_if(~F.col("event")).alias("n_non_events"))
