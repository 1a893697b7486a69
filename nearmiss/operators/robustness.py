"""Temporal robustness: perturbed curves against the original, all experiments in one grouped run."""
from pyspark.sql import DataFrame, Window as W, functions as F

from nearmiss.functions.columns import hex_uniform
from nearmiss.operators import ranking as RK, resample as RS
from nearmiss.operators.diagnostics import COMPONENTS, DEFAULTS, diagnostic_vector, risk_curve
from nearmiss.session import durable

TOP_K = (10, 20, 50)


def subsample_hz(df: DataFrame, target_hz: float, original_hz: float = 10.0) -> DataFrame:
    """Every k-th frame of a scenario by position."""
    step = max(1, round(original_hz / target_hz))
    return df.withColumn("pos", F.row_number().over(W.partitionBy("scenario_id").orderBy("time_index"))).filter((F.col("pos") - 1) % step == 0).drop("pos")


def frame_dropout(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Drop frames by a hash of (seed, scenario, frame); first and last of a scenario stay."""
    u = hex_uniform(F.md5(F.concat_ws("|", F.lit(str(seed)), "scenario_id", "time_index")), 13)
    edge = (F.col("time_index") == F.min("time_index").over(W.partitionBy("scenario_id"))) | (
        F.col("time_index") == F.max("time_index").over(W.partitionBy("scenario_id")))
    return df.withColumns({"u": u, "edge": edge}).filter((F.col("u") >= rate) | F.col("edge")).drop("u", "edge")


def threshold_from_quantile(curve: DataFrame, quantiles: list) -> DataFrame:
    """(q, theta_on, theta_off) from quantiles of R_t; theta_off is half, with floors 0.01 and 0.005."""
    q = RK.exact_quantiles(curve, [], "Rt", quantiles)
    on = F.col("quantile")
    off = F.when(on * 0.5 < on, on * 0.5).otherwise(on * 0.4)
    return q.select("q", F.greatest(on, F.lit(0.01)).alias("theta_on"), F.greatest(off, F.lit(0.005)).alias("theta_off"))


def experiments(pred: DataFrame, tau: float = DEFAULTS["tau"]) -> DataFrame:
    """Risk curves of all experiments, stacked: rates, dropouts and threshold variants."""
    curve = durable(risk_curve(pred, tau=tau).select("scenario_id", "time_index", "timestamp_seconds", "Rt", "pred_sigma"))
    fixed = {"theta_on": F.lit(DEFAULTS["theta_on"]), "theta_off": F.lit(DEFAULTS["theta_off"])}
    label = lambda d, n: d.withColumns({"experiment": F.lit(n), **fixed})
    out = label(curve, "original")
    for n, d in (("5hz", subsample_hz(curve, 5.0)), ("2hz", subsample_hz(curve, 2.0)),
                 ("dropout_5pct", frame_dropout(curve, 0.05)), ("dropout_10pct", frame_dropout(curve, 0.10))):
        out = out.unionByName(label(d, n))
    for r in threshold_from_quantile(curve, [0.90, 0.95, 0.99]).orderBy("q").collect():
        out = out.unionByName(curve.withColumns({"experiment": F.lit(f"theta_q{round(r['q'] * 100)}"),
                                                 "theta_on": F.lit(r["theta_on"]), "theta_off": F.lit(r["theta_off"])}))
    first = F.first("timestamp_seconds").over(W.partitionBy("experiment", "scenario_id").orderBy("time_index"))
    return out.withColumn("timestamp_rel", F.col("timestamp_seconds") - first)


def experiment_vectors(pred: DataFrame) -> DataFrame:
    return diagnostic_vector(experiments(pred), keys=["experiment", "scenario_id"])


def ref_vs_perturbed(vectors: DataFrame) -> DataFrame:
    """Each experiment's vector next to the original's, for scenarios in both."""
    ref = vectors.filter(F.col("experiment") == "original").select("scenario_id", *[F.col(c).alias(f"ref_{c}") for c in COMPONENTS])
    return vectors.join(ref, "scenario_id")


def component_relative_error(both: DataFrame) -> DataFrame:
    """Mean, median and largest |ref - pert| / |ref| per experiment and component."""
    err = lambda c: F.abs(F.col(f"ref_{c}") - F.col(c)) / F.greatest(F.abs(F.col(f"ref_{c}")), F.lit(1e-12))
    long = both.select("experiment", F.inline(F.array(*[F.struct(F.lit(c).alias("component"), err(c).cast("double").alias("err")) for c in COMPONENTS])))
    stats = long.groupBy("experiment", "component").agg(F.avg("err").alias("mean_rel_error"), F.max("err").alias("max_rel_error"))
    median = RK.exact_quantiles(long, ["experiment", "component"], "err", [0.5]).select("experiment", "component", F.col("quantile").alias("median_rel_error"))
    return stats.join(median, ["experiment", "component"])


def icc_2_1(scores: DataFrame, score: str = "peak") -> DataFrame:
    """Two-way random single-measure ICC over scenarios seen in every condition."""
    c = F.col
    k = scores.select("experiment").distinct().agg(F.count("*")).scalar()
    per = scores.groupBy("scenario_id").agg(F.count("*").alias("n_cond"), F.avg(score).alias("row_mean")).filter(c("n_cond") == k)
    grid = durable(scores.select("scenario_id", "experiment", c(score).alias("x")).join(per, "scenario_id"))
    grand = grid.agg(F.avg("x")).scalar()
    # Columns are conditions, a handful; rows are reduced per scenario before they meet.
    cols = grid.groupBy("experiment").agg(F.avg("x").alias("col_mean"), F.count("*").alias("n"))
    ss = grid.withColumn("g", grand).agg(F.sum((c("x") - c("g")) * (c("x") - c("g"))).alias("total"),
                                         F.sum((c("row_mean") - c("g")) * (c("row_mean") - c("g"))).alias("rows"))
    cs = cols.withColumn("g", grand).agg(F.sum((c("col_mean") - c("g")) * (c("col_mean") - c("g")) * c("n")).alias("cols"),
                                         F.count("*").alias("k"), F.max("n").alias("n"))
    s = ss.withColumns({x: cs.select(x).scalar() for x in ("cols", "k", "n")})
    s = s.withColumns({"ms_rows": c("rows") / (c("n") - 1), "ms_cols": c("cols") / (c("k") - 1),
                       "ms_error": (c("total") - c("rows") - c("cols")) / ((c("n") - 1) * (c("k") - 1))})
    den = c("ms_rows") + (c("k") - 1) * c("ms_error") + c("k") * (c("ms_cols") - c("ms_error")) / c("n")
    return s.select("n", "k", F.when(F.abs(den) >= 1e-12, (c("ms_rows") - c("ms_error")) / den).alias("icc"))


def top_k_by_experiment(both: DataFrame, ks=TOP_K) -> DataFrame:
    """Share of common scenarios among the k highest peaks of the original and of each experiment; NULL if there are fewer than k."""
    most, keys = max(ks), ["experiment"]
    ref, other = (RK.positions(both, c, most, keys) for c in ("ref_peak", "peak"))
    common = (ref.join(other.withColumnRenamed("pos", "pos_b"), [*keys, "scenario_id"]).withColumn("worst", F.greatest("pos", "pos_b"))
              .groupBy("experiment").agg(*[F.count_if(F.col("worst") <= k).alias(f"k{k}") for k in ks]))
    size = both.groupBy("experiment").agg(F.count("*").alias("size"))
    return size.join(common, keys, "left").select("experiment", *[F.when(F.col("size") >= k, F.coalesce(f"k{k}", F.lit(0)) / F.lit(float(k))).alias(f"top_{k}_overlap") for k in ks])


def robustness_suite(pred: DataFrame, *, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Rank agreement of the peak with the original, per experiment: Spearman with interval, Kendall, overlap of the highest."""
    both = durable(ref_vs_perturbed(durable(experiment_vectors(pred))))
    keys = ["experiment"]
    rho = RK.spearman(both, keys, "ref_peak", "peak").select("experiment", F.col("rho").alias("spearman"), F.col("n").alias("n_scenarios"))
    tau = RK.kendall_tau_b(both, keys, "ref_peak", "peak").select("experiment", F.col("tau").alias("kendall"))
    draws = RS.bootstrap_draws(both, n_boot=n_boot, seed=seed)
    boot = RS.percentile_interval(RS.bootstrap_spearman(both, keys, "ref_peak", "peak", draws), keys, "rho")
    return rho.join(tau, keys).join(boot.select("experiment", "ci_lower", "ci_upper", F.col("mean").alias("boot_mean")), keys).join(top_k_by_experiment(both), keys)
