"""Catalog: metrics, ranks and resampling over the frame score table."""
from pyspark.sql import functions as F

from nearmiss.constants import CONTRASTS

from nearmiss.operators import frames as FR, metrics as M, model_table as MT, ranking as RK, resample as RS
from nearmiss.operators.pairs import FRAME
from nearmiss.operators.splits import assign_split
from nearmiss.plans.catalog import query, rounded
from nearmiss.sources.fixture import scores, signals, states

MODELS = {"base": "p_base", "full": "p_full"}
FULL = 1000


def weighted(spark, sf_dir):
    return M.scenario_weight(scores(spark, sf_dir))


def stacked(spark, sf_dir):
    df = assign_split(weighted(spark, sf_dir))
    return M.long_scores(df, ["scenario_id", "time_index", "split", "y", "weight", "n_lines", "gap_m"], MODELS)


@query
def scenario_weight(spark, sf_dir):
    return rounded(M.scenario_weight(scores(spark, sf_dir), normalised=True).select("scenario_id", "time_index", "weight"))


@query
def weighted_ap_auroc(spark, sf_dir):
    return rounded(M.curve_metrics(stacked(spark, sf_dir), ["model", "split"], "y", "p", F.col("weight")))


@query
def brier_log_loss(spark, sf_dir):
    return rounded(M.pointwise_metrics(stacked(spark, sf_dir), ["model", "split"], "y", "p", F.col("weight")))


@query
def calibration_bins(spark, sf_dir):
    return rounded(M.calibration_bins(stacked(spark, sf_dir), ["model"], "y", "p"))


@query
def expected_calibration_error(spark, sf_dir):
    return rounded(M.expected_calibration_error(stacked(spark, sf_dir), ["model", "split"], "y", "p"))


@query
def per_split_evaluation(spark, sf_dir):
    return rounded(M.classification_metrics(stacked(spark, sf_dir), ["model", "split"], "y", "p", F.col("weight")))


@query
def stratified_metrics(spark, sf_dir):
    """Metrics within traffic halves, distance bands, frames with and without a named signal, and types of the frame's soonest target."""
    named = MT.signal_ratios(signals(spark, sf_dir).filter(~F.contains("signal_state", F.lit("UNKNOWN")))).select(*FRAME, "odd_has_signal")
    targets = FR.frame_targets_log(states(spark, sf_dir)).select(*FRAME, "target_object_type")
    frames = scores(spark, sf_dir).join(named, FRAME, "left").join(targets, FRAME, "left")
    df = M.long_scores(M.scenario_weight(frames), ["n_lines", "gap_m", "odd_has_signal", "target_object_type", "weight", "y"], MODELS)
    median = RK.exact_quantiles(df, [], "n_lines", [0.5]).select("quantile").scalar()
    strata = {"traffic": F.when(F.col("n_lines") <= median, "low_traffic").otherwise("high_traffic"),
              "distance_band": F.when(F.col("gap_m") < 20, "0_20m").when(F.col("gap_m") < 40, "20_40m").otherwise("40_70m"),
              "signal": F.when(F.col("odd_has_signal") == 1, "has_signal").otherwise("no_signal"),
              "object_type": F.coalesce("target_object_type", F.lit("NO_TARGET"))}
    long = df.select("model", "y", "p", "weight", F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), s.alias("stratum")) for d, s in strata.items()])))
    return rounded(M.classification_metrics(long, ["model", "dimension", "stratum"], "y", "p", F.col("weight")))


@query
def exact_quantiles(spark, sf_dir):
    df = assign_split(scores(spark, sf_dir))
    return rounded(RK.exact_quantiles(df, ["split"], "gap_m", [0.0, 0.025, 0.25, 0.5, 0.8, 0.975, 1.0]))


@query
def spearman(spark, sf_dir):
    return rounded(RK.spearman(assign_split(weighted(spark, sf_dir)), ["split"], "p_base", "gap_m"))


@query
def weighted_spearman(spark, sf_dir):
    return rounded(RK.spearman(assign_split(weighted(spark, sf_dir)), ["split"], "p_base", "n_lines", weight=F.col("weight")))


def per_scenario(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("scenario_id").agg(
        F.max("p_base").alias("peak_base"), F.sum("y").alias("hits"), F.round(F.avg("gap_m"), 9).alias("mean_gap"))


@query
def kendall_tau_b(spark, sf_dir):
    return rounded(RK.kendall_tau_b(assign_split(per_scenario(spark, sf_dir)), ["split"], "peak_base", "hits"))


@query
def top_k_overlap(spark, sf_dir):
    df = per_scenario(spark, sf_dir)
    return rounded(RK.top_k_overlap(df, df, "peak_base", "hits", [10, 20, 50, 100000]))


@query
def bootstrap_draws(spark, sf_dir):
    return rounded(RS.bootstrap_draws(scores(spark, sf_dir), n_boot=FULL))


#: Scores of the nested models on the derived score table, as SQL that both engines read alike.
NESTED_SCORES = {"M_P": "p_base", "M_P_Eall": "p_full", "M_P_Estatic": "(p_base * 3 + p_full) / 4", "M_P_Ecomp": "(p_base + p_full) / 2", "M_P_Einteract": "(p_base + p_full * 3) / 4",
                 "M_P_Eall_Ehist": "(p_full * 7 + CAST(n_lines % 5 AS DOUBLE) / 5) / 8"}


@query
def paired_delta_ci(spark, sf_dir):
    """Five contrasts of nested models on 1,000 scenario resamples."""
    df = weighted(spark, sf_dir).withColumns({f"prob_{m}": F.expr(e) for m, e in NESTED_SCORES.items()})
    return rounded(RS.paired_delta_interval(df, "y", F.col("weight"), CONTRASTS, {m: f"prob_{m}" for m in NESTED_SCORES}, n_boot=FULL))


@query
def paired_nll_ci(spark, sf_dir):
    nll = lambda p: -F.log(F.greatest(F.when(F.col("y") == 1, F.col(p)).otherwise(F.lit(1.0) - F.col(p)), F.lit(1e-12)))
    df = scores(spark, sf_dir).withColumns({"nll_a": nll("p_base"), "nll_b": nll("p_full")})
    return rounded(RS.paired_mean_interval(df, "nll_a", "nll_b", n_boot=FULL))


@query
def bootstrap_correlation_ci(spark, sf_dir):
    df = per_scenario(spark, sf_dir)
    draws = RS.bootstrap_draws(df, n_boot=FULL)
    return rounded(RS.percentile_interval(RS.bootstrap_spearman(df, [], "peak_base", "mean_gap", draws), [], "rho"))


@query
def bh_fdr(spark, sf_dir):
    """One test per split and model: share of replicates by sign, then adjusted."""
    df = assign_split(scores(spark, sf_dir)).groupBy("scenario_id", "split").agg(
        F.avg(F.col("p_full") - F.col("p_base")).alias("d_full"), F.avg(F.col("y") - F.col("p_base")).alias("d_base"))
    long = df.select("split", F.inline(F.array(F.struct(F.lit("full").alias("feature_name"), F.col("d_full").alias("d")),
                                               F.struct(F.lit("base").alias("feature_name"), F.col("d_base").alias("d")))))
    p = long.groupBy("split", "feature_name").agg(RS.empirical_p(F.col("d")).alias("p"))
    return rounded(RS.bh_fdr(p.withColumn("feature_name", F.concat_ws("|", "split", "feature_name")).drop("split"), "p"))
