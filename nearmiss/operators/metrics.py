"""Weighted classification metrics per group, from cumulative tables of distinct scores."""
from pyspark.sql import Column, DataFrame, functions as F

from nearmiss.operators.pairs import salted_join
from nearmiss.operators.ranking import prefix_sums


def score_curve(df: DataFrame, keys: list, y: str, p: str, w: Column) -> DataFrame:
    """Positive and total weight at, before and in total, from the highest score down."""
    return prefix_sums(df.withColumn("desc", -F.col(p)), keys, "desc",
                       {"pos": w * F.col(y), "all": w}).withColumn("score", -F.col("desc")).drop("desc")


def curve_metrics(df: DataFrame, keys: list, y: str, p: str, w: Column) -> DataFrame:
    """Average precision (step), AUROC with ties, best F1 and its threshold; NULL with one class."""
    c = F.col
    curve = score_curve(df, keys, y, p, w)
    tp, flagged = c("pos_before") + c("pos"), c("all_before") + c("all")
    neg, neg_before = c("all") - c("pos"), c("all_before") - c("pos_before")
    neg_total = c("all_total") - c("pos_total")
    curve = curve.withColumns({
        "ap": F.when(flagged > 0, c("pos") * tp / F.greatest(flagged, F.lit(1e-300))),
        "auc": c("pos") * (neg_total - neg_before - neg * 0.5),
        "f1": tp * 2 / (flagged + c("pos_total")), "neg_total": neg_total})
    both = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    aggs = [F.when(both, F.sum("ap") / F.max("pos_total")).alias("pr_auc"),
            F.when(both, F.sum("auc") / (F.max("pos_total") * F.max("neg_total"))).alias("auroc"),
            F.when(both, F.max("f1")).alias("best_f1"),
            F.when(both, F.max_by("score", F.struct("f1", -c("score")))).alias("best_threshold")]
    return curve.groupBy(*keys).agg(*aggs) if keys else curve.agg(*aggs)


def pointwise_metrics(df: DataFrame, keys: list, y: str, p: str, w: Column) -> DataFrame:
    """Weighted Brier score, log loss (clipped at 1e-12) and prevalences."""
    yy, pp = F.col(y).cast("double"), F.col(p)
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), pp))
    total = F.sum(w)
    loss = -(yy * F.log(q) + (F.lit(1.0) - yy) * F.log(F.lit(1.0) - q))
    aggs = [(F.sum(w * (pp - yy) * (pp - yy)) / total).alias("brier"), (F.sum(w * loss) / total).alias("log_loss"),
            (F.sum(w * yy) / total).alias("weighted_prevalence"), F.avg(yy).alias("prevalence"), F.count("*").alias("n")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def calibration_bins(df: DataFrame, keys: list, y: str, p: str, bins: int = 10) -> DataFrame:
    """Uniform probability bins with mean prediction and observed rate."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.withColumn("bin", b).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(F.col(p)).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate"))


def expected_calibration_error(df: DataFrame, keys: list, y: str, p: str, bins: int = 10) -> DataFrame:
    """Gap of each non-empty bin weighted by that bin's own share of rows."""
    per = calibration_bins(df, keys, y, p, bins)
    ece = (F.sum(F.col("n") * F.abs(F.col("observed_rate") - F.col("mean_predicted"))) / F.sum("n")).alias("ece")
    return per.groupBy(*keys).agg(ece) if keys else per.agg(ece)


def classification_metrics(df: DataFrame, keys: list, y: str, p: str, w: Column) -> DataFrame:
    """All of the above, one row per group."""
    return (curve_metrics(df, keys, y, p, w).join(pointwise_metrics(df, keys, y, p, w), keys)
            .join(expected_calibration_error(df, keys, y, p), keys))


def long_scores(df: DataFrame, keep: list, models: dict) -> DataFrame:
    """Stack prediction columns: one row per (row, model)."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in models.items()])))


def scenario_weight(df: DataFrame, *, normalised: bool = False) -> DataFrame:
    """1 / rows of the scenario; normalised weights sum to the number of rows."""
    counts = df.groupBy("scenario_id").agg(F.count("*").alias("n_s"))
    weight = F.lit(1.0) / F.col("n_s")
    if normalised:
        total = counts.agg(F.sum("n_s") / F.count("*")).scalar()
        weight = weight * total
    # The per-scenario table is the small side; rows of a heavy scenario are cut by their content hash.
    return salted_join(counts, df, ["scenario_id"], [c for c in df.columns if c != "scenario_id"]).withColumn("weight", weight).drop("n_s")
