"""Weighted ridge regressions from one distributed Gram matrix."""
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from nearmiss.operators import ranking as RK, resample as RS
from nearmiss.operators.resample import empirical_p, verdict  # noqa: F401
from nearmiss.session import durable


def gram(df: DataFrame, columns: list, weight: str | None = None) -> np.ndarray:
    """Sum of w z z' with z = (1, columns); NULL counts as 0."""
    return gram_and_sums(df, columns, weight)[0]


def gram_and_sums(df: DataFrame, columns: list, weight: str | None = None, *, by: list = (), sums: list = ()) -> tuple:
    """(sum of w z z', sum of `by` z', sum of `sums`) in one pass, with z = (1, columns).

    Each task reduces its rows to these few matrices, so only their elements
    are shuffled and reach the driver, whatever the number of rows.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    data = df.select(*[zero(c).alias(f"z{i}") for i, c in enumerate(columns)], *[zero(c).alias(f"b{i}") for i, c in enumerate(by)],
                     *[zero(c).alias(f"s{i}") for i, c in enumerate(sums)], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    size, nb, ns = len(columns) + 1, len(by), len(sums)

    def partial(batches):
        total = np.zeros(size * size + nb * size + ns)
        for pdf in batches:
            m = pdf.to_numpy(float)
            z = np.column_stack([np.ones(len(m)), m[:, :size - 1]])
            total += np.concatenate([((z * m[:, -1:]).T @ z).ravel(), (m[:, size - 1:size - 1 + nb].T @ z).ravel(), m[:, size - 1 + nb:-1].sum(axis=0)])
        yield pd.DataFrame({"pos": np.arange(len(total)), "value": total})

    out = np.zeros(size * size + nb * size + ns)
    for r in data.mapInPandas(partial, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r["pos"]] = r["value"]
    cut = size * size
    return out[:cut].reshape(size, size), out[cut:cut + nb * size].reshape(nb, size), out[cut + nb * size:]


@dataclass
class Ridge:
    """Coefficients of one target on shared controls; plain numbers, so it can be stored as it is."""
    controls: list
    target: str
    intercept: float
    coef: list

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, b in zip(self.controls, self.coef):
            out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(b)
        return out

    def residual(self) -> Column:
        return F.coalesce(F.col(self.target).cast("double"), F.lit(0.0)) - self.predict()


def ridge_fits(df: DataFrame, controls: list, targets: list, *, weight: str | None = None, alpha: float = 1.0) -> dict:
    """One ridge per target, all from one pass; the intercept is not penalised."""
    g = gram(df, [*controls, *targets], weight)
    n, p = g[0, 0], len(controls)
    mean = g[0, 1:] / n
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    coef = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p:])
    return {t: Ridge(list(controls), t, float(mean[p + j] - mean[:p] @ coef[:, j]), [float(b) for b in coef[:, j]])
            for j, t in enumerate(targets)}


def residual_pairs(df: DataFrame, fits: dict, features: list, target: str, keep: list) -> DataFrame:
    """One row per (row, feature): residual of the feature and of the target."""
    cells = [F.struct(F.lit(f).alias("feature_name"), fits[f].residual().alias("res_e")) for f in features]
    return df.select(*keep, fits[target].residual().alias("res_c"), F.inline(F.array(*cells)))


def tier(primary: Column, train: Column, point: Column, low: Column, high: Column) -> Column:
    return (F.when(~primary, "EXCLUDED_MEASUREMENT_LIMITATION").when(F.signum(train) != F.signum(point), "DISCORDANT")
            .when(low * high <= 0, "UNSUPPORTED").when(F.abs(point) >= 0.03, "CORE_CANDIDATE").otherwise("CONTEXT_CANDIDATE"))


def conditional_effects(train: DataFrame, evaluation: DataFrame, controls: list, features: list, target: str, *, weight: str | None = None,
                        primary=None, n_boot: int = 1000, seed: int = 42, reference: DataFrame | None = None) -> DataFrame:
    """Rank correlation of feature and target residuals given the controls, with a scenario-block interval.

    Ridges are fitted on `train`; effects are estimated on `evaluation`.
    `reference` (feature_name, effect) replaces the training effect in the sign check.
    """
    c = F.col
    fits = ridge_fits(train, controls, [*features, target], weight=weight)
    keep = ["scenario_id", *([weight] if weight else [])]
    w = c(weight) if weight else None
    on_train = residual_pairs(train, fits, features, target, keep)
    on_eval = durable(residual_pairs(evaluation, fits, features, target, keep))
    if reference is None:
        reference = RK.spearman(on_train, ["feature_name"], "res_e", "res_c", weight=w).select("feature_name", c("rho").alias("effect"))
    point = RK.spearman(on_eval, ["feature_name"], "res_e", "res_c", weight=w).select("feature_name", c("rho").alias("point"))
    draws = RS.bootstrap_draws(evaluation, n_boot=n_boot, seed=seed)
    # Rounded, so that a correlation of 0 is 0 whatever the order of summation.
    reps = RS.bootstrap_spearman(on_eval, ["feature_name"], "res_e", "res_c", draws, weight=w).withColumn("rho", F.round("rho", 12))
    boot = RS.percentile_interval(reps, ["feature_name"], "rho")
    is_primary = c("feature_name").isin(*(features if primary is None else primary))
    out = reference.join(point, "feature_name").join(boot, "feature_name")
    return out.select(
        "feature_name", is_primary.alias("primary_eligible"), c("effect").alias("train_conditional_effect"), c("point").alias("val_conditional_effect"),
        c("mean").alias("bootstrap_mean"), c("ci_lower").alias("ci_lower_95"), c("ci_upper").alias("ci_upper_95"), c("p_value").alias("p_value_empirical_bootstrap"),
        (c("ci_lower") * c("ci_upper") > 0).alias("ci_excludes_zero"), (F.signum("effect") == F.signum("point")).alias("train_val_sign_concordant"),
        c("point").between(c("ci_lower") - 1e-12, c("ci_upper") + 1e-12).alias("point_inside_ci"),  # sums differ in order
        tier(is_primary, c("effect"), c("point"), c("ci_lower"), c("ci_upper")).alias("frame_validity_tier"))


def feature_confirmation(dev: DataFrame, holdout: DataFrame) -> DataFrame:
    """Holdout sign and interval against the development tier."""
    c = F.col
    d = dev.select("feature_name", c("val_conditional_effect").alias("dev_conditional_effect"), c("frame_validity_tier").alias("dev_validity_tier"))
    h = holdout.select("feature_name", c("val_conditional_effect").alias("holdout_conditional_effect"), "ci_lower_95", "ci_upper_95", "ci_excludes_zero")
    same = F.signum("dev_conditional_effect") == F.signum("holdout_conditional_effect")
    good = c("dev_validity_tier").isin("CORE_CANDIDATE", "CONTEXT_CANDIDATE")
    return d.join(h, "feature_name").withColumns({
        "dev_holdout_sign_concordant": same,
        "confirmed_status": F.when(same & c("ci_excludes_zero") & good, "CONFIRMED").when(same, "DIRECTION_CONFIRMED").otherwise("UNCONFIRMED")})


def confirmation_rate(confirmed: DataFrame) -> DataFrame:
    c = F.col
    n = F.count_if(c("dev_validity_tier").isin("CORE_CANDIDATE", "CONTEXT_CANDIDATE"))
    rate = F.count_if(c("confirmed_status") == "CONFIRMED") / F.greatest(n, F.lit(1))
    return confirmed.agg(rate.alias("feature_confirmation_rate")).withColumn(
        "status", F.when(c("feature_confirmation_rate") >= 0.70, "SUPPORTED").when(c("feature_confirmation_rate") >= 0.40, "MIXED").otherwise("WEAK"))


def cross_level_class(frame: DataFrame, scenario: DataFrame) -> DataFrame:
    """Frame effect against scenario effect (feature_name, effect, ci_excludes_zero on both sides)."""
    c = F.col
    f = frame.select("feature_name", c("effect").alias("frame_effect"), c("ci_excludes_zero").alias("frame_sig"))
    s = scenario.select("feature_name", c("effect").alias("scenario_effect"), c("ci_excludes_zero").alias("scenario_sig"))
    opposed = (F.signum("frame_effect") != F.signum("scenario_effect")) & (F.abs("frame_effect") > 0.02) & (F.abs("scenario_effect") > 0.02)
    label = (F.when(c("scenario_effect").isNull(), "FRAME_LOCAL").when(opposed, "DISCORDANT_SIGN").when(c("frame_sig") & c("scenario_sig"), "CROSS_LEVEL_STABLE")
             .when(c("frame_sig"), "FRAME_LOCAL").when(c("scenario_sig"), "TEMPORAL_EXPOSURE_SPECIFIC").otherwise("UNSUPPORTED_BOTH"))
    return f.join(s, "feature_name", "left").withColumn("cross_level_classification", label)


def scenario_association(table: DataFrame, profile: DataFrame, controls: list, features: list, targets=("criticality_peak", "criticality_auc_s", "tet_3s_s"),
                         *, n_boot: int = 1000, seed: int = 42, train="train", evaluate="internal_val") -> DataFrame:
    """Conditional effects of scenario-mean features on profile components, joined by key, without weights."""
    means = table.groupBy("scenario_id").agg(*[F.avg(x).alias(x) for x in [*controls, *features]])
    rows = durable(means.join(profile.select("scenario_id", "split", *targets), "scenario_id"))
    tr, ev = rows.filter(F.col("split") == train), rows.filter(F.col("split") == evaluate)
    out = None
    for t in targets:
        e = conditional_effects(tr, ev, controls, features, t, n_boot=n_boot, seed=seed).withColumn("profile_target", F.lit(t))
        out = e if out is None else out.unionByName(e)
    return out
