"""Catalog: model tables, landmark protocols, fits and controls."""
from pyspark.sql import functions as F

from nearmiss.constants import E_ALL, MODEL_FEATURES, NESTED_MODELS, P_CLEAN
from nearmiss.operators import censored as CN, diagnostics as D, landmark as LM, metrics as M, model_table as MT, models as ML, permute as PM, quality as Q, resample as RS, warp as WP
from nearmiss.operators.frames import scene_criticality
from nearmiss.operators.model_table import frame_context as _frame_context
from nearmiss.operators.pairs import ego_track, frame_presence
from nearmiss.operators.splits import assign_split, split_of
from nearmiss.plans.catalog import query, rounded
from nearmiss.plans.context import feature_table
from nearmiss.plans.core import frames_of
from nearmiss.session import durable
from nearmiss.sources.fixture import map_points, mixed_states, scores, signals, smooth_states, states


@query
def frame_context(spark, sf_dir):
    return rounded(_frame_context(states(spark, sf_dir)))


@query
def map_feature_counts(spark, sf_dir):
    return rounded(MT.map_feature_counts(map_points(spark, sf_dir)))


@query
def signal_ratios(spark, sf_dir):
    return rounded(MT.signal_ratios(signals(spark, sf_dir)))


@query
def ego_state_features(spark, sf_dir):
    return rounded(MT.ego_state_features(ego_track(frame_presence(states(spark, sf_dir)))))


@query
def scaler_stats(spark, sf_dir):
    return rounded(MT.scaler_stats(assign_split(scores(spark, sf_dir)).filter("split = 'train'"), ["p_base", "p_full", "gap_m", "n_lines"]))


@query
def model_table(spark, sf_dir):
    return rounded(MT.model_table(states(spark, sf_dir), map_points(spark, sf_dir), signals(spark, sf_dir)))


@query
def r2_features(spark, sf_dir):
    return rounded(MT.r2_features(states(spark, sf_dir)))


@query
def prospective_outcome(spark, sf_dir):
    return rounded(LM.prospective_outcome(frames_of(spark, sf_dir)))


def followed(spark, sf_dir):
    return durable(LM.followup_labels(mixed_states(spark, sf_dir)))


@query
def followup_labels(spark, sf_dir):
    return rounded(followed(spark, sf_dir))


@query
def eligible_landmarks(spark, sf_dir):
    df = LM.eligible_landmarks(followed(spark, sf_dir))
    return rounded(df.groupBy("target_type", "label").agg(F.count("*").alias("n"), F.sum("target_binary").alias("positives")))


@query
def anchor_vs_open_set(spark, sf_dir):
    return rounded(LM.anchor_vs_open_set(followed(spark, sf_dir), scene_criticality(mixed_states(spark, sf_dir))))


@query
def landmark_pair_features(spark, sf_dir):
    return rounded(LM.landmark_pair_features(mixed_states(spark, sf_dir), followed(spark, sf_dir)), 5)


@query
def landmark_features(spark, sf_dir):
    return rounded(LM.landmark_features(states(spark, sf_dir), durable(frames_of(spark, sf_dir))), 5)


def development(spark, sf_dir):
    df = durable(assign_split(feature_table(spark, sf_dir)))
    return df.filter("split = 'train'"), df.filter("split = 'internal_val'")


@query
def nested_gbt(spark, sf_dir):
    """Trees over each feature set on every development frame; metrics on the validation split."""
    train, val = development(spark, sf_dir)
    df = ML.score_nested(train, val, NESTED_MODELS, "target_y_tau_3s", weight="weight_scenario_equal")
    long = M.long_scores(df.withColumn("y", F.col("target_y_tau_3s")), ["y", "weight_scenario_equal"], {m: f"prob_{m}" for m in NESTED_MODELS})
    return rounded(M.classification_metrics(long, ["model"], "y", "p", F.col("weight_scenario_equal")))


def split_scores(spark, sf_dir):
    df = durable(assign_split(M.scenario_weight(scores(spark, sf_dir))))
    return df, df.filter("split = 'train'"), df.filter("split = 'internal_val'")


@query
def spline_logistic(spark, sf_dir):
    df, train, _ = split_scores(spark, sf_dir)
    fitted = ML.spline_logistic(train, ["gap_m", "p_base"], "y", weight="weight")
    out = fitted.transform(df, "p")
    return rounded(M.classification_metrics(out, ["split"], "y", "p", F.col("weight")), 4)


@query
def ttc_only_logistic(spark, sf_dir):
    df, train, _ = split_scores(spark, sf_dir)
    fitted = ML.ttc_only_logistic(train, "y", ttc="gap_m", weight="weight")
    out = ML.score_ttc_only(fitted, df, "p", ttc="gap_m")
    return rounded(M.classification_metrics(out, ["split"], "y", "p", F.col("weight")), 4)


@query
def hurdle_unconditional(spark, sf_dir):
    """Marginal gate and log-TTC moments of the train split, applied to the development splits."""
    table = MT.model_table(states(spark, sf_dir), map_points(spark, sf_dir), signals(spark, sf_dir))
    return rounded(ML.train_hurdles(table, ("M0",)))


@query
def hurdle_models(spark, sf_dir):
    table = MT.model_table(states(spark, sf_dir), map_points(spark, sf_dir), signals(spark, sf_dir))
    return rounded(ML.model_comparison(ML.train_hurdles(table)), 4)


@query
def censored_lognormal(spark, sf_dir):
    """Censored suite fitted on train; NLL parts on the development splits."""
    rows, _ = ML.prepare_r2(MT.r2_features(states(spark, sf_dir)), split_of(F.col("scenario_id")))
    return rounded(ML.evaluate_r2_suite(rows, ML.fit_r2_suite(rows)), 4)


@query
def censored_coefficients(spark, sf_dir):
    rows, _ = ML.prepare_r2(MT.r2_features(states(spark, sf_dir)), split_of(F.col("scenario_id")))
    suite = ML.fit_r2_suite(rows)
    out = [(n, i, float(b), float(m.sigma), m.info["n_events"], m.info["n_censored"]) for n, m in suite.items() for i, b in enumerate(m.beta)]
    return rounded(spark.createDataFrame(out, "model string, pos int, beta double, sigma double, n_events long, n_censored long"), 5)


@query
def conditional_brier(spark, sf_dir):
    """Brier score of a fixed log-normal at 2, 3 and 5 s on the primary risk set."""
    rows = durable(Q.primary_risk_set(MT.r2_features(states(spark, sf_dir))))
    parts = [D.conditional_brier(rows, F.lit(1.5) + F.col("min_pair_distance_m") * 0.02, F.lit(1.0), t) for t in (2.0, 3.0, 5.0)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def permute_within_strata(spark, sf_dir):
    df = assign_split(scores(spark, sf_dir))
    df = durable(df.withColumn("band", PM.quartile_of(df, "gap_m")))
    out = PM.permute_within(df, ["p_full", "n_lines"], ["scenario_id", "time_index"], ["split", "band"], seed=42)
    return rounded(out.select("scenario_id", "time_index", "split", "band", "p_base", "p_full", "n_lines"))


@query
def negative_control(spark, sf_dir):
    """Context permuted within type of the focal actor and quartile of its distance, five seeds."""
    kind = ["p_clean__focal_is_vehicle", "p_clean__focal_is_vulnerable"]
    train, val = (d.withColumns({"band": F.coalesce(PM.quartile_of(d, "p_clean__focal_center_distance_m"), F.lit(-1)),
                                 "kind": F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in kind])}) for d in development(spark, sf_dir))
    return rounded(ML.negative_control(train, val, P_CLEAN, E_ALL, "target_y_tau_3s", weight="weight_scenario_equal", strata=["kind", "band"],
                                       keys=["scenario_id", "time_index"]), 4)


@query
def threshold_sensitivity(spark, sf_dir):
    train, val = development(spark, sf_dir)
    return rounded(ML.threshold_sensitivity(train, val, P_CLEAN, NESTED_MODELS["M_P_Eall"], weight="weight_scenario_equal"), 4)


@query
def feature_importance(spark, sf_dir):
    train, _ = development(spark, sf_dir)
    features = NESTED_MODELS["M_P_Eall"]
    return rounded(ML.feature_importance(ML.nested_gbt(train, features, "target_y_tau_3s", weight="weight_scenario_equal"), features), 4)


@query
def warp_tracks(spark, sf_dir):
    """Verdicts of re-timing every non-ego track of the sampled scenarios, and where the rows come to lie."""
    rows = WP.warp_tracks(WP.select_scenarios(smooth_states(spark, sf_dir).filter("NOT is_sdc")))
    return rounded(rows.groupBy("reason").agg(F.count_distinct("scenario_id", "track_id").alias("n_tracks"), F.count("*").alias("n_rows"),
                                              *[F.avg(c).alias(f"mean_{c}") for c in ("center_x", "center_y", "velocity_x", "velocity_y", "heading")]), 5)


@query
def warp_response_accounting(spark, sf_dir):
    """Peak severity before and after re-timing the sampled scenarios, accounted by sign of change."""
    from nearmiss.operators.profile import scenario_profile
    s = durable(smooth_states(spark, sf_dir))
    moved = durable(WP.apply_warp(s, WP.warp_tracks(WP.select_scenarios(s.filter("NOT is_sdc")))))
    before, after = (durable(scenario_profile(scene_criticality(x))) for x in (s, moved))
    return rounded(WP.warp_response_accounting(before, after))
