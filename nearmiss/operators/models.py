"""Model fits on Spark ML, scored as columns."""
import json
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearmiss.constants import C_ODD, R2_MODELS, T_MAX_S, Z_STATE
from nearmiss.functions import normal as N
from nearmiss.operators import censored as CN, metrics as M, quality as Q
from nearmiss.operators.boosting import fit_together
from nearmiss.operators.model_table import apply_scaler, scaler_stats
from nearmiss.operators.permute import permuted_copies
from nearmiss.session import durable


def filled(df: DataFrame, features: list) -> DataFrame:
    """Features as doubles with NULL read as 0, only for the matrix of a fit."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def with_interactions(df: DataFrame, pairs: list) -> DataFrame:
    """Product columns named a__x__b."""
    return df.withColumns({f"{a}__x__{b}": F.col(a) * F.col(b) for a, b in pairs}) if pairs else df


def nested_gbt(train: DataFrame, features: list, label: str, *, weight: str | None = None, max_iter: int = 100, max_depth: int = 6, seed: int = 42) -> PipelineModel:
    """Boosted trees on one feature set."""
    gbt = GBTClassifier(labelCol="label_", featuresCol="features_", maxIter=max_iter, maxDepth=max_depth, seed=seed, **({"weightCol": weight} if weight else {}))
    data = filled(train, features).withColumn("label_", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features_"), gbt]).fit(data)


def score(model: PipelineModel, df: DataFrame, features: list, name: str) -> DataFrame:
    """Add the probability of class 1 as a plain column."""
    out = model.transform(filled(df, features))
    extra = [c for c in out.columns if c not in df.columns]
    return out.withColumn(name, vector_to_array("probability")[1]).drop(*[c for c in extra if c != name])


def score_nested(train: DataFrame, evaluation: DataFrame, models: dict, label: str, *, weight: str | None = None, **kw) -> DataFrame:
    """Fit every nested model on `train` and add prob_<model> columns to `evaluation`; all models grow in the same passes."""
    boosted = fit_together(train, {n: (fs, label) for n, fs in models.items()}, weight=weight, **kw)
    return durable(boosted.score(evaluation, {n: f"prob_{n}" for n in models}))


def feature_importance(model: PipelineModel, features: list) -> DataFrame:
    """Tree importances with their role by name prefix."""
    values = model.stages[-1].featureImportances.toArray()
    role = lambda f: "physics" if f.startswith("p_") else "context"
    rows = [(f, role(f), float(v)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "feature_name string, feature_role string, importance double")


# Spline logistic.

def spline_basis(column: str, low: float, high: float, knots: int, degree_columns: int) -> list:
    """Uniform cubic B-spline columns over [low, high]; values outside are held at the edge.

    The cardinal cubic B-spline is a function of the distance to its centre,
    so every basis column is one expression. The last column is left out
    because the basis sums to one.
    """
    span = (high - low) or 1.0
    u = f"(greatest({low!r}D, least({high!r}D, coalesce(double(`{column}`), 0D))) - {low!r}D) / {span!r}D * {knots - 1}D"
    out = []
    for j in range(degree_columns):
        v = f"abs({u} - {float(j - 1)!r}D)"
        out.append(F.expr(f"CASE WHEN {v} < 1D THEN (4D - 6D * {v} * {v} + 3D * {v} * {v} * {v}) / 6D WHEN {v} < 2D THEN pow(2D - {v}, 3) / 6D ELSE 0D END"))
    return out


class SplineLogistic:
    """Spline columns per feature and an L2 logistic; the knot ranges are frozen at fit time."""

    def __init__(self, features, ranges, model, knots):
        self.features, self.ranges, self.model, self.knots = features, ranges, model, knots

    def basis(self, df: DataFrame) -> DataFrame:
        cols = {}
        for i, f in enumerate(self.features):
            low, high = self.ranges[f]
            for j, c in enumerate(spline_basis(f, low, high, self.knots, self.knots + 1)):
                cols[f"s_{i}_{j}"] = c
        return df.withColumns(cols)

    def names(self) -> list:
        return [f"s_{i}_{j}" for i in range(len(self.features)) for j in range(self.knots + 1)]

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        out = self.model.transform(self.basis(df)).withColumn(name, vector_to_array("probability")[1])
        return out.select(*df.columns, name)


def spline_logistic(train: DataFrame, features: list, label: str, *, weight: str | None = None, knots: int = 5, c: float = 1.0, max_iter: int = 1000) -> SplineLogistic:
    """Cubic spline basis on the range of the training data, L2 logistic with inverse strength c."""
    stats = train.agg(*[x for f in features for x in (F.min(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"{f}|lo"), F.max(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"{f}|hi"))],
                      (F.sum(weight) if weight else F.count("*").cast("double")).alias("w|total")).first()
    ranges = {f: (float(stats[f"{f}|lo"]), float(stats[f"{f}|hi"])) for f in features}
    shell = SplineLogistic(features, ranges, None, knots)
    lr = LogisticRegression(labelCol="label_", featuresCol="features_", regParam=1.0 / (c * float(stats["w|total"])), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, tol=1e-8, **({"weightCol": weight} if weight else {}))
    data = shell.basis(train).withColumn("label_", F.col(label).cast("double"))
    shell.model = Pipeline(stages=[VectorAssembler(inputCols=shell.names(), outputCol="features_"), lr]).fit(data)
    return shell


def logistic(train: DataFrame, features: list, label: str, *, weight: str | None = None, reg: float = 0.0, max_iter: int = 1000) -> PipelineModel:
    lr = LogisticRegression(labelCol="label_", featuresCol="features_", regParam=reg, standardization=False, maxIter=max_iter, tol=1e-9, **({"weightCol": weight} if weight else {}))
    data = filled(train, features).withColumn("label_", F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features_"), lr]).fit(data)


def ttc_only_logistic(train: DataFrame, label: str, *, ttc: str = "capped_index_ttc_s", weight: str | None = None) -> PipelineModel:
    """Unpenalised logistic on the negated TTC."""
    return logistic(train.withColumn("neg_ttc", -F.col(ttc)), ["neg_ttc"], label, weight=weight)


def score_ttc_only(model: PipelineModel, df: DataFrame, name: str, *, ttc: str = "capped_index_ttc_s") -> DataFrame:
    return score(model, df.withColumn("neg_ttc", -F.col(ttc)), ["neg_ttc"], name).drop("neg_ttc")


# Hurdle models: exposure gate times log-TTC distribution.

HURDLES = {"M0": [], "M1": C_ODD, "M2": C_ODD + Z_STATE, "M3": C_ODD + Z_STATE, "M4": C_ODD + Z_STATE}
INTERACTIONS = [(f"{a}_z", f"{b}_z") for a in C_ODD[:4] for b in Z_STATE]


class Hurdle:
    """Exposure probability (rate or logistic) and one Gaussian of log TTC fitted to events."""

    def __init__(self, name, gate, inputs, mu, sigma):
        self.name, self.gate, self.inputs, self.mu, self.sigma = name, gate, inputs, mu, sigma

    def predict(self, df: DataFrame) -> DataFrame:
        """pred_p_exposure, pred_mu, pred_sigma and the risk score at the horizon."""
        keep = df.columns
        if self.inputs:
            pairs = INTERACTIONS if self.name == "M3" else []
            df = score(self.gate, with_interactions(df, pairs), self.inputs, "pred_p_exposure")
        else:
            df = df.withColumn("pred_p_exposure", F.lit(float(self.gate)))
        df = df.withColumns({"pred_mu": F.lit(self.mu), "pred_sigma": F.lit(self.sigma)})
        df = N.with_normal(df, (F.lit(math.log(T_MAX_S)) - F.col("pred_mu")) / F.col("pred_sigma"), p_tau="cdf")
        return df.select(*[c for c in keep if c not in ("pred_p_exposure", "pred_mu", "pred_sigma")], "pred_p_exposure", "pred_mu", "pred_sigma",
                         (F.col("pred_p_exposure") * F.col("p_tau")).alias("pred_risk_score"))


def hurdle(train: DataFrame, name: str) -> Hurdle:
    """M0: marginal rate; M1-M4: logistic gate on scaled features (M3 with products)."""
    event = F.col("target_status") == "event"
    y = F.when(event, F.col("y_log_ttc"))
    s = train.agg(F.avg(F.col("exposure_flag").cast("double")).alias("rate"), F.avg(y).alias("mu"), F.stddev_samp(y).alias("sigma"), F.count(y).alias("n"),
                  F.count("*").cast("double").alias("rows")).first()
    mu, sigma = (s["mu"], s["sigma"]) if s["n"] > 1 else (math.log(T_MAX_S), 1.0)
    inputs = [f"{f}_z" for f in HURDLES[name]]
    if not inputs or s["rate"] in (0.0, 1.0):
        return Hurdle(name, s["rate"], [], mu, sigma)
    if name == "M3":
        train, inputs = with_interactions(train, INTERACTIONS), [*inputs, *[f"{a}__x__{b}" for a, b in INTERACTIONS]]
    gate = logistic(train, inputs, "exposure_flag", reg=1.0 / s["rows"])
    return Hurdle(name, gate, inputs, mu, sigma)


def hurdle_metrics(pred: DataFrame, keys: list) -> DataFrame:
    """Gate Brier score on all frames, censored NLL on exposed ones."""
    c = F.col
    y = c("exposure_flag").cast("double")
    rows = CN.with_gaussian_nll(pred, c("y_log_ttc"), c("target_status") == "event", c("pred_mu"), c("pred_sigma"))
    return rows.groupBy(*keys).agg(F.avg((c("pred_p_exposure") - y) * (c("pred_p_exposure") - y)).alias("gate_brier"),
                                   F.avg(F.when(c("exposure_flag") == 1, c("nll"))).alias("censored_nll"), F.count("*").alias("n_frames"))


def train_hurdles(table: DataFrame, names=tuple(HURDLES)) -> DataFrame:
    """Every hurdle model fitted on train and scored on all development splits, one metric row each."""
    table = durable(table)
    train = table.filter("split = 'train'")
    out = None
    for n in names:
        pred = hurdle(train, n).predict(Q.dev_only(table)).withColumn("model", F.lit(n)).select(
            "model", "split", "exposure_flag", "target_status", "y_log_ttc", "pred_p_exposure", "pred_mu", "pred_sigma")
        out = pred if out is None else out.unionByName(pred)
    return hurdle_metrics(out, ["model", "split"])


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Models side by side, best by validation NLL first."""
    wide = metrics.groupBy("model").pivot("split", ["train", "internal_val"]).agg(F.first("gate_brier").alias("gate_brier"), F.first("censored_nll").alias("censored_nll"))
    best = wide.agg(F.min_by("model", F.struct("internal_val_censored_nll", "model"))).scalar()
    return wide.withColumn("is_best", F.col("model") == best)


# Censored log-normal suite.

def prepare_r2(features: DataFrame, split: Column) -> tuple:
    """Primary risk set with complete features, scaled on the train split: (rows, statistics)."""
    wanted = sorted({f for fs in R2_MODELS.values() for f in fs})
    rows, _ = Q.finite_features(Q.primary_risk_set(features), wanted)
    rows = durable(rows.withColumn("split", split))
    stats = scaler_stats(rows.filter("split = 'train'"), wanted)
    return CN.model_rows(apply_scaler(rows, stats, wanted)), stats


def fit_r2_suite(rows: DataFrame, models: dict = R2_MODELS, **kw) -> dict:
    train = Q.split_guard(rows, "train")
    return {n: CN.fit(train, n, [f"{f}_z" for f in fs], **kw) for n, fs in models.items()}


def evaluate_r2_suite(rows: DataFrame, suite: dict) -> DataFrame:
    """NLL parts of every model on every development split."""
    out = None
    for n, m in suite.items():
        part = m.with_nll(Q.dev_only(rows)).select("split", "censored", "nll", F.lit(n).alias("model"))
        out = part if out is None else out.unionByName(part)
    return CN.nll_components(out, ["model", "split"], "nll", F.col("censored"))


# Evaluation and controls.

def threshold_sensitivity(train: DataFrame, evaluation: DataFrame, base: list, full: list, *, weight: str, taus=(2, 3, 5), **kw) -> DataFrame:
    """Refit and evaluate for each label threshold."""
    train, evaluation = durable(train), durable(evaluation)
    kinds = {"base": base, "full": full}
    boosted = fit_together(train, {f"{n}_{t}": (fs, f"target_y_tau_{t}s") for t in taus for n, fs in kinds.items()}, weight=weight, **kw)
    scored = durable(boosted.score(evaluation, {f"{n}_{t}": f"prob_{n}_{t}" for t in taus for n in kinds}))
    out = None
    for t in taus:
        label = f"target_y_tau_{t}s"
        df = scored.withColumns({f"prob_{n}": F.col(f"prob_{n}_{t}") for n in kinds})
        long = M.long_scores(df.withColumn("y_", F.col(label)), ["y_", weight], {"base": "prob_base", "full": "prob_full"})
        m = M.curve_metrics(long, ["model"], "y_", "p", F.col(weight)).join(M.pointwise_metrics(long, ["model"], "y_", "p", F.col(weight)), "model")
        pick = lambda name, col: F.max(F.when(F.col("model") == name, F.col(col)))
        row = m.agg(F.lit(float(t)).alias("tau_seconds"), pick("full", "weighted_prevalence").alias("weighted_prevalence"), pick("full", "prevalence").alias("unweighted_prevalence"),
                    pick("base", "pr_auc").alias("base_pr_auc"), pick("full", "pr_auc").alias("full_pr_auc"),
                    (pick("full", "pr_auc") - pick("base", "pr_auc")).alias("delta_pr_auc"), pick("base", "auroc").alias("base_auroc"), pick("full", "auroc").alias("full_auroc"))
        out = row if out is None else out.unionByName(row)
    return out


def negative_control(train: DataFrame, evaluation: DataFrame, physics: list, context: list, label: str, *, weight: str, strata: list, keys: list,
                     seeds=(41, 42, 43, 44, 45), **kw) -> DataFrame:
    """AP with real context against context permuted within strata, per seed; all fits grow in the same passes."""
    sets = durable(train.withColumn("in_train", F.lit(True)).unionByName(evaluation.withColumn("in_train", F.lit(False))))
    mixed = permuted_copies(sets, context, ["in_train", *keys], ["in_train", *strata], seeds=seeds)
    both = durable(sets.join(mixed, ["in_train", *keys]))
    fits = {"physics": (physics, label), "real": ([*physics, *context], label),
            **{f"seed_{s}": ([*physics, *[f"{c}__{s}" for c in context]], label) for s in seeds}}
    boosted = fit_together(both.filter("in_train"), fits, weight=weight, **kw)
    scored = boosted.score(both.filter("NOT in_train").withColumn("y_", F.col(label)), {n: f"prob_{n}" for n in fits})
    long = M.long_scores(durable(scored), ["y_", weight], {n: f"prob_{n}" for n in fits})
    ap = {r["model"]: r["pr_auc"] for r in M.curve_metrics(long, ["model"], "y_", "p", F.col(weight)).collect()}
    base, real = ap.get("physics"), ap.get("real")
    rows = [(int(s), base, ap.get(f"seed_{s}"), real, _minus(real, ap.get(f"seed_{s}")), _minus(ap.get(f"seed_{s}"), base)) for s in seeds]
    return train.sparkSession.createDataFrame(rows, "seed int, physics_only_pr_auc double, permuted_context_pr_auc double, true_context_pr_auc double, "
                                                    "delta_true_minus_permuted double, delta_permuted_minus_physics double")


def _minus(a, b):
    return None if a is None or b is None else a - b


# Persistence.

def freeze(model: PipelineModel, features: list, path: str, *, stats: DataFrame | None = None) -> None:
    """Fitted pipeline, feature order and scaler statistics under one folder."""
    model.write().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "pos int, feature string").coalesce(1).write.parquet(f"{path}/features")
    if stats is not None:
        stats.write.parquet(f"{path}/scaler")


def load(spark, path: str) -> tuple:
    """(pipeline, feature order) without refitting."""
    features = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("pos").collect()]
    return PipelineModel.load(f"{path}/model"), features


def freeze_censored(spark, suite: dict, path: str) -> None:
    spark.createDataFrame([(n, json.dumps(m.to_dict(), sort_keys=True)) for n, m in suite.items()], "name string, model string").coalesce(1).write.parquet(path)


def load_censored(spark, path: str) -> dict:
    return {r["name"]: CN.CensoredLogNormal(**json.loads(r["model"])) for r in spark.read.parquet(path).collect()}
