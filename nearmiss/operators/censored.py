"""Right-censored log-normal TTC regression.

Fitted by Newton steps in (beta / sigma, 1 / sigma), where the likelihood is
convex. One step is one distributed pass that returns (p+2)^2 numbers.
"""
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from nearmiss.constants import T_MAX_S, T_MIN_S
from nearmiss.functions import normal as N
from nearmiss.operators.linear import gram, gram_and_sums
from nearmiss.session import durable

LOG_SIGMA_BOUNDS = (math.log(0.01), math.log(100.0))


def log_ttc(ttc: Column, floor: float = T_MIN_S) -> Column:
    return F.when(ttc.isNotNull(), F.log(F.greatest(ttc, F.lit(floor))))


def with_nll(df: DataFrame, y_log: Column, censor_log: Column, censored: Column, mu: Column, sigma: Column, *, jacobian: bool = True, name: str = "nll") -> DataFrame:
    """Negative log-likelihood per row; with the Jacobian it is on the TTC scale."""
    df = df.withColumns({"l_y": y_log, "l_cens": censored, "l_sigma": F.greatest(sigma, F.lit(1e-12)), "l_mu": mu})
    df = N.with_normal(df, (censor_log - F.col("l_mu")) / F.col("l_sigma"), l_surv="log_sf")
    event = F.expr(f"ln(l_sigma) + {0.5 * math.log(2 * math.pi)!r}D + pow((l_y - l_mu) / l_sigma, 2) / 2" + (" + l_y" if jacobian else ""))
    return df.withColumn(name, F.when(F.col("l_cens"), -F.col("l_surv")).otherwise(event)).drop("l_y", "l_cens", "l_sigma", "l_mu", "l_surv")


def nll_components(df: DataFrame, keys: list, nll: str, censored: Column) -> DataFrame:
    """Event, censored and total mean with counts."""
    rows = df.withColumns({"nll_": F.col(nll), "cens_": censored})
    aggs = [F.avg(F.when(~F.col("cens_"), F.col("nll_"))).alias("nll_event"), F.avg(F.when(F.col("cens_"), F.col("nll_"))).alias("nll_censored"),
            F.avg("nll_").alias("nll_total"), F.count_if(~F.col("cens_")).alias("n_event"), F.count_if("cens_").alias("n_censored"), F.count("*").alias("n_total")]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def with_gaussian_nll(df: DataFrame, y: Column, event: Column, mu: Column, sigma: Column, *, name: str = "nll") -> DataFrame:
    """Legacy form on log TTC: Gaussian density for events, survival at the observed value otherwise."""
    return with_nll(df, y, y, ~event, mu, sigma, jacobian=False, name=name)


@dataclass
class CensoredLogNormal:
    """Fitted model: plain numbers, stored as one JSON document."""
    name: str
    features: list
    beta: list
    sigma: float
    info: dict

    def mu(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for f, b in zip(self.features, self.beta[1:]):
            out = out + F.col(f).cast("double") * float(b)
        return out

    def with_nll(self, df: DataFrame, *, jacobian: bool = True, name: str = "nll") -> DataFrame:
        """Per-row NLL of rows from model_rows."""
        return with_nll(df, F.col("y_log"), F.col("censor_log"), F.col("censored"), self.mu(), F.lit(self.sigma), jacobian=jacobian, name=name)

    def with_exceedance(self, df: DataFrame, tau: float, *, name: str = "p_exceed") -> DataFrame:
        """P(TTC <= tau | primary risk set)."""
        return N.with_normal(df, (F.lit(math.log(max(tau, T_MIN_S))) - self.mu()) / self.sigma, **{name: "cdf"})

    def to_dict(self) -> dict:
        return asdict(self)


def model_rows(df: DataFrame, *, ttc: str = "ttc_obb_swept_s", censored: str = "right_censored", censor_time: str | None = "censor_time_s") -> DataFrame:
    """y_log, censor_log, censored next to the features."""
    limit = log_ttc(F.coalesce(F.col(censor_time), F.lit(T_MAX_S))) if censor_time else F.lit(math.log(T_MAX_S))
    return df.withColumns({"y_log": log_ttc(F.col(ttc)), "censor_log": limit, "censored": F.col(censored)})


def fit(df: DataFrame, name: str, features: list, *, max_iter: int = 50, tol: float = 1e-7) -> CensoredLogNormal:
    """Newton fit on rows from model_rows. An empty feature list gives the intercept-only model."""
    data = durable(df.select(*[F.col(f).cast("double").alias(f) for f in features], "y_log", "censor_log", "censored"))
    p = len(features)
    events = data.filter(~F.col("censored"))
    g = gram(events, [*features, "y_log"])
    n_event = g[0, 0]
    n = data.count()
    beta, sigma = np.zeros(p + 1), 1.0
    if n_event > p + 1:
        # Least squares on the events starts the search.
        beta = np.linalg.lstsq(g[:p + 1, :p + 1], g[:p + 1, p + 1], rcond=None)[0]
        rss = g[p + 1, p + 1] - 2 * beta @ g[:p + 1, p + 1] + beta @ g[:p + 1, :p + 1] @ beta
        sigma = max(math.sqrt(max(rss / n_event, 0.0)), 0.1)
    params = np.append(beta / sigma, 1 / sigma)
    value, grad, hess = _pass(data, features, params, n)
    steps, norm = 0, float(np.linalg.norm(grad))
    while steps < max_iter and norm > tol:
        step = np.linalg.solve(hess + 1e-12 * np.eye(p + 2), grad)
        scale = 1.0
        while scale > 1e-8:
            trial = params - scale * step
            if trial[-1] > 0:
                got = _pass(data, features, trial, n)
                if math.isfinite(got[0]) and got[0] <= value + 1e-12:
                    break
            scale /= 2
        else:
            break
        params, (value, grad, hess) = trial, got
        steps, norm = steps + 1, float(np.linalg.norm(grad))
    sigma = math.exp(min(max(-math.log(params[-1]), LOG_SIGMA_BOUNDS[0]), LOG_SIGMA_BOUNDS[1]))
    return CensoredLogNormal(name, list(features), [float(b) for b in params[:-1] * sigma], sigma, {
        "n_samples": int(n), "n_events": int(n_event), "n_censored": int(n - n_event), "n_iterations": steps, "grad_norm": norm, "converged": norm <= 1e-6})


def _pass(data: DataFrame, features: list, params: np.ndarray, n: int):
    """Mean NLL (without Jacobian and constants), gradient and Hessian at (gamma, theta).

    With u = (1, x, -t), t the event or censoring log time, both kinds of rows
    have gradient g u and curvature k u u', so one pass returns everything.
    """
    theta = float(params[-1])
    t = F.when(F.col("censored"), F.col("censor_log")).otherwise(F.col("y_log"))
    lin = F.lit(float(params[0]))
    for f, b in zip(features, params[1:-1]):
        lin = lin + F.col(f) * float(b)
    rows = data.withColumn("neg_t", -t).withColumn("r", -F.col("neg_t") * theta - lin)
    rows = N.with_normal(rows, F.col("r"), h="mills", ls="log_sf")
    h = F.col("h")
    rows = rows.withColumns({"g": F.when(F.col("censored"), -h).otherwise(-F.col("r")),
                             "k": F.when(F.col("censored"), h * (h - F.col("r"))).otherwise(F.lit(1.0)),
                             "v": F.when(F.col("censored"), -F.col("ls")).otherwise(F.col("r") * F.col("r") * 0.5 - math.log(theta)),
                             "e": (~F.col("censored")).cast("double")})
    hess, grad, (value, n_event) = gram_and_sums(rows, [*features, "neg_t"], "k", by=["g"], sums=["v", "e"])
    grad = grad[0].copy()
    grad[-1] -= n_event / theta
    hess[-1, -1] += n_event / theta ** 2
    return value / n, grad / n, hess / n
