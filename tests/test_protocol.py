"""Landmark protocol on synthetic scenarios, diagnostics on literal curves, re-timing."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmiss.operators import censored as CN, diagnostics as D, frames as FR, kinematics as K, landmark as LM, models as ML, robustness as RB, warp as WP
from tests.conftest import state


def scene(name, ego, targets, n=40):
    rows = []
    for t in range(n):
        rows.append(state(name, t, 0, **ego(t)))
        for tid, fn in targets.items():
            s = fn(t)
            if s is not None:
                rows.append(state(name, t, tid, **s))
    return rows


def east(t):
    return dict(x=1.0 * t, vx=10.0)


@pytest.fixture(scope="module")
def labelled(states_df):
    still = lambda t: {}
    rows = scene("pos", east, {1: lambda t: dict(x=70.0 - 0.5 * t, vx=-5.0, h=math.pi)})
    rows += scene("neg", east, {1: lambda t: dict(x=1.0 * t, y=10.0, vx=10.0)})
    rows += scene("overlap", still, {1: lambda t: dict(x=1.0)})
    rows += scene("brake", east, {1: lambda t: dict(x=t + 35.0, vx=10.0) if t < 15 else dict(x=50.0)})
    rows += scene("lost", east, {1: lambda t: None if t >= 18 else dict(x=1.0 * t, y=25.0, vx=10.0)})
    rows += scene("cross", east, {1: lambda t: dict(x=1.0 * t, y=15.0, vx=10.0), 2: lambda t: dict(x=1.0 * t, y=50.0, vx=5.0)})
    rows += scene("switch", east, {1: lambda t: dict(x=1.0 * t, y=20.0, vx=10.0), 2: lambda t: dict(x=50.0, y=40.0, vy=-20.0, h=-math.pi / 2) if t < 15 else dict(x=22.0)})
    rows += scene("far", still, {1: lambda t: dict(x=100.0)})
    rows += scene("ego_gone", lambda t: dict(x=1.0 * t, vx=10.0, valid=t < 20), {1: lambda t: dict(x=1.0 * t, y=10.0, vx=10.0)})
    df = states_df(rows)
    labels = LM.followup_labels(df)
    return df, labels, {(r.scenario_id, r.target_track_id): r for r in labels.collect()}


def test_labels(labelled):
    _, _, by = labelled
    r = by[("pos", 1)]
    assert r.is_eligible and r.label == "positive" and 10 < r.event_time_index <= 30 and r.event_ttc_s <= 3.0
    assert by[("neg", 1)].label == "negative" and by[("neg", 1)].event_time_index is None
    assert (by[("overlap", 1)].label, by[("overlap", 1)].exclusion_reason) == ("excluded", "INDEX_OVERLAP")
    assert by[("brake", 1)].label == "positive" and 10 < by[("brake", 1)].event_time_index <= 30
    assert (by[("lost", 1)].label, by[("lost", 1)].incomplete_reason, by[("lost", 1)].incomplete_time_index) == ("incomplete", "TARGET_LOST", 18)
    assert by[("cross", 1)].label == by[("cross", 2)].label == "negative"
    assert (by[("far", 1)].is_eligible, by[("far", 1)].exclusion_reason) == (False, "OUT_OF_RADIUS")
    assert (by[("ego_gone", 1)].incomplete_reason, by[("ego_gone", 1)].incomplete_time_index) == ("EGO_LOST", 20)


def test_switch_contrast(labelled):
    df, labels, by = labelled
    c = {r.scenario_id: r for r in LM.anchor_vs_open_set(labels, FR.scene_criticality(df)).collect()}["switch"]
    assert by[("switch", 1)].label == "negative" and c.anchor_track_id == 1
    assert c.open_set_frame_min_label == "positive" and c.anchor_vs_open_disagreement and c.open_target_switch_or_new_entrant
    assert c.open_set_first_critical_track_id == 2


def test_onset(labelled):
    df, _, _ = labelled
    r = {r.scenario_id: r for r in LM.prospective_outcome(FR.scene_criticality(df)).collect()}
    assert r["brake"].y_onset_3s_h2s == 1 and r["neg"].y_onset_3s_h2s == 0 and r["overlap"].y_onset_3s_h2s == 0
    assert r["neg"].delta_future_peak_c_h2s == 0.0


def curve(spark, risk, **cols):
    n = len(risk)
    rows = [("s", t, t * 0.1, t * 0.1, float(v), float(cols.get("sigma", 0.5))) for t, v in enumerate(risk)]
    return spark.createDataFrame(rows, "scenario_id string, time_index int, timestamp_seconds double, timestamp_rel double, Rt double, pred_sigma double")


def profile(n, *spans):
    r = np.zeros(n)
    for a, b, v in spans:
        r[a:b] = v
    return r


@pytest.mark.parametrize("risk,count", [(profile(50), 0), (profile(100, (10, 21, 0.8), (24, 35, 0.8)), 1), (profile(100, (10, 16, 0.8), (36, 46, 0.8)), 2),
                                        (profile(100, (5, 15, 0.9), (50, 65, 0.85)), 2), (profile(60, (10, 12, 0.9)), 0),
                                        (profile(60, (10, 20, 0.9), (20, 30, 0.5)), 1)])
def test_hysteresis(spark, risk, count):
    df = curve(spark, risk)
    assert D.hysteresis_events(df).count() == count
    v = D.diagnostic_vector(df).first()
    assert v.event_count == count and v.peak == pytest.approx(risk.max())
    assert v.predictive_uncertainty == pytest.approx(0.5 * 2.563103, abs=1e-5)


def test_between_thresholds_keeps_state(spark):
    e = D.hysteresis_events(curve(spark, profile(60, (10, 20, 0.9), (20, 30, 0.5)))).first()
    assert e.start_s == pytest.approx(1.0) and e.end_s == pytest.approx(3.0)


def test_hold_recovery(spark):
    v = D.diagnostic_vector(curve(spark, profile(100, (10, 20, 0.9)))).first()
    assert not v.recovery_censored and v.recovery_time == pytest.approx(0.6)
    v = D.diagnostic_vector(curve(spark, profile(30, (20, 30, 0.9)))).first()
    assert v.recovery_censored and v.recovery_time == 0.0


def test_surprise_only_on_events(spark):
    status = ["event", "right_censored", "event", "no_exposure", "invalid_frame"]
    flags = [1, 1, 0, 0, 0]
    rows = [("s", i, i * 0.1, 0.5, 1.0, 0.5, 0.5, f, s) for i, (f, s) in enumerate(zip(flags, status))]
    df = spark.createDataFrame(rows, "scenario_id string, time_index int, timestamp_seconds double, pred_p_exposure double, pred_mu double, pred_sigma double, y_log_ttc double, exposure_flag int, target_status string")
    st = [r.St for r in D.risk_curve(df).orderBy("time_index").collect()]
    assert st[0] > 0 and st[1:] == [None] * 4


def test_subsampling_and_dropout(spark):
    df = curve(spark, np.linspace(0, 1, 91))
    assert [r.time_index for r in RB.subsample_hz(df, 2.0).orderBy("time_index").collect()] == list(range(0, 91, 5))
    assert RB.subsample_hz(df, 10.0).count() == 91
    kept = [r.time_index for r in RB.frame_dropout(df, 0.5).collect()]
    assert 0 in kept and 90 in kept and 25 < len(kept) < 66
    assert sorted(kept) == sorted(r.time_index for r in RB.frame_dropout(df, 0.5).collect())


def test_identical_conditions_have_icc_one(spark):
    rows = [(e, f"s{i}", float(i * i % 7)) for e in ("a", "b", "c") for i in range(12)]
    r = RB.icc_2_1(spark.createDataFrame(rows, "experiment string, scenario_id string, peak double")).first()
    assert r.icc == pytest.approx(1.0) and (r.n, r.k) == (12, 3)


def aft_rows(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    t = np.exp(0.8 - 0.5 * x + 0.6 * rng.normal(size=n))
    cens = t > 5
    rows = [(float(a), float(min(b, 5.0)), bool(c), 5.0) for a, b, c in zip(x, t, cens)]
    df = spark.createDataFrame(rows, "x double, ttc_obb_swept_s double, right_censored boolean, censor_time_s double")
    return CN.model_rows(df), x, np.minimum(t, 5.0), cens


def test_censored_fit_recovers_parameters(spark):
    df, x, t, cens = aft_rows(spark)
    m = CN.fit(df, "m", ["x"])
    assert m.info["converged"] and m.info["n_censored"] == int(cens.sum())
    assert m.beta == pytest.approx([0.8, -0.5], abs=0.06) and m.sigma == pytest.approx(0.6, abs=0.04)
    # The maximum: the direct likelihood does not improve in any direction.
    phi = lambda z: np.array([math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z])

    def nll(b0, b1, s):
        mu, y = b0 + b1 * x, np.log(np.maximum(t, 0.05))
        r = (y - mu) / s
        return np.where(cens, -phi((math.log(5.0) - mu) / s), math.log(s) + 0.5 * math.log(2 * math.pi) + r * r / 2 + y).mean()

    best = nll(*m.beta, m.sigma)
    assert m.with_nll(df).agg(F.avg("nll")).first()[0] == pytest.approx(best, rel=1e-10)
    for d in np.eye(3) * 1e-3:
        p = np.array([*m.beta, m.sigma])
        assert nll(*(p + d)) >= best and nll(*(p - d)) >= best


def test_intercept_only_model(spark):
    df, _, _, _ = aft_rows(spark, n=800)
    m = CN.fit(df, "M0", [])
    assert m.info["converged"] and len(m.beta) == 1


def test_brier_refused_when_censored_early(spark):
    rows = [(2.0, False, 10.0, 1.0), (1.0, True, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ttc_obb_swept_s double, right_censored boolean, censor_time_s double, mu double")
    r = D.conditional_brier(df, F.col("mu"), F.lit(1.0), 3.0).first()
    assert r.brier_score is None and r.brier_method == "IPCW_REQUIRED"
    assert D.conditional_brier(df, F.col("mu"), F.lit(1.0), 0.5).first().brier_score is not None


def test_spline_basis_sums_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in np.linspace(-3, 9, 41)], "v double")
    cols = ML.spline_basis("v", -1.0, 7.0, 5, 7)
    out = df.select("v", sum(cols, F.lit(0.0)).alias("total"), *[c.alias(f"b{i}") for i, c in enumerate(cols)]).collect()
    assert all(r.total == pytest.approx(1.0) for r in out) and all(r[f"b{i}"] >= 0 for r in out for i in range(7))
    inside = {r.v: tuple(r)[2:] for r in out}
    assert inside[min(inside)] == pytest.approx(tuple(next(tuple(r)[2:] for r in out if abs(r.v + 1.0) < 0.16)), abs=0.2)


def straight(n=30, wiggle=0.0):
    xs = np.linspace(0, 30, n)
    return [state("w", t, 5, x=float(x), y=float(wiggle * math.sin(x)), vx=10.0) for t, x in enumerate(xs)]


def test_retiming(states_df):
    ok = WP.warp_tracks(states_df(straight()), alpha=0.05).collect()
    assert {r.reason for r in ok} == {"OK"} and all(abs(r.center_y) < 1e-9 for r in ok)
    assert ok[0].time_index is not None and max(r.center_x for r in ok) <= 30.0 + 1e-9
    assert {r.reason for r in WP.warp_tracks(states_df(straight()[:8])).collect()} == {"TRACK_TOO_SHORT"}
    assert {r.reason for r in WP.warp_tracks(states_df(straight()[::2] + straight()[1:2])).collect()} == {"NON_CONTIGUOUS_TIMESTEPS"}
    assert {r.reason for r in WP.warp_tracks(states_df([state("w", t, 5, x=1.0) for t in range(12)])).collect()} == {"STATIONARY_OR_TOO_SHORT"}
    bad = {r.reason for r in WP.warp_tracks(states_df([state("w", t, 5, x=3.0 * t) for t in range(20)])).collect()}
    assert len(bad) == 1 and bad.pop().startswith("PHYSICAL_GATES_FAILED:POSITION")


def test_warp_changes_only_accepted_tracks(states_df):
    rows = straight() + [state("w", t, 6, x=3.0 * t) for t in range(20)]
    df = states_df(rows)
    out = {(r.track_id, r.time_index): r.center_x for r in WP.apply_warp(df, WP.warp_tracks(df, alpha=0.05)).collect()}
    old = {(r[3], r[1]): r[6] for r in rows}
    assert all(out[k] == old[k] for k in old if k[0] == 6) and any(abs(out[k] - old[k]) > 1e-6 for k in old if k[0] == 5)


def test_unchanged_is_not_an_increase(spark):
    mk = lambda v: spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(v)], "scenario_id string, criticality_peak double")
    r = WP.warp_response_accounting(mk([0.1, 0.2, 0.3, 0.4]), mk([0.1, 0.2, 0.5, 0.1])).first()
    assert (r.delta_peak_c_positive_count, r.delta_peak_c_zero_count, r.delta_peak_c_negative_count) == (1, 2, 1) and r.unchanged_rate == 0.5


def test_kinematics_need_consecutive_valid_rows(states_df):
    rows = [state(t=t, vx=float(v), valid=ok) for t, (v, ok) in enumerate([(10, True), (11, True), (13, True), (0, False), (12, True), (12, True)])]
    r = K.kinematics(states_df(rows)).orderBy("time_index").collect()
    assert [x.derived_accel_mps2 is None for x in r] == [True, False, False, True, True, False]
    assert r[2].derived_accel_mps2 == pytest.approx(20.0) and r[2].derived_jerk_mps3 == pytest.approx(100.0) and r[2].derived_kinematic_valid
    assert r[3].derived_speed_mps is None and not r[5].derived_kinematic_valid
