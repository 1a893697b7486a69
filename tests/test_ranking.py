"""Order statistics against direct computation, on the small and the ranged path."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmiss.operators import linear as L, metrics as M, permute as PM, ranking as RK, resample as RS


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    g = rng.choice(["a", "b"], n, p=[0.8, 0.2])
    x = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(size=n), 2))
    y = np.round(x + rng.normal(size=n), 1)
    s = rng.integers(0, 30, n)
    rows = [(str(k), f"s{int(i)}", float(a), float(b), int(c), float(w)) for k, i, a, b, c, w in zip(g, s, x, y, (y > 0.3).astype(int), rng.uniform(0.2, 2, n))]
    return rows, spark.createDataFrame(rows, "g string, scenario_id string, x double, y double, label int, w double")


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_prefix_sums(table):
    rows, df = table
    for r in RK.prefix_sums(df, ["g"], "x", {"w": F.col("w")}).collect():
        mine = [(a[2], a[5]) for a in rows if a[0] == r.g]
        assert r.w_before == pytest.approx(sum(w for v, w in mine if v < r.x)) and r.w_total == pytest.approx(sum(w for _, w in mine))


def test_quantiles(table):
    rows, df = table
    for r in RK.exact_quantiles(df, ["g"], "y", [0.0, 0.025, 0.5, 0.9, 1.0]).collect():
        assert r.quantile == pytest.approx(np.quantile([a[3] for a in rows if a[0] == r.g], r.q))


def test_spearman_weighted_and_plain(table):
    rows, df = table
    plain = {r.g: r.rho for r in RK.spearman(df, ["g"], "x", "y").collect()}
    weighted = {r.g: r.rho for r in RK.spearman(df, ["g"], "x", "y", weight=F.col("w")).collect()}
    for g in "ab":
        mine = [a for a in rows if a[0] == g]
        rx, ry, w = ranks([a[2] for a in mine]), ranks([a[3] for a in mine]), np.array([a[5] for a in mine])
        assert plain[g] == pytest.approx(np.corrcoef(rx, ry)[0, 1])
        cov = np.cov(rx, ry, aweights=w)
        assert weighted[g] == pytest.approx(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]))


def test_kendall(table):
    rows, df = table
    for r in RK.kendall_tau_b(df, ["g"], "x", "y").collect():
        mine = [a for a in rows if a[0] == r.g]
        x, y = np.array([a[2] for a in mine]), np.array([a[3] for a in mine])
        i, j = np.triu_indices(len(x), 1)
        sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        assert r.tau == pytest.approx((sx * sy).sum() / np.sqrt((sx != 0).sum() * (sy != 0).sum()))


def brute_metrics(y, p, w):
    order = sorted(set(p), reverse=True)
    ap, prev, f1 = 0.0, 0.0, []
    for s in order:
        tp, al = w[(p >= s) & (y == 1)].sum(), w[p >= s].sum()
        rec = tp / w[y == 1].sum()
        ap, prev = ap + (rec - prev) * tp / al, rec
        f1.append(2 * tp / (al + w[y == 1].sum()))
    pos, neg = p[y == 1], p[y == 0]
    wp, wn = w[y == 1], w[y == 0]
    auc = sum(a * b * ((x > z) + 0.5 * (x == z)) for x, a in zip(pos, wp) for z, b in zip(neg, wn)) / (wp.sum() * wn.sum())
    best = max(f1)
    return ap, auc, best, min(s for s, f in zip(order, f1) if abs(f - best) < 1e-12)


def test_curve_metrics(table):
    rows, df = table
    for r in M.curve_metrics(df, ["g"], "label", "x", F.col("w")).collect():
        mine = [a for a in rows if a[0] == r.g]
        want = brute_metrics(np.array([a[4] for a in mine]), np.array([a[2] for a in mine]), np.array([a[5] for a in mine]))
        assert (r.pr_auc, r.auroc, r.best_f1, r.best_threshold) == pytest.approx(want)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    r = M.curve_metrics(df, [], "y", "p", F.lit(1.0)).first()
    assert r.pr_auc is None and r.auroc is None


def test_empty_bin_keeps_weights_aligned(spark):
    df = spark.createDataFrame([(0, 0.05)] * 3 + [(1, 0.95)], "y int, p double")
    # Bins 1..8 are empty; each gap is weighted by its own bin.
    assert M.expected_calibration_error(df, [], "y", "p").first().ece == pytest.approx(0.75 * 0.05 + 0.25 * 0.05)


def test_bootstrap_draws_are_complete_and_vary(spark):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(40)], "scenario_id string")
    d = RS.bootstrap_draws(ids, n_boot=50).collect()
    per = {}
    for r in d:
        per.setdefault(r.replicate, {})[r.scenario_id] = r.m
    assert len(per) == 50 and all(sum(v.values()) == 40 for v in per.values())
    assert len({tuple(sorted(v.items())) for v in per.values()}) == 50
    assert sorted((r.replicate, r.scenario_id, r.m) for r in RS.bootstrap_draws(ids, n_boot=50).collect()) == sorted((r.replicate, r.scenario_id, r.m) for r in d)


def test_identity_draw_equals_point(spark, table):
    rows, df = table
    sc = df.select("scenario_id", "label", "x", "w")
    draws = df.select("scenario_id").distinct().select(F.lit(0).alias("replicate"), "scenario_id", F.lit(1).alias("m"))
    rep = RS.paired_metric_replicates(sc, draws, "label", F.col("w"), {"one": "x", "two": "x"}).collect()
    point = M.curve_metrics(sc, [], "label", "x", F.col("w")).first()
    assert all(r.pr_auc == pytest.approx(point.pr_auc) and r.auroc == pytest.approx(point.auroc) for r in rep)


def test_twice_drawn_block_weighs_twice(spark):
    sc = spark.createDataFrame([("a", 1, 0.9, 0.5), ("a", 0, 0.2, 0.5), ("b", 0, 0.8, 1.0)], "scenario_id string, y int, p double, w double")
    draws = spark.createDataFrame([(0, "a", 2)], "replicate int, scenario_id string, m long")
    r = RS.paired_metric_replicates(sc, draws, "y", F.col("w"), {"m": "p"}).first()
    assert r.pr_auc == pytest.approx(1.0) and r.auroc == pytest.approx(1.0)


def test_same_model_has_no_difference(spark, table):
    _, df = table
    r = RS.paired_delta_interval(df, "label", F.col("w"), {"same": ("two", "one")}, {"one": "x", "two": "x"}, n_boot=5).first()
    assert r.point_delta_pr_auc == 0.0 and r.bootstrap_mean_delta == 0.0 and r.verdict_status == "NOT_CONFIRMED"


@pytest.mark.parametrize("values,p", [([1.0] * 1000, 1 / 1001), ([1.0] * 500 + [-1.0] * 500, 1.0)])
def test_empirical_p(spark, values, p):
    assert spark.createDataFrame([(v,) for v in values], "d double").agg(RS.empirical_p(F.col("d")).alias("p")).first().p == pytest.approx(p)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.01]
    got = {r.feature_name: r.fdr_q for r in RS.bh_fdr(spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature_name string, p double"), "p").collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * 5 / np.arange(1, 6))[::-1])[::-1]
    assert [got[f"f{i}"] for i in order] == pytest.approx(list(q))


def test_ridge(spark):
    rng = np.random.default_rng(1)
    X, w = rng.normal(size=(200, 3)) + 2, rng.uniform(0.5, 2, 200)
    y = X @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(b), float(c)) for r, b, c in zip(X, y, w)], "a double, b double, c double, y double, w double")
    f = L.ridge_fits(df, ["a", "b", "c"], ["y"], weight="w")["y"]
    mx, my = np.average(X, axis=0, weights=w), np.average(y, weights=w)
    Xc = X - mx
    beta = np.linalg.solve((Xc * w[:, None]).T @ Xc + np.eye(3), (Xc * w[:, None]).T @ (y - my))
    assert f.coef == pytest.approx(list(beta)) and f.intercept == pytest.approx(my - mx @ beta)
    assert df.agg(F.sum(F.col("w") * f.residual())).first()[0] == pytest.approx(0.0, abs=1e-8)


def test_permutation_is_one_to_one_within_strata(spark):
    df = spark.createDataFrame([(f"s{i}", i % 3, float(i), float(-i)) for i in range(120)], "scenario_id string, stratum int, keep double, ctx double")
    out = PM.permute_within(df, ["ctx"], ["scenario_id"], ["stratum"], seed=41).collect()
    assert len(out) == 120 and all(r.keep == float(r.scenario_id[1:]) for r in out)
    assert sorted(r.ctx for r in out) == sorted(-float(i) for i in range(120))
    assert all(int(-r.ctx) % 3 == r.stratum for r in out) and sum(r.ctx != -r.keep for r in out) > 90
    other = PM.permute_within(df, ["ctx"], ["scenario_id"], ["stratum"], seed=42).collect()
    assert {r.scenario_id: r.ctx for r in out} != {r.scenario_id: r.ctx for r in other}


def test_student_p_values(spark):
    from nearmiss.operators.validity import spearman_p
    # rho = 0.5, n = 20: t = 2.449490 on 18 df; rho = 0.1, n = 100: t = 0.994937 on 98 df.
    df = spark.createDataFrame([(0.5, 20), (0.1, 100), (0.0, 10), (-0.5, 20)], "r double, n int").select(spearman_p(F.col("r"), F.col("n")).alias("p"))
    got = [r.p for r in df.collect()]
    assert got == pytest.approx([0.024769, 0.322213, 1.0, 0.024769], abs=2e-5)


def test_positions_and_overlap_with_ties(spark):
    rows = [(f"s{i:03d}", float(i // 7 % 5), float(i % 11)) for i in range(120)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "scenario_id string, a double, b double")
    order = lambda c: [r[0] for r in sorted((r for r in rows if r[c] is not None), key=lambda r: (-r[c], r[0]))]
    for name, c in (("a", 1), ("b", 2)):
        got = {r.scenario_id: r.pos for r in RK.positions(df, name, 40).collect()}
        assert got == {s: i for i, s in enumerate(order(c)[:40], 1)}
    got = {r.k: r.overlap for r in RK.top_k_overlap(df, df, "a", "b", [10, 40, 500]).collect()}
    assert got[10] == len(set(order(1)[:10]) & set(order(2)[:10])) / 10 and got[40] == len(set(order(1)[:40]) & set(order(2)[:40])) / 40 and got[500] is None


def test_replicates_over_ranges_and_ties(spark, monkeypatch):
    import random
    rng = random.Random(2)
    data = [(f"s{i % 9}", int(rng.random() < 0.4), rng.choice([0.1, 0.25, 0.5, rng.random()]), rng.choice([0.5, rng.random()]), 0.5 + i % 3) for i in range(300)]
    sc = spark.createDataFrame(data, "scenario_id string, y int, p double, q double, w double")
    draws = RS.bootstrap_draws(sc, n_boot=6)
    rows = sc.join(draws, "scenario_id").withColumn("wm", F.col("w") * F.col("m"))
    want = {(r.replicate, n): r for n in ("p", "q") for r in M.curve_metrics(rows, ["replicate"], "y", n, F.col("wm")).collect()}
    monkeypatch.setattr(RS, "_RANGE_ROWS", 40)
    monkeypatch.setattr(RS, "_CHUNK", 5)
    got = RS.paired_metric_replicates(sc, draws, "y", F.col("w"), {"p": "p", "q": "q"}).collect()
    assert len(got) == 12
    for r in got:
        assert r.pr_auc == pytest.approx(want[r.replicate, r.model].pr_auc) and r.auroc == pytest.approx(want[r.replicate, r.model].auroc)


def test_packed_draws(spark):
    draws = spark.createDataFrame([(0, "a", 300), (2, "a", 1), (1, "b", 2)], "replicate int, scenario_id string, m long")
    got = {r.scenario_id: RS._multiplicities(bytes(r.m)).tolist() for r in RS.packed_draws(draws, 3).collect()}
    assert got == {"a": [300, 0, 1], "b": [0, 2, 0]}


@pytest.mark.parametrize("range_rows", [20_000, 150])
def test_bootstrap_spearman_against_resampled_rows(spark, monkeypatch, range_rows):
    """Packed multiplicities give what ranking the drawn rows gives: ties beyond a chunk, weights, several ranges, a constant group."""
    from nearmiss.operators import resample
    monkeypatch.setattr(resample, "_RANGE_ROWS", range_rows)
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 12}", g, float(rng.integers(0, 9)) if i % 3 else 4.0, float(np.round(rng.normal() + (g == "a|{b}") * i / 900, 2)), float(rng.uniform(0.1, 2)))
            for g in ("a|{b}", "c") for i in range(900)] + [(f"s{i}", "flat", 1.0, float(i), 1.0) for i in range(12)] + [("s0", "c", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scenario_id string, g string, x double, y double, w double")
    draws = resample.bootstrap_draws(df.filter("scenario_id <> 's11'"), n_boot=7)
    counts = {(r.replicate, r.scenario_id): r.m for r in draws.collect()}
    got = {(r.replicate, r.g): (r.rho, r.n) for r in resample.bootstrap_spearman(df, ["g"], "x", "y", draws, weight=F.col("w")).collect()}
    assert set(got) == {(b, g) for b in range(7) for g in ("a|{b}", "c", "flat")}

    def ranks(v, m):
        return np.array([m[v < t].sum() + (m[v == t].sum() + 1) / 2 for t in v])

    for (b, g), (rho, n) in got.items():
        own = [r for r in rows if r[1] == g and r[2] is not None and counts.get((b, r[0]), 0)]
        m = np.array([counts[b, r[0]] for r in own], float)
        x, y, w = (np.array([r[i] for r in own]) for i in (2, 3, 4))
        assert n == m.sum()
        if g == "flat":
            assert rho is None
            continue
        cov = np.cov(ranks(x, m), ranks(y, m), aweights=w * m)
        assert rho == pytest.approx(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]), abs=1e-10)
    assert resample.bootstrap_spearman(df.limit(0), ["g"], "x", "y", draws).count() == 0
