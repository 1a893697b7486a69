"""Trees that grow together: against a plain booster, whatever the partitions, and scored in SQL from their exported splits."""
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmiss.operators import boosting as B
from nearmiss.operators.permute import permute_within, permuted_copies

KW = {"weight": "w", "max_iter": 12, "max_depth": 3, "leaves": 6, "min_rows": 5, "bins": 16}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for i in range(600):
        a, b, c = rng.gauss(0, 1), rng.random(), float(rng.randrange(4))
        p = 1 / (1 + np.exp(-(2 * a + 3 * (b > 0.6) * (c == 2) - 1)))
        out.append((i, a if i % 50 else None, b, c, int(rng.random() < p), int(a > 0.5) if i % 40 else None, 0.5 + rng.random()))
    return out


@pytest.fixture(scope="module")
def train(spark, rows):
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int, z int, w double")


FITS = {"all": (["a", "b", "c"], "y"), "two": (["c", "b"], "y"), "other": (["a", "b", "c"], "z")}


@pytest.fixture(scope="module")
def model(train):
    return B.fit_together(train, FITS, **KW)


def plain(model, rows, features, label, max_iter=12, max_depth=3, leaves=6, min_rows=5, rate=0.1):
    """Best-first boosting on the same cuts, one node after the other."""
    at = {"a": 1, "b": 2, "c": 3, "y": 4, "z": 5, "w": 6}
    rows = [r for r in rows if r[at[label]] is not None]
    x = np.stack([np.searchsorted(model.cuts[model.place[f]], [r[at[f]] or 0.0 for r in rows], "left") for f in features])
    y, w = np.array([r[at[label]] for r in rows], float), np.array([r[6] for r in rows])
    margin = np.full(len(rows), np.log((w * y).sum() / (w * (1 - y)).sum()))
    for _ in range(max_iter):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def split(own):
            best = (1e-9, None)
            for j in range(len(features)):
                for cut in range(15):
                    left, right = own[x[j, own] <= cut], own[x[j, own] > cut]
                    if len(left) < min_rows or len(right) < min_rows:
                        continue
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[own].sum() ** 2 / h[own].sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
            return best

        whole = np.arange(len(rows))
        nodes = [(whole, 0, split(whole))]
        while len(nodes) < leaves:
            i = max(range(len(nodes)), key=lambda i: nodes[i][2][0] if nodes[i][1] < max_depth else 0)
            own, depth, (_, parts) = nodes[i]
            if parts is None or depth >= max_depth:
                break
            nodes[i:i + 1] = [(s, depth + 1, split(s)) for s in parts]
        for own, _, _ in nodes:
            margin[own] -= rate * g[own].sum() / h[own].sum()
    return {r[0]: 1 / (1 + np.exp(-m)) for r, m in zip(rows, margin)}


@pytest.mark.parametrize("fit", FITS)
def test_as_a_plain_booster(model, train, rows, fit):
    got = {r.id: r.p for r in model.score(train, {fit: "p"}).collect()}
    want = plain(model, rows, *FITS[fit])
    assert max(abs(got[i] - p) for i, p in want.items()) < 1e-6


def test_rows_may_lie_anywhere(spark, model, train):
    again = B.fit_together(train.repartition(7, "b"), FITS, **KW, cuts=model.cuts)
    pick = lambda m: {k: [(f.tolist(), c.tolist()) for f, c, _ in t.trees] for k, t in m.fits.items()}
    assert pick(again) == pick(model)


def test_sums_of_many_tasks(spark, train, model, monkeypatch):
    monkeypatch.setattr(B, "_SUMMED_AT_ONCE", 2)
    again = B.fit_together(train.repartition(5), {"two": FITS["two"]}, **{**KW, "max_iter": 2}, cuts=[model.cuts[model.place[c]] for c in ("b", "c")])
    assert [f.tolist() for f, _, _ in again.fits["two"].trees] == [f.tolist() for f, _, _ in model.fits["two"].trees[:2]]


def test_exported_splits_score_in_sql(spark, model, train):
    con = duckdb.connect()
    con.register("splits", model.export(spark).toPandas())
    con.register("x", train.select("id", F.expr("stack(3, 'a', coalesce(a, 0), 'b', b, 'c', c) AS (feature, v)")).toPandas())
    got = con.execute("""
        WITH RECURSIVE walk AS (
          SELECT DISTINCT id, fit, tree, 0 AS node FROM x, splits
          UNION ALL
          SELECT walk.id, walk.fit, walk.tree, 2 * walk.node + CASE WHEN x.v <= s.threshold THEN 1 ELSE 2 END
          FROM walk JOIN splits s ON s.fit = walk.fit AND s.tree = walk.tree AND s.node = walk.node AND s.feature IS NOT NULL JOIN x ON x.id = walk.id AND x.feature = s.feature)
        SELECT walk.id, walk.fit, 1 / (1 + exp(-(any_value(s.start) + sum(s.value)))) FROM walk JOIN splits s ON s.fit = walk.fit AND s.tree = walk.tree AND s.node = walk.node AND s.feature IS NULL
        GROUP BY 1, 2""").fetchall()
    want = {(r.id, n): r[n] for r in model.score(train, {n: n for n in FITS}).collect() for n in FITS}
    assert len(got) == len(want) and all(abs(want[i, n] - p) < 1e-9 for i, n, p in got)


def test_prune_keeps_the_best():
    gain = np.array([5.0, 1.0, 4.0, 9.0, 0.0, 3.0, 2.0])
    assert np.flatnonzero(B.prune(gain, 4)).tolist() == [0, 2, 5] and np.flatnonzero(B.prune(gain, 31)).tolist() == [0, 1, 2, 3, 5, 6]
    assert not B.prune(np.zeros(7), 4).any()


def test_one_label_only(spark, train):
    same = train.withColumn("y", F.lit(0))
    out = B.fit_together(same, {"n": (["a"], "y")}, **{**KW, "max_iter": 2}).score(same, {"n": "p"})
    assert out.agg(F.max("p")).first()[0] < 0.01


def test_copies_are_the_single_permutations(spark, train):
    keyed = train.withColumn("band", F.col("id") % 3)
    copies = {r.id: r for r in permuted_copies(keyed, ["b", "c"], ["id"], ["band"], seeds=(3, 9)).collect()}
    for seed in (3, 9):
        for r in permute_within(keyed, ["b", "c"], ["id"], ["band"], seed=seed).collect():
            assert (r.b, r.c) == (copies[r.id][f"b__{seed}"], copies[r.id][f"c__{seed}"])
