"""Map look-ups against brute force, with points near, far and beyond every grid level."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmiss.operators.mapjoin import lane_context, lane_headings, nearest_distance


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(3)
    pos, pts = [], []
    for s, spread in (("near", 60), ("wide", 3000), ("huge", 90_000)):
        for t in range(25):
            x, y = rng.uniform(-spread, spread, 2)
            pos.append((s, t, float(x), float(y)))
        for kind, n in (("lane", 400), ("road_edge", 60), ("stop_sign", 1)):
            for i in range(n):
                x, y = rng.uniform(-spread, spread, 2)
                pts.append((s, i // 40, kind, i % 40, float(x), float(y)))
    pos += [("near", 90, 1e6, -1e6), ("near", 91, 25.0, 50.0), ("near", 92, -25.0, 0.0), ("no_map", 0, 1.0, 1.0)]
    pts += [("near", 99, "crosswalk", 0, 25.0, 50.0), ("near", 99, "crosswalk", 1, None, 1.0), ("no_ego", 1, "lane", 0, 0.0, 0.0)]
    return (spark.createDataFrame(pos, "scenario_id string, time_index int, x0 double, y0 double"),
            spark.createDataFrame(pts, "scenario_id string, feature_id long, feature_type string, point_index int, x double, y double"))


def test_nearest_distance_is_exact(scene):
    pos, pts = scene
    d = F.sqrt((F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0")))
    want = {tuple(r) for r in pos.join(pts.dropna(), "scenario_id").groupBy("scenario_id", "time_index", "feature_type").agg(F.min(d)).collect()}
    got = [tuple(r) for r in nearest_distance(pos, pts).select("scenario_id", "time_index", "feature_type", "distance_m").collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert ("near", 91, "crosswalk", 0.0) in want and not any(r[0] == "no_map" for r in got)


def test_lane_context_counts_every_point_in_reach(scene):
    pos, pts = scene
    lanes = lane_headings(pts)
    d2 = (F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2
    want = {tuple(r) for r in pos.join(lanes, "scenario_id").filter(d2 <= 2500).groupBy("scenario_id", "time_index").agg(F.count("*").cast("double")).collect()}
    got = {tuple(r) for r in lane_context(pos, pts).select("scenario_id", "time_index", "lane_points").collect()}
    assert got == want and len(want) > 20


def test_no_lookup_is_keyed_by_the_scenario_alone(scene):
    """Every join of the plan names a cell; nothing meets all cells of its scenario."""
    pos, pts = scene
    for df in (nearest_distance(pos, pts), lane_context(pos, pts.filter("feature_type = 'lane'"))):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
        assert joins and all(any(c in line for c in ("cx#", "gx#", "chunk#")) for line in joins)


def test_empty_tables(scene):
    pos, pts = scene
    for p, m in ((pos.limit(0), pts), (pos, pts.limit(0))):
        assert nearest_distance(p, m).count() == 0 and lane_context(p, m).count() == 0
