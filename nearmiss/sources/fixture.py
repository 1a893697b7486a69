"""Scenario tables derived from the driver's star-schema tables.

Every query of the catalog runs on these views, so its work grows with
`lineitem`. The grouping collapses a table of any size to at most 91 x 7
states per scenario; partial aggregation happens before the shuffle.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

STATES_SQL = """
SELECT scenario_id, time_index, track_id, timestamp_seconds, is_sdc, is_object_of_interest, object_type, valid,
       CASE WHEN valid THEN cx END AS center_x, CASE WHEN valid THEN cy END AS center_y,
       CASE WHEN valid THEN cz END AS center_z,
       CASE WHEN valid THEN vx END AS velocity_x, CASE WHEN valid THEN vy END AS velocity_y,
       CASE WHEN valid THEN hd END AS heading, CASE WHEN valid THEN len END AS length,
       CASE WHEN valid THEN wid END AS width, CASE WHEN valid THEN CAST(1.5 AS DOUBLE) END AS height
FROM (
SELECT CAST(l_suppkey AS STRING) AS scenario_id,
       CAST(l_orderkey % 91 AS INT) AS time_index,
       l_linenumber AS track_id,
       CAST(l_orderkey % 91 AS DOUBLE) / CAST(10 AS DOUBLE) AS timestamp_seconds,
       (l_linenumber = 1) AS is_sdc,
       (l_linenumber = 2) AS is_object_of_interest,
       CASE WHEN l_linenumber <= 4 THEN 'TYPE_VEHICLE' WHEN l_linenumber = 5 THEN 'TYPE_PEDESTRIAN'
            WHEN l_linenumber = 6 THEN 'TYPE_CYCLIST' ELSE 'TYPE_OTHER' END AS object_type,
       MIN(l_tax) < CAST(0.075 AS DOUBLE) AS valid,
       MIN(l_extendedprice % CAST(121 AS DOUBLE)) - CAST(60.5 AS DOUBLE) AS cx,
       MIN((l_extendedprice * CAST(7 AS DOUBLE)) % CAST(61 AS DOUBLE)) - CAST(30.5 AS DOUBLE) AS cy,
       MIN(l_discount) AS cz,
       (MIN(l_quantity) - CAST(25.5 AS DOUBLE)) / CAST(2 AS DOUBLE) AS vx,
       MIN(l_discount * CAST(50 AS DOUBLE)) - CAST(2.5 AS DOUBLE) AS vy,
       CAST(MIN(l_partkey) % 8 AS DOUBLE) * CAST(0.7853981633974483 AS DOUBLE) AS hd,
       CASE WHEN l_linenumber <= 4 THEN CAST(4.5 AS DOUBLE) WHEN l_linenumber = 5 THEN CAST(0.8 AS DOUBLE)
            ELSE CAST(1.8 AS DOUBLE) END AS len,
       CASE WHEN l_linenumber <= 4 THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS wid
FROM {lineitem} GROUP BY l_suppkey, l_orderkey % 91, l_linenumber) AS s
"""

# 14 features of up to 7 points per scenario; some points have no position.
MAP_SQL = """
SELECT CAST(l_suppkey AS STRING) AS scenario_id, CAST(l_partkey % 14 AS BIGINT) AS feature_id,
       CASE WHEN l_partkey % 14 < 6 THEN 'lane' WHEN l_partkey % 14 < 8 THEN 'road_edge'
            WHEN l_partkey % 14 = 8 THEN 'crosswalk' WHEN l_partkey % 14 = 9 THEN 'stop_sign'
            WHEN l_partkey % 14 = 10 THEN 'speed_bump' WHEN l_partkey % 14 = 11 THEN 'road_line'
            WHEN l_partkey % 14 = 12 THEN 'driveway' ELSE 'crosswalk' END AS feature_type,
       CAST(l_orderkey % 7 AS INT) AS point_index,
       CASE WHEN MAX(l_quantity) > 2 THEN MIN((l_extendedprice * CAST(3 AS DOUBLE)) % CAST(161 AS DOUBLE)) - CAST(80.5 AS DOUBLE) END AS x,
       CASE WHEN MAX(l_quantity) > 2 THEN MIN((l_extendedprice * CAST(5 AS DOUBLE)) % CAST(101 AS DOUBLE)) - CAST(50.5 AS DOUBLE) END AS y,
       CASE WHEN MAX(l_quantity) > 2 THEN CAST(0 AS DOUBLE) END AS z
FROM {lineitem} GROUP BY l_suppkey, l_partkey % 14, l_orderkey % 7
"""

# Up to 4 signal lanes per frame; codes 0..9, of which 9 has no name.
SIGNAL_SQL = """
SELECT scenario_id, time_index, lane_id, state_code,
       CASE state_code WHEN 0 THEN 'LANE_STATE_UNKNOWN' WHEN 1 THEN 'LANE_STATE_ARROW_STOP'
            WHEN 2 THEN 'LANE_STATE_ARROW_CAUTION' WHEN 3 THEN 'LANE_STATE_ARROW_GO' WHEN 4 THEN 'LANE_STATE_STOP'
            WHEN 5 THEN 'LANE_STATE_CAUTION' WHEN 6 THEN 'LANE_STATE_GO' WHEN 7 THEN 'LANE_STATE_FLASHING_STOP'
            WHEN 8 THEN 'LANE_STATE_FLASHING_CAUTION' ELSE 'UNKNOWN_9' END AS signal_state,
       stop_point_x, stop_point_y
FROM (
SELECT CAST(l_suppkey AS STRING) AS scenario_id, CAST(l_orderkey % 91 AS INT) AS time_index,
       CAST(l_partkey % 4 AS BIGINT) AS lane_id,
       CAST(MIN(l_quantity) AS INT) % 10 AS state_code,
       CASE WHEN MIN(l_tax) > 0 THEN MIN((l_extendedprice * CAST(11 AS DOUBLE)) % CAST(181 AS DOUBLE)) - CAST(90.5 AS DOUBLE) END AS stop_point_x,
       CASE WHEN MIN(l_tax) > 0 THEN MIN((l_extendedprice * CAST(13 AS DOUBLE)) % CAST(81 AS DOUBLE)) - CAST(40.5 AS DOUBLE) END AS stop_point_y
FROM {lineitem} GROUP BY l_suppkey, l_orderkey % 91, l_partkey % 4) AS s
"""

# Two models' probabilities (with ties) and a label, per frame.
SCORES_SQL = """
SELECT CAST(l_suppkey AS STRING) AS scenario_id, CAST(l_orderkey % 91 AS INT) AS time_index,
       CASE WHEN MIN(l_quantity) <= 12 THEN 1 ELSE 0 END AS y,
       FLOOR((CAST(50 AS DOUBLE) - MIN(l_quantity) + MIN(l_extendedprice % CAST(60 AS DOUBLE))) / CAST(1.1 AS DOUBLE)) / CAST(100 AS DOUBLE) AS p_base,
       FLOOR((CAST(50 AS DOUBLE) - MIN(l_quantity) + MIN(l_extendedprice % CAST(30 AS DOUBLE))) / CAST(0.8 AS DOUBLE)) / CAST(100 AS DOUBLE) AS p_full,
       COUNT(*) AS n_lines, FLOOR(MIN(l_extendedprice % CAST(70 AS DOUBLE)) * CAST(10 AS DOUBLE)) / CAST(10 AS DOUBLE) AS gap_m
FROM {lineitem} GROUP BY l_suppkey, l_orderkey % 91
"""

# Predicted log-TTC distribution and observed outcome, per frame.
PREDICTIONS_SQL = """
SELECT CAST(l_suppkey AS STRING) AS scenario_id, CAST(l_orderkey % 91 AS INT) AS time_index,
       CAST(l_orderkey % 91 AS DOUBLE) / CAST(10 AS DOUBLE) AS timestamp_seconds,
       MAX(l_discount) * CAST(10 AS DOUBLE) AS pred_p_exposure,
       MIN(l_quantity) / CAST(25 AS DOUBLE) AS pred_mu,
       CAST(0.7 AS DOUBLE) + MIN(l_tax) * CAST(5 AS DOUBLE) AS pred_sigma,
       LN(CAST(0.5 AS DOUBLE) + MIN(l_extendedprice % CAST(9 AS DOUBLE))) AS y_log_ttc,
       CASE WHEN MIN(l_discount) < CAST(0.075 AS DOUBLE) THEN 1 ELSE 0 END AS exposure_flag,
       CASE WHEN MIN(l_discount) >= CAST(0.075 AS DOUBLE) THEN 'no_exposure'
            WHEN MIN(l_quantity) < 20 THEN 'event' ELSE 'right_censored' END AS target_status
FROM {lineitem} GROUP BY l_suppkey, l_orderkey % 91
"""

# One steady track per (supplier, line number): speed 0 to 22.9 m/s, some bent, some short, some with a missing frame.
SMOOTH_SQL = """
SELECT CAST(l_suppkey AS STRING) AS scenario_id, l_linenumber AS track_id, CAST(MIN(l_orderkey) % 230 AS DOUBLE) / CAST(10 AS DOUBLE) AS v,
       CAST(MIN(l_partkey) % 3 AS DOUBLE) * CAST(0.4 AS DOUBLE) AS bend, CASE WHEN MIN(l_partkey) % 11 = 0 THEN 8 ELSE 91 END AS n_frames,
       CASE WHEN MIN(l_partkey) % 11 = 1 THEN 40 ELSE -1 END AS missing
FROM {lineitem} GROUP BY l_suppkey, l_linenumber
"""

VIEWS = {"smooth_track": SMOOTH_SQL, "agent_state": STATES_SQL, "map_feature": MAP_SQL, "dynamic_signal": SIGNAL_SQL,
         "scores": SCORES_SQL, "predictions": PREDICTIONS_SQL}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name], lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def states(spark, sf_dir):
    return view(spark, sf_dir, "agent_state")


def smooth_states(spark, sf_dir):
    """Actor table of steady tracks side by side, on the grid of 91 frames."""
    t = F.col("time_index")
    rows = view(spark, sf_dir, "smooth_track").withColumn("time_index", F.explode(F.sequence(F.lit(0), F.lit(90)))).filter((t < F.col("n_frames")) & (t != F.col("missing")))
    track, vehicle = F.col("track_id"), F.col("track_id") <= 4
    return rows.select(
        "scenario_id", "time_index", "track_id", (t / 10.0).alias("timestamp_seconds"), (track == 1).alias("is_sdc"),
        F.when(vehicle, "TYPE_VEHICLE").when(track == 5, "TYPE_PEDESTRIAN").when(track == 6, "TYPE_CYCLIST").otherwise("TYPE_OTHER").alias("object_type"), F.lit(True).alias("valid"),
        (F.col("v") * t / 10.0 + (track - 1) * 2.0).alias("center_x"), ((track - 1) * 2.5 + F.col("bend") * F.sin(t / 15.0)).alias("center_y"),
        F.col("v").alias("velocity_x"), F.lit(0.0).alias("velocity_y"), F.lit(0.0).alias("heading"), F.when(vehicle, 4.5).otherwise(1.8).alias("length"), F.when(vehicle, 2.0).otherwise(0.8).alias("width"))


def mixed_states(spark, sf_dir):
    """The scattered scenarios next to the steady ones, whose ids start with s: tracks that get lost and tracks that last."""
    steady = smooth_states(spark, sf_dir).withColumns({
        "scenario_id": F.concat(F.lit("s"), "scenario_id"), "is_object_of_interest": F.lit(False), "center_z": F.lit(0.0), "height": F.lit(1.5)})
    return states(spark, sf_dir).unionByName(steady)


def map_points(spark, sf_dir):
    return view(spark, sf_dir, "map_feature")


def mixed_map_points(spark, sf_dir):
    """The map of each scenario, also for the steady one of the same number."""
    points = map_points(spark, sf_dir)
    return points.unionByName(points.withColumn("scenario_id", F.concat(F.lit("s"), "scenario_id")))


def signals(spark, sf_dir):
    return view(spark, sf_dir, "dynamic_signal")


def scores(spark, sf_dir):
    return view(spark, sf_dir, "scores")


def predictions(spark, sf_dir):
    return view(spark, sf_dir, "predictions")


def records(spark, sf_dir):
    """Nested scenario records rebuilt from the flat views, as a reader would find them.

    A record holds its whole scenario by nature; here that is at most 7 tracks
    x 91 states, 98 map points and 364 signal rows.
    """
    from pyspark.sql import functions as F
    from nearmiss.sources.records import RECORD

    s = states(spark, sf_dir)
    codes = F.create_map(*[F.lit(x) for kv in {"TYPE_VEHICLE": 1, "TYPE_PEDESTRIAN": 2, "TYPE_CYCLIST": 3, "TYPE_OTHER": 7}.items() for x in kv])
    fields = ["valid", "center_x", "center_y", "center_z", "velocity_x", "velocity_y", "heading", "length", "width", "height"]
    state = F.struct(*[F.col(f) if f == "valid" else F.coalesce(f, F.lit(0.0)).alias(f) for f in fields])
    tracks = s.groupBy("scenario_id", "track_id").agg(
        F.max(codes[F.col("object_type")]).alias("code"),
        F.map_from_entries(F.collect_list(F.struct("time_index", state.alias("s")))).alias("by_time"))
    blank = F.struct(F.lit(False).alias("valid"), *[F.lit(0.0).alias(f) for f in fields[1:]])
    dense = F.transform(F.sequence(F.lit(0), F.lit(90)), lambda t: F.coalesce(F.col("by_time")[t], blank))
    tracks = tracks.select("scenario_id", F.struct(F.col("track_id").cast("long").alias("id"), F.col("code").alias("object_type"), dense.alias("states")).alias("t"))
    # The ego is track 1, so its position in the sorted list is 0 where it exists.
    tracks = tracks.groupBy("scenario_id").agg(F.array_sort(F.collect_list("t")).alias("tracks"))
    m = map_points(spark, sf_dir).groupBy("scenario_id", "feature_id", "feature_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("point_index", "x", "y", "z"))),
                    lambda p: F.when(p["x"].isNotNull(), F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))).alias("pts"))
    one = lambda kind, value: F.when(F.col("feature_type") == kind, value).alias(kind)
    line, area = F.struct(F.col("pts").alias("polyline")), F.struct(F.col("pts").alias("polygon"))
    m = m.select("scenario_id", F.struct(
        F.col("feature_id").alias("id"), one("lane", line), one("road_line", line), one("road_edge", line), one("crosswalk", area),
        one("speed_bump", area), one("stop_sign", F.struct(F.col("pts")[0].alias("position"))), one("driveway", area)).alias("f"))
    m = m.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct(F.col("f.id").alias("id"), "f"))).alias("fs"))
    m = m.select("scenario_id", F.transform("fs", lambda x: x["f"]).alias("map_features"))
    sig = signals(spark, sf_dir).groupBy("scenario_id", "time_index").agg(F.array_sort(F.collect_list(F.struct(
        F.col("lane_id").alias("lane"), F.col("state_code").alias("state"),
        F.when(F.col("stop_point_x").isNotNull(), F.struct(F.col("stop_point_x").alias("x"), F.col("stop_point_y").alias("y"))).alias("stop_point")))).alias("ls"))
    sig = sig.groupBy("scenario_id").agg(F.map_from_entries(F.collect_list(F.struct("time_index", "ls"))).alias("by_time"))
    empty = F.array().cast("array<struct<lane:bigint,state:int,stop_point:struct<x:double,y:double>>>")
    sig = sig.select("scenario_id", F.transform(F.sequence(F.lit(0), F.lit(90)), lambda t: F.struct(
        F.coalesce(F.col("by_time")[t], empty).alias("lane_states"))).alias("dynamic_map_states"))
    out = tracks.join(m, "scenario_id", "left").join(sig, "scenario_id", "left").select(
        "scenario_id", F.transform(F.sequence(F.lit(0), F.lit(90)), lambda t: t.cast("double") / 10.0).alias("timestamps_seconds"), "tracks",
        F.lit(0).alias("sdc_track_index"), F.array(F.lit(2).cast("long")).alias("objects_of_interest"), "map_features", "dynamic_map_states",
        # Every other scenario also carries its first track's valid positions as a planned path.
        F.when(F.col("scenario_id").cast("int") % 2 == 0, F.transform(F.filter(F.col("tracks")[0]["states"], lambda p: p["valid"]), lambda p: F.struct(
            p["center_x"].alias("x"), p["center_y"].alias("y"), p["center_z"].alias("z"))))
        .otherwise(F.array().cast("array<struct<x:double,y:double,z:double>>")).alias("sdc_paths"))
    return out.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields])
