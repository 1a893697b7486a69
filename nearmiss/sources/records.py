"""Nested scenario records to flat tables."""
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.constants import ALIASES, OBJECT_TYPES, SIGNAL_STATES
from nearmiss.functions.columns import decode_enum, flag
from nearmiss.session import durable

_POINT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "z")])
_LINE = T.StructType([T.StructField("polyline", T.ArrayType(_POINT))])
_AREA = T.StructType([T.StructField("polygon", T.ArrayType(_POINT))])
_STATE = T.StructType([
    T.StructField("valid", T.BooleanType()),
    # Files that hold some of these in single precision are read alike; nothing is narrowed, which could move a touching pair apart.
    *[T.StructField(n, T.DoubleType()) for n in ("center_x", "center_y", "center_z", "velocity_x", "velocity_y", "heading", "length", "width", "height")]])

RECORD = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("timestamps_seconds", T.ArrayType(T.DoubleType())),
    T.StructField("tracks", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("object_type", T.IntegerType()),
        T.StructField("states", T.ArrayType(_STATE))]))),
    T.StructField("sdc_track_index", T.IntegerType()),
    T.StructField("objects_of_interest", T.ArrayType(T.LongType())),
    T.StructField("map_features", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("lane", _LINE), T.StructField("road_line", _LINE),
        T.StructField("road_edge", _LINE), T.StructField("crosswalk", _AREA), T.StructField("speed_bump", _AREA),
        T.StructField("stop_sign", T.StructType([T.StructField("position", _POINT)])),
        T.StructField("driveway", _AREA)]))),
    T.StructField("dynamic_map_states", T.ArrayType(T.StructType([
        T.StructField("lane_states", T.ArrayType(T.StructType([
            T.StructField("lane", T.LongType()), T.StructField("state", T.IntegerType()),
            T.StructField("stop_point", T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))])))]))),
    T.StructField("sdc_paths", T.ArrayType(_POINT)),
])

NUMERIC = ["center_x", "center_y", "center_z", "velocity_x", "velocity_y", "heading", "length", "width", "height"]
_SHAPES = {"lane": "polyline", "road_line": "polyline", "road_edge": "polyline", "crosswalk": "polygon", "speed_bump": "polygon"}


def read_scenarios(spark, paths, *, fmt: str = "parquet", splits=None, max_scenarios: int | None = None) -> DataFrame:
    """Nested records of the chosen splits (a `split=` path part), one per scenario id.

    The first by file name and row stays; a null id counts as one id. Parquet numbers its rows, so the others are found from ids and
    positions alone. Formats that do not are reduced by content.
    """
    df = spark.read.schema(RECORD).format(fmt).load(paths)
    df = df.withColumn("source_file", F.col("_metadata.file_path"))
    if fmt == "parquet":
        df = df.withColumn("position", F.col("_metadata.row_index"))
    if splits:
        part = F.regexp_extract("source_file", r"split=([^/]+)", 1)
        df = df.filter(part.isin(*splits))
    df = without_repeats(df).drop("position") if fmt == "parquet" else distinct_scenarios(df)
    if max_scenarios is not None:
        df = df.join(df.select("scenario_id").orderBy("scenario_id").limit(max_scenarios), "scenario_id", "left_semi")
    return df


def without_repeats(records: DataFrame, *, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One record per id: the first by (source_file, position).

    Only ids and positions are shuffled. The places of the repeats are
    broadcast while they are at most `broadcast_rows`, so that records stay in
    their tasks; more of them are joined by place, which moves the records.
    """
    place = F.struct("source_file", "position")
    keys = records.select("scenario_id", place.alias("place"))
    repeated = keys.groupBy("scenario_id").agg(F.min("place").alias("kept"), F.count("*").alias("n")).filter("n > 1")
    same = keys["scenario_id"].eqNullSafe(repeated["scenario_id"])
    losers = durable(keys.join(repeated, same).filter(F.col("place") != F.col("kept")).select("place.*"))
    if losers.count() <= broadcast_rows:
        losers = F.broadcast(losers)
    return records.join(losers, ["source_file", "position"], "left_anti").select(*records.columns)


#: Ids that are broadcast to find their records; more of them are joined by shuffling the records.
_BROADCAST_IDS = 200_000


def by_ids(records: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """records joined left_semi or left_anti to stored ids (a null id is an id); the records stay in their tasks while the ids are few."""
    few = F.broadcast(ids) if ids.count() <= _BROADCAST_IDS else ids
    return records.join(few, records["scenario_id"].eqNullSafe(few["scenario_id"]), how)


def distinct_scenarios(records: DataFrame) -> DataFrame:
    """One record per id: the first by file name, whichever task reads it first.

    Ids that come more than once are found first, and only their records are shuffled.
    """
    repeated = durable(records.groupBy("scenario_id").agg(F.count("*").alias("n")).filter("n > 1").select("scenario_id"))
    if repeated.isEmpty():
        return records
    order = F.struct(F.col("source_file"), F.xxhash64(*[c for c in records.columns]))
    body = F.struct(*records.columns)
    several = by_ids(records, repeated, "left_semi").groupBy("scenario_id").agg(F.min_by(body, order).alias("r")).select("r.*")
    return by_ids(records, repeated, "left_anti").unionByName(several)


def _has(c: str):
    return F.coalesce(F.size(c), F.lit(0))


def flatten_scenario(records: DataFrame) -> DataFrame:
    ts = F.col("timestamps_seconds")
    n = _has("timestamps_seconds")
    return records.select(
        "scenario_id", n.alias("n_timestamps"), _has("tracks").alias("n_tracks"), "sdc_track_index",
        _has("map_features").alias("n_map_features"), _has("dynamic_map_states").alias("n_dynamic_signal_steps"),
        _has("objects_of_interest").alias("n_objects_of_interest"), (_has("sdc_paths") > 0).alias("has_sdc_paths"),
        F.try_element_at(ts, F.lit(1)).alias("timestamp_start"), F.try_element_at(ts, F.lit(-1)).alias("timestamp_end"),
        F.when(n >= 2, F.try_element_at(ts, F.lit(-1)) - F.try_element_at(ts, F.lit(1))).otherwise(F.lit(0.0)).alias("duration_seconds"))


def flatten_agent_state(records: DataFrame) -> DataFrame:
    """Tracks x states. Numerics of invalid states are NULL, as is a time beyond the clock."""
    tracks = records.select("scenario_id", "timestamps_seconds", "sdc_track_index", "objects_of_interest",
                            F.posexplode("tracks").alias("track_index", "track"))
    rows = tracks.select(
        "scenario_id", "timestamps_seconds", F.col("track.id").alias("track_id"),
        decode_enum(F.col("track.object_type"), OBJECT_TYPES).alias("object_type"),
        (F.col("track_index") == F.col("sdc_track_index")).alias("is_sdc"),
        flag(F.array_contains("objects_of_interest", F.col("track.id"))).alias("is_object_of_interest"),
        F.posexplode("track.states").alias("time_index", "s"))
    ok = flag(F.col("s.valid"))
    return rows.select(
        "scenario_id", "time_index", F.get("timestamps_seconds", F.col("time_index")).alias("timestamp_seconds"),
        "track_id", "object_type", ok.alias("valid"),
        *[F.when(ok, F.col(f"s.{n}").cast("double")).alias(n) for n in NUMERIC], "is_sdc", "is_object_of_interest")


def flatten_frame_context(records: DataFrame) -> DataFrame:
    """Valid actors per class for every frame of the clock, frames without any included."""
    clock = records.select("scenario_id", F.posexplode("timestamps_seconds").alias("time_index", "timestamp_seconds"))
    track = records.select("scenario_id", F.explode("tracks").alias("t")).select(
        "scenario_id", F.col("t.object_type").alias("k"), F.posexplode("t.states").alias("time_index", "s"))
    seen = track.filter(flag(F.col("s.valid")))
    of = lambda code: F.count_if(flag(F.col("k") == code))
    counts = seen.groupBy("scenario_id", "time_index").agg(
        F.count("*").alias("n_valid_agents"), of(1).alias("n_vehicles"), of(2).alias("n_pedestrians"), of(3).alias("n_cyclists"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = clock.join(counts, ["scenario_id", "time_index"], "left").select(
        "scenario_id", "time_index", "timestamp_seconds", zero("n_valid_agents"), zero("n_vehicles"), zero("n_pedestrians"), zero("n_cyclists"))
    c = F.col
    return out.withColumn("n_other", c("n_valid_agents") - c("n_vehicles") - c("n_pedestrians") - c("n_cyclists"))


def flatten_map_features(records: DataFrame) -> DataFrame:
    """One row per shape point; a stop sign is one row whose position may be missing."""
    f = records.select("scenario_id", F.explode("map_features").alias("f"))
    shapes = {**_SHAPES, "stop_sign": None, "driveway": "polygon"}
    kind, points = F.lit(None).cast("string"), F.lit(None).cast(T.ArrayType(_POINT))
    for name, field in reversed(list(shapes.items())):
        here = F.col(f"f.{name}").isNotNull()
        value = F.array(F.col("f.stop_sign.position")) if field is None else F.col(f"f.{name}.{field}")
        kind = F.when(here, name).otherwise(kind)
        points = F.when(here, value).otherwise(points)
    rows = f.select("scenario_id", F.col("f.id").alias("feature_id"), kind.alias("feature_type"), F.posexplode(points).alias("point_index", "p"))
    return rows.select("scenario_id", "feature_id", "feature_type", "point_index", "p.x", "p.y", "p.z")


def flatten_dynamic_signals(records: DataFrame) -> DataFrame:
    frames = records.select("scenario_id", F.posexplode("dynamic_map_states").alias("time_index", "d"))
    rows = frames.select("scenario_id", "time_index", F.explode("d.lane_states").alias("s"))
    return rows.select("scenario_id", "time_index", F.col("s.lane").alias("lane_id"),
                       decode_enum(F.col("s.state"), SIGNAL_STATES).alias("signal_state"),
                       F.col("s.stop_point.x").alias("stop_point_x"), F.col("s.stop_point.y").alias("stop_point_y"))


def flatten_sdc_paths(records: DataFrame) -> DataFrame:
    return records.select("scenario_id", F.posexplode("sdc_paths").alias("point_index", "p")).select(
        "scenario_id", "point_index", "p.x", "p.y", "p.z")


def with_aliases(df: DataFrame) -> DataFrame:
    """Duplicate key columns under their alternative names."""
    return df.withColumns({a: F.col(c) for a, c in ALIASES.items() if c in df.columns})
