"""Ego-centric context features, past and present only."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.constants import E_DYNAMIC, E_HIST, E_STATIC, HISTORY_FRAMES, N_FRAMES, P_CLEAN, RADIUS_M
from nearmiss.functions import geometry as G
from nearmiss.functions.columns import flag
from nearmiss.operators.kinematics import kinematics
from nearmiss.operators.frames import frame_labels, scene_criticality
from nearmiss.operators.mapjoin import dispersion, lane_context, nearest_distance, signal_context
from nearmiss.operators.pairs import FRAME, ego_states, ego_track, frame_presence, full_state, not_null
from nearmiss.operators.profile import ordered
from nearmiss.session import durable_rows

# Frames that share a task in the history join; a third of the 91.
SPAN = 31


def ego_motion(presence: DataFrame) -> DataFrame:
    """Ego acceleration and yaw rate per frame, 0 where undefined."""
    ego = kinematics(ego_track(presence))
    return ego.select(*FRAME, F.coalesce("derived_accel_mps2", F.lit(0.0)).alias("ego_accel"),
                      F.coalesce("derived_yaw_rate_rps", F.lit(0.0)).alias("ego_yaw_rate"))


def ego_positions(presence: DataFrame) -> DataFrame:
    return ego_states(presence).select(*FRAME, F.col("e_center_x").alias("x0"), F.col("e_center_y").alias("y0"))


def past_actor_pairs(states: DataFrame, presence: DataFrame, focal: DataFrame, *, steps: int = HISTORY_FRAMES,
                     radius_m: float = RADIUS_M) -> DataFrame:
    """Usable actors of any class at frames u in [t - steps, t] against the ego state and focal actor of t.

    Frames t are cut into spans of `SPAN`; an actor row goes to the span of u and, near its end, to the next one too. A span's actors are
    streamed past its few ego rows, and what is grouped by span and frame later needs no further shuffle.
    """
    t, u = F.col("time_index"), F.col("u")
    span = lambda x: F.floor(x / F.lit(SPAN)).cast("int")
    ego = ego_states(presence).drop("ego_track_id").join(focal, FRAME, "left").withColumn("span", span(t))
    actors = (states.filter(~flag(F.col("is_sdc")) & full_state())
              .filter(not_null()).select("scenario_id", F.col("time_index").alias("u"), "track_id", "object_type", *G.prefixed("t_"))
              .filter(u >= 0).withColumn("span", F.explode(F.sequence(span(u), span(u + steps)))))
    pairs = G.with_relative_state(actors.hint("merge").join(ego, ["scenario_id", "span"]).filter(u.between(t - steps, t)))
    return (pairs.withColumnRenamed("pair_distance_m", "d").filter(F.col("d") <= radius_m)
            .withColumns({"is_focal": flag(F.col("track_id") == F.col("focal_id")), "closing": G.closing_speed("d")}))


def actor_context(past: DataFrame) -> DataFrame:
    """Dynamic context at t and the closing-pressure history, in two grouped passes."""
    c = F.col
    now = c("u") == c("time_index")
    other = ~c("is_focal")
    here, third = lambda x: F.when(now, x), lambda x: F.when(now & other, x)
    positive = F.greatest(c("closing"), F.lit(0.0))
    moving = c("d") > 1e-4
    pressure = F.when(other & moving, positive / F.greatest(F.lit(1.0), c("d")))
    lon, lat = G.in_heading_frame("dx", "dy", "e_heading")
    vlon, vlat = G.in_heading_frame("dvx", "dvy", "e_heading")
    focal = lambda x: F.max(F.when(now & c("is_focal"), x))
    within = lambda r: F.count_if(now & (c("d") <= r))
    kind = lambda *names: F.count_if(now & c("object_type").isin(*names))
    at = ["scenario_id", "span", "time_index"]
    per_u = past.groupBy(*at, "u").agg(
        F.coalesce(F.sum(pressure), F.lit(0.0)).alias("pressure"),
        within(30.0).alias("n30"), within(50.0).alias("n50"), within(70.0).alias("n70"),
        kind("TYPE_VEHICLE").alias("veh"), kind("TYPE_PEDESTRIAN").alias("ped"), kind("TYPE_CYCLIST").alias("cyc"),
        F.count(third(c("d"))).alias("n3"), F.min(third(c("d"))).alias("nearest"),
        F.avg(third(G.speed("t_"))).alias("spd"), F.stddev_pop(third(G.speed("t_"))).alias("spd_std"),
        F.avg(third(F.cos("t_heading"))).alias("mc"), F.avg(third(F.sin("t_heading"))).alias("ms"),
        F.max(third(F.when(moving, positive))).alias("pmax"), F.count_if(now & other & (c("closing") > 0)).alias("n_closing"),
        focal(lon).alias("lon"), focal(lat).alias("lat"), focal(vlon).alias("vlon"), focal(vlat).alias("vlat"),
        focal(G.speed("t_")).alias("fspd"))
    keep = [x for x in per_u.columns if x not in (*at, "u", "pressure")]
    first_u = F.greatest(c("time_index") - HISTORY_FRAMES, F.lit(0))
    return per_u.groupBy(*at).agg(
        *[F.max(here(c(x))).alias(x) for x in keep],
        F.sum("pressure").alias("p_total"), F.max("pressure").alias("p_peak"),
        F.max(here(c("pressure"))).alias("p_now"), F.max(F.when(c("u") == first_u, c("pressure"))).alias("p_first")).drop("span")


def composition_changes(states: DataFrame, *, include_ego: bool = False) -> DataFrame:
    """Frames at which the set of (non-ego) actors differs from the frame before.

    A set changed if some actor appears or has disappeared, so only each
    actor's own neighbouring rows are compared and no set is gathered.
    """
    track = W.partitionBy("scenario_id", "track_id").orderBy("time_index")
    kept = states if include_ego else states.filter(~flag(F.col("is_sdc")))
    rows = kept.select("scenario_id", "track_id", "time_index").distinct()
    t = F.col("time_index")
    rows = rows.withColumns({
        "came": F.when((t > 0) & F.coalesce(F.lag(t).over(track) != t - 1, F.lit(True)), t),
        "left": F.when((t + 1 < N_FRAMES) & F.coalesce(F.lead(t).over(track) != t + 1, F.lit(True)), t + 1)})
    return (rows.select("scenario_id", F.explode(F.array("came", "left")).alias("time_index"))
            .filter("time_index is not null").distinct().withColumn("changed", F.lit(1)))


def history_slope(last: Column, first: Column, steps: Column) -> Column:
    """Change per second over the window; 0 for a single frame."""
    return F.when(steps > 0, (last - first) / F.greatest(F.lit(0.1), steps * F.lit(0.1))).otherwise(F.lit(0.0))


def actor_history(frames: DataFrame, states: DataFrame) -> DataFrame:
    """Rolling actor counts and composition turnover over the frame and the ten before it."""
    w = ordered().rowsBetween(-HISTORY_FRAMES, 0)
    n = F.col("n_valid_targets_70m").cast("double")
    rows = frames.select(*FRAME, "n_valid_targets_70m").join(composition_changes(states), FRAME, "left")
    steps = F.least(F.col("time_index"), F.lit(HISTORY_FRAMES))
    return rows.select(
        *FRAME, F.avg(n).over(w).alias("n_mean"), F.stddev_pop(n).over(w).alias("n_std"),
        history_slope(n, F.first(n).over(w), steps).alias("n_slope"),
        F.coalesce(F.sum("changed").over(ordered().rowsBetween(1 - HISTORY_FRAMES, 0)), F.lit(0)).cast("double").alias("turnover"))


def _entropy(counts: list, total: Column) -> Column:
    out = F.lit(0.0)
    for n in counts:
        p = n / F.greatest(total, F.lit(1))
        out = out - F.when(p > 1e-6, p * F.log(F.greatest(p, F.lit(1e-6)))).otherwise(F.lit(0.0))
    return out


def physics_controls(frames: DataFrame, presence: DataFrame, context: DataFrame) -> DataFrame:
    """Twelve ego and focal-actor controls; the focal actor is the nearest by clearance."""
    c = F.col
    ego = ego_states(presence).select(*FRAME, G.speed("e_").alias("ego_speed")).join(ego_motion(presence), FRAME, "left")
    rows = frames.join(ego, FRAME).join(context, FRAME, "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    values = [c("ego_speed"), zero("ego_accel"), zero("ego_yaw_rate"), zero("lon"), zero("lat"), zero("vlon"), zero("vlat"), zero("fspd"),
              F.coalesce("focal_clearance_m", F.lit(RADIUS_M)), F.coalesce("focal_center_distance_m", F.lit(RADIUS_M)),
              flag(c("focal_actor_type") == "TYPE_VEHICLE").cast("double"),
              flag(c("focal_actor_type").isin("TYPE_PEDESTRIAN", "TYPE_CYCLIST")).cast("double")]
    return rows.select(*FRAME, *[v.alias(n) for n, v in zip(P_CLEAN, values)])


def static_context(presence: DataFrame, points: DataFrame, signals: DataFrame) -> DataFrame:
    """Seven map features per usable ego frame, plus the stop-signal count.

    Each look-up is stored by itself, so that the shuffles of one are gone before the next.
    """
    pos = ego_positions(presence)
    kinds = ["crosswalk", "stop_sign", "speed_bump", "road_edge"]
    near = nearest_distance(pos, points.filter(F.col("feature_type").isin(*kinds)))
    near = durable_rows(near.groupBy(*FRAME).agg(*[F.min(F.when(F.col("feature_type") == k, F.col("distance_m"))).alias(k) for k in kinds]))
    lanes, stops = durable_rows(lane_context(pos, points)), durable_rows(signal_context(pos, signals))
    rows = pos.select(*FRAME).join(near, FRAME, "left").join(lanes, FRAME, "left").join(stops, FRAME, "left")
    far, none = F.lit(100.0), F.lit(0.0)
    values = [*[F.coalesce(k, far) for k in kinds], F.coalesce("lane_points", none), F.coalesce("lane_dispersion", none), F.coalesce("signal_m", far)]
    return rows.select(*FRAME, *[v.alias(n) for n, v in zip(E_STATIC, values)], F.coalesce("stop_signals", none).alias(E_DYNAMIC[-1]))


def dynamic_context(presence: DataFrame, context: DataFrame) -> DataFrame:
    """Density, composition and third-party motion; defaults where nobody is around."""
    c = F.col
    rows = ego_states(presence).select(*FRAME).join(context, FRAME, "left")
    zero = lambda x: F.coalesce(c(x).cast("double"), F.lit(0.0))
    total = zero("n70")
    share = lambda x: F.when(total > 0, x / F.greatest(total, F.lit(1.0))).otherwise(F.lit(0.0))
    values = [zero("n30"), zero("n50"), total, share(zero("veh")), share(zero("ped") + zero("cyc")),
              F.when(total > 0, _entropy([zero("veh"), zero("ped"), zero("cyc")], total)).otherwise(F.lit(0.0)),
              F.coalesce("nearest", F.lit(RADIUS_M)), zero("spd"), zero("spd_std"),
              F.when(c("n3") > 0, dispersion(c("mc"), c("ms"))).otherwise(F.lit(0.0)), zero("pmax"), zero("p_now")]
    return rows.select(*FRAME, *[v.alias(n) for n, v in zip(E_DYNAMIC[:-1], values)])


def history_context(frames: DataFrame, states: DataFrame, presence: DataFrame, context: DataFrame) -> DataFrame:
    """Seven one-second history features."""
    c = F.col
    rows = ego_states(presence).select(*FRAME).join(actor_history(frames, states), FRAME).join(context, FRAME, "left")
    steps = F.least(c("time_index"), F.lit(HISTORY_FRAMES))
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    values = [c("n_mean"), c("n_std"), c("n_slope"), zero("p_total") / (steps + 1), zero("p_peak"),
              history_slope(zero("p_now"), zero("p_first"), steps), c("turnover")]
    return rows.select(*FRAME, *[v.alias(n) for n, v in zip(E_HIST, values)])


def focal_of(frames: DataFrame) -> DataFrame:
    return frames.select(*FRAME, F.col("focal_actor_id").alias("focal_id"))


def frame_feature_table(states: DataFrame, points: DataFrame, signals: DataFrame, *, presence: DataFrame | None = None,
                        frames: DataFrame | None = None) -> DataFrame:
    """Labels at 2 / 3 / 5 s, scenario-equal weight and 39 features for every valid frame.

    The per-frame tables that several feature groups read (ego presence, frame
    outcomes, actor context) are stored once, as are the map and history
    features, so that the shuffles behind them are gone before the last join;
    the actor table is read four times.
    """
    presence = durable_rows(frame_presence(states)) if presence is None else presence
    frames = durable_rows(scene_criticality(states, presence)) if frames is None else frames
    context = durable_rows(actor_context(past_actor_pairs(states, presence, focal_of(frames))))
    static = durable_rows(static_context(presence, points, signals))
    history = durable_rows(history_context(frames, states, presence, context))
    return (frame_labels(frames).select(*FRAME, "status", "target_ttc_s", "target_c_t", "target_y_tau_2s", "target_y_tau_3s",
                                        "target_y_tau_5s", "weight_scenario_equal")
            .join(physics_controls(frames, presence, context), FRAME, "left")
            .join(static, FRAME, "left")
            .join(dynamic_context(presence, context), FRAME, "left")
            .join(history, FRAME, "left"))


def scenario_feature_means(table: DataFrame, features: list) -> DataFrame:
    return table.groupBy("scenario_id").agg(*[F.avg(f).alias(f"{f}_mean") for f in features])
