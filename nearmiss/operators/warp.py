"""Re-timing of single tracks along their own path, as an augmentation job of one join and windows over short tracks.

A track has at most one row per frame. All windows share one partitioning and order, so the tracks are shuffled once.
"""
import math

from pyspark.sql import Column, DataFrame, functions as F

from nearmiss.operators.kinematics import track
from nearmiss.operators.splits import WARP_SEED, hash_sample
from nearmiss.session import durable

FRAME_S = 0.1

# Physical limits.
MAX_POS_JUMP_M = 2.0
MAX_ACCEL_MPS2 = 8.0
MAX_JERK_MPS3 = 15.0
MAX_HEADING_JUMP_RAD = 0.5
MAX_CROSS_TRACK_M = 1.0

KINEMATIC = ["center_x", "center_y", "velocity_x", "velocity_y", "heading", "length", "width"]


def select_scenarios(df: DataFrame, ratio: float = 0.20, seed: str = WARP_SEED) -> DataFrame:
    return df.filter(hash_sample(F.col("scenario_id"), ratio, seed))


TRACK = ["scenario_id", "track_id"]


def _slope(value: str) -> Column:
    """Change per second, from both neighbours where there are two."""
    here, ahead, back = F.col(value), F.lead(value).over(track()), F.lag(value).over(track())
    return F.when(back.isNull(), (ahead - here) / FRAME_S).when(ahead.isNull(), (here - back) / FRAME_S).otherwise((ahead - back) / (2 * FRAME_S))


def _track_verdicts(rows: DataFrame) -> DataFrame:
    """Per track: number of rows, its points, and the reason to refuse it without trying (NULL if none)."""
    finite = F.coalesce((F.abs("center_x") < float("inf")) & (F.abs("center_y") < float("inf")), F.lit(False))
    before = lambda c: F.lag(c).over(track())
    steps = rows.select(*TRACK, "time_index", "center_x", "center_y", finite.alias("finite"), (F.col("time_index") - before("time_index")).alias("dt"),
                        F.hypot(F.col("center_x") - before("center_x"), F.col("center_y") - before("center_y")).alias("hop"))
    per = steps.groupBy(*TRACK).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("dt") != 1, F.lit(False))).alias("gaps"), F.min("finite").alias("finite"),
                                    F.coalesce(F.sum("hop"), F.lit(0.0)).alias("length"), F.collect_list(F.struct("center_x", "center_y")).alias("points"))
    refused = (F.when(F.col("n") < 10, "TRACK_TOO_SHORT").when(F.col("gaps"), "NON_CONTIGUOUS_TIMESTEPS")
               .when(~F.col("finite") | (F.col("length") < 2.0), "STATIONARY_OR_TOO_SHORT"))
    return per.select(*TRACK, "n", "points", refused.alias("refused"))


def retimed(rows: DataFrame, tracks: DataFrame, alpha: float) -> DataFrame:
    """Rows of the accepted tracks on the moved clock: mx, my, vx, vy, turned (heading).

    Row i of n shows the place of i + alpha / 2 * sin^2(pi * i / (n - 1)) seconds, clipped to the track, on the line between the two
    rows around it.
    """
    index = (F.row_number().over(track()) - 1).alias("i")
    ahead = lambda c: F.coalesce(F.lead(c).over(track()), F.col(c))
    points = rows.select(*TRACK, index, "center_x", "center_y", (ahead("center_x") - F.col("center_x")).alias("to_x"), (ahead("center_y") - F.col("center_y")).alias("to_y"))
    last = F.col("n") - 1
    bump = F.sin(F.lit(math.pi) * F.col("i") / last)
    clock = rows.select(*TRACK, "time_index", "length", "width", index).join(tracks.filter("refused IS NULL").select(*TRACK, "n"), TRACK)
    clock = clock.withColumn("at", F.least(F.greatest(F.col("i") + bump * bump * (alpha / 2 / FRAME_S), F.lit(0.0)), last.cast("double"))).drop("i").withColumn("i", F.floor("at").cast("int"))
    part = F.col("at") - F.col("i")
    moved = clock.join(points, [*TRACK, "i"]).select(*TRACK, "time_index", "length", "width", (F.col("center_x") + part * F.col("to_x")).alias("mx"),
                                                     (F.col("center_y") + part * F.col("to_y")).alias("my"))
    ahead = F.atan2(F.lead("my").over(track()) - F.col("my"), F.lead("mx").over(track()) - F.col("mx"))
    moved = moved.withColumns({"vx": _slope("mx"), "vy": _slope("my"), "ahead": ahead})
    return moved.withColumn("turned", F.coalesce("ahead", F.lag("ahead").over(track()))).drop("ahead")


def broken_limits(moved: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per track: names of the limits that it exceeds once re-timed, in a fixed order; empty if none.

    The points of a track meet its moved places in one row per track, not in each of its rows.
    """
    before = lambda c: F.lag(c).over(track())
    df = moved.withColumns({"step": F.hypot(F.col("mx") - before("mx"), F.col("my") - before("my")), "speed": F.hypot("vx", "vy"),
                            "turn": F.abs(F.pmod(F.col("turned") - before("turned") + math.pi, F.lit(2 * math.pi)) - math.pi)})
    next_step = F.lead("step").over(track())
    df = df.withColumns({"path_speed": F.coalesce((F.col("step") + next_step) / 2, "step", next_step) / FRAME_S, "accel": _slope("speed")})
    df = df.withColumn("jerk", _slope("accel"))
    nearest = lambda m: F.array_min(F.transform("points", lambda p: F.hypot(m["mx"] - p["center_x"], m["my"] - p["center_y"])))
    finite = F.min(F.abs(F.col("mx") + F.col("my") + F.col("vx") + F.col("vy") + F.col("turned")) < float("inf"))
    limits = [("POSITION", F.max("step") >= MAX_POS_JUMP_M), ("VELOCITY", F.max(F.abs(F.col("path_speed") - F.col("speed")) / F.greatest("speed", F.lit(1.0))) > 0.10),
              ("ACCELERATION", F.max(F.abs("accel")) > MAX_ACCEL_MPS2), ("JERK", F.max(F.abs("jerk")) > MAX_JERK_MPS3),
              ("HEADING", F.max("turn") >= MAX_HEADING_JUMP_RAD), ("CROSS_TRACK", F.col("off") >= MAX_CROSS_TRACK_M)]
    per = df.groupBy(*TRACK).agg(finite.alias("finite"), *[hit.alias(name) for name, hit in limits[:-1]], F.collect_list(F.struct("mx", "my")).alias("places"))
    per = per.join(tracks.select(*TRACK, "points"), TRACK).withColumn("off", F.array_max(F.transform("places", nearest))).withColumn(*limits[-1])
    hits = [F.when(F.col(name), F.lit(name)) for name, _ in limits]
    return per.select(*TRACK, F.when(F.col("finite"), F.concat_ws(",", *hits)).otherwise(F.lit("NAN")).alias("broken"))


def warp_tracks(states: DataFrame, *, alpha: float = 0.15) -> DataFrame:
    """Re-timed rows of the given tracks with the verdict of each: passed, reason. Refused tracks keep their rows."""
    rows = states.select("scenario_id", F.col("track_id").cast("long").alias("track_id"), F.col("time_index").cast("int").alias("time_index"), *[F.col(c).cast("double").alias(c) for c in KINEMATIC])
    tracks = _track_verdicts(rows)
    moved = durable(retimed(rows, tracks, alpha))
    verdict = durable(tracks.select(*TRACK, "refused").join(broken_limits(moved, tracks), TRACK, "left").select(*TRACK, F.coalesce(
        "refused", F.when(F.col("broken") == "", F.lit("OK")).otherwise(F.concat(F.lit("PHYSICAL_GATES_FAILED:"), "broken"))).alias("reason")))
    new = moved.select(*TRACK, "time_index", F.struct(F.col("mx").alias("center_x"), F.col("my").alias("center_y"), F.col("vx").alias("velocity_x"),
                                                      F.col("vy").alias("velocity_y"), F.col("turned").alias("heading")).alias("w"))
    passed = F.col("reason") == "OK"
    out = rows.join(verdict, TRACK).join(new, [*TRACK, "time_index"], "left")
    return out.select(*TRACK, "time_index", passed.alias("passed"), "reason",
                      *[F.when(passed, F.col(f"w.{c}")).otherwise(F.col(c)).alias(c) for c in KINEMATIC[:5]], "length", "width")


def apply_warp(states: DataFrame, warped: DataFrame) -> DataFrame:
    """The actor table with accepted tracks replaced by their re-timed rows."""
    moved = ["center_x", "center_y", "velocity_x", "velocity_y", "heading"]
    new = warped.filter("passed").select("scenario_id", "track_id", "time_index", F.struct(*moved).alias("w"))
    out = states.join(new, ["scenario_id", "track_id", "time_index"], "left")
    return out.withColumns({c: F.when(F.col("w").isNotNull(), F.col(f"w.{c}")).otherwise(F.col(c)) for c in moved}).drop("w")


def warp_response_accounting(before: DataFrame, after: DataFrame, score: str = "criticality_peak") -> DataFrame:
    """Counts and rates of increased, unchanged and decreased peaks; no change is not an increase."""
    d = F.col("b") - F.col("a")
    both = before.select("scenario_id", F.col(score).alias("a")).join(after.select("scenario_id", F.col(score).alias("b")), "scenario_id")
    up, same, down = F.count_if(d > 1e-12), F.count_if(F.abs(d) <= 1e-12), F.count_if(d < -1e-12)
    n = F.greatest(F.count("*"), F.lit(1))
    return both.agg(up.alias("delta_peak_c_positive_count"), same.alias("delta_peak_c_zero_count"), down.alias("delta_peak_c_negative_count"),
                    (up / n).alias("true_increase_rate"), (same / n).alias("unchanged_rate"))
