"""Frames to scenario profiles.

Input is one row per frame of the fixed grid, so a scenario has at most
N_FRAMES rows and per-scenario windows are bounded whatever the size of the
underlying actor table. All windows share one partitioning and one order.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.constants import DT_S, INVALID_EGO, INVALID_FRAME
from nearmiss.functions.columns import clip, flag

def scenario():
    return W.partitionBy("scenario_id")


def ordered():
    return scenario().orderBy("time_index")


def so_far():
    return ordered().rowsBetween(W.unboundedPreceding, 0)


def frame_duration() -> Column:
    """Time to the next frame, clipped to [0.01, 0.5]; the last frame counts 0.1 s."""
    return F.coalesce(clip(F.lead("timestamp_s").over(ordered()) - F.col("timestamp_s"), 0.01, 0.5), F.lit(DT_S))


def with_runs(df: DataFrame, member: Column, name: str = "run") -> DataFrame:
    """Number the maximal runs of consecutive member rows (non-members get the run before them)."""
    starts = member & ~F.coalesce(F.lag(member).over(ordered()), F.lit(False))
    return df.withColumn(name, F.sum(starts.cast("int")).over(so_far()))


def merge_intervals(intervals: DataFrame, *, merge_gap_s: float, min_duration_s: float) -> DataFrame:
    """Join intervals of a scenario that are at most `merge_gap_s` apart; keep long ones."""
    by_start = scenario().orderBy("start_s")
    previous = F.max("end_s").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start_s") - previous > merge_gap_s).cast("int"), F.lit(1))
    return (intervals.withColumn("fresh", fresh)
            .withColumn("episode", F.sum("fresh").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy("scenario_id", "episode").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
            .withColumn("duration_s", F.col("end_s") - F.col("start_s"))
            .filter(F.col("duration_s") >= min_duration_s))


def critical_episodes(frames: DataFrame, *, tau: float = 3.0, merge_gap_s: float = 0.5,
                      min_duration_s: float = 0.5) -> DataFrame:
    """Episodes of TTC <= tau. An interval ends one frame after its last critical frame."""
    critical = flag(F.col("scene_ttc_min_s") <= tau)
    runs = (with_runs(frames.withColumn("critical", critical), F.col("critical")).filter("critical")
            .groupBy("scenario_id", "run")
            .agg(F.min("timestamp_s").alias("start_s"), (F.max("timestamp_s") + F.lit(DT_S)).alias("end_s")))
    return merge_intervals(runs, merge_gap_s=merge_gap_s, min_duration_s=min_duration_s)


def hold_frames(hold_s: float) -> int:
    """Frames of 0.1 s whose running sum reaches the hold time."""
    total, n = 0.0, 0
    while total < hold_s:
        total, n = total + DT_S, n + 1
    return n


def recovery_time(frames: DataFrame, *, tau: float = 3.0, hold_s: float = 0.5) -> DataFrame:
    """From the first severity peak to the first safe streak of `hold_s`, else to the last frame."""
    c = F.col
    first_peak = F.min_by(F.when(c("is_exposed"), c("timestamp_s")),
                          F.when(c("is_exposed"), F.struct(-c("severity_c_t"), c("time_index")))).over(scenario())
    rows = frames.withColumns({
        "peak_s": first_peak, "last_s": F.max("timestamp_s").over(scenario()),
        "safe": ~flag(c("scene_ttc_min_s") <= tau)})
    rows = rows.filter(c("timestamp_s") >= c("peak_s"))
    rows = rows.withColumn("rank", F.row_number().over(ordered()))
    bad_rank = F.max(F.when(~c("safe"), c("rank"))).over(so_far())
    rows = rows.withColumn("streak", c("rank") - F.coalesce(bad_rank, F.lit(0)))
    held = c("safe") & (c("streak") >= hold_frames(hold_s))
    return (rows.groupBy("scenario_id")
            .agg(F.min(F.when(held, c("timestamp_s"))).alias("held_s"), F.max("peak_s").alias("peak_s"),
                 F.max("last_s").alias("last_s"))
            .select("scenario_id",
                    F.greatest(F.coalesce(c("held_s") - F.lit(hold_s), c("last_s")) - c("peak_s"), F.lit(0.0))
                     .alias("recovery_time_3s_s"),
                    c("held_s").isNull().alias("recovery_censored_3s")))


def dominant_turnover(frames: DataFrame) -> DataFrame:
    """Changes of the dominant actor over consecutive exposed frames."""
    before = F.lag("dominant_actor_id").over(ordered())
    return (frames.filter("is_exposed").withColumn("changed", flag(F.col("dominant_actor_id") != before))
            .groupBy("scenario_id").agg(F.count_if("changed").alias("dominant_actor_turnover_count"),
                                        (F.count_if("changed") / F.count("*")).alias("dominant_actor_turnover_rate")))


def with_timeline(frames: DataFrame, *, tau: float, merge_gap_s: float, hold_s: float) -> DataFrame:
    """Per-frame marks of the whole profile: duration, episode number, safe hold, change of dominant actor."""
    c = F.col
    earlier = ordered().rowsBetween(W.unboundedPreceding, -1)
    critical = flag(c("scene_ttc_min_s") <= tau)
    rows = frames.withColumns({
        "dt": frame_duration(), "critical": critical, "rank": F.row_number().over(ordered()),
        "last_s": F.max("timestamp_s").over(scenario()),
        "peak": F.min_by(F.when(c("is_exposed"), F.struct("timestamp_s", "time_index")),
                         F.when(c("is_exposed"), F.struct(-c("severity_c_t"), c("time_index")))).over(scenario()),
        "changed": flag(c("is_exposed") & (c("dominant_actor_id") != F.last("dominant_actor_id", True).over(earlier)))})
    rows = rows.withColumns({
        "last_critical_s": F.last(F.when(c("critical"), c("timestamp_s")), True).over(earlier),
        "last_bad": F.max(F.when(c("critical"), c("rank"))).over(so_far()),
        "peak_rank": F.min(F.when(c("time_index") == c("peak.time_index"), c("rank"))).over(scenario())})
    # A critical frame opens an episode if the one before ended more than the merge gap ago.
    fresh = c("critical") & F.coalesce(c("timestamp_s") - (c("last_critical_s") + F.lit(DT_S)) > merge_gap_s, F.lit(True))
    streak = c("rank") - F.greatest("last_bad", c("peak_rank") - 1)
    return rows.withColumns({
        "episode": F.when(c("critical"), F.sum(fresh.cast("int")).over(so_far())),
        "held_s": F.when(~c("critical") & (c("rank") >= c("peak_rank")) & (streak >= hold_frames(hold_s)), c("timestamp_s"))})


def scenario_profile(frames: DataFrame, *, tau: float = 3.0, merge_gap_s: float = 0.5, min_duration_s: float = 0.5,
                     hold_s: float = 0.5, taus=(1, 2, 3, 5)) -> DataFrame:
    """Full profile in one exchange: frame marks, then episodes, then scenarios.

    A scenario without an exposed frame gets zeros and a censored recovery.
    """
    c = F.col
    rows = with_timeline(frames, tau=tau, merge_gap_s=merge_gap_s, hold_s=hold_s)
    is_type = lambda t: F.count_if(flag(c("dominant_actor_type") == t))
    per_episode = rows.groupBy("scenario_id", "episode").agg(
        F.count("*").alias("total_frames"), F.count_if(~c("status").isin(INVALID_EGO, INVALID_FRAME)).alias("valid_frames"),
        F.count_if("is_exposed").alias("exposed_frames"), F.max("severity_c_t").alias("peak_sev"), F.sum("severity_c_t").alias("sum_sev"),
        F.sum(c("severity_c_t") * c("dt")).alias("auc"),
        *[F.sum(F.when(c("scene_ttc_min_s") <= float(t), c("dt"))).alias(f"tet{t}") for t in taus],
        is_type("TYPE_VEHICLE").alias("veh"), is_type("TYPE_PEDESTRIAN").alias("ped"), is_type("TYPE_CYCLIST").alias("cyc"),
        F.count_if("changed").alias("turns"), F.min("held_s").alias("held_s"), F.max("peak.timestamp_s").alias("peak_s"), F.max("last_s").alias("last_s"),
        F.when(c("episode").isNotNull(), F.max("timestamp_s") + F.lit(DT_S) - F.min("timestamp_s")).alias("duration_s"))
    kept = F.when(c("duration_s") >= min_duration_s, c("duration_s"))
    total = lambda n: F.sum(n)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = per_episode.groupBy("scenario_id").agg(
        total("total_frames").alias("total_frames"), total("valid_frames").alias("valid_frames"), total("exposed_frames").alias("exposed_frames"),
        zero(F.max("peak_sev")).alias("criticality_peak"), zero(total("auc")).alias("criticality_auc_s"), total("sum_sev").alias("sum_sev"),
        *[zero(total(f"tet{t}")).alias(f"tet_{t}s_s") for t in taus],
        total("veh").alias("veh"), total("ped").alias("ped"), total("cyc").alias("cyc"), total("turns").alias("dominant_actor_turnover_count"),
        F.count(kept).alias("episode_count_3s"), zero(F.max(kept)).alias("max_episode_duration_3s_s"),
        F.min("held_s").alias("held_s"), F.max("peak_s").alias("peak_s"), F.max("last_s").alias("last_s"))
    share = lambda num, den: F.when(c(den) > 0, c(num) / F.greatest(c(den), F.lit(1))).otherwise(F.lit(0.0))
    out = out.withColumns({
        "valid_frame_fraction": share("valid_frames", "total_frames"), "exposure_frame_fraction": share("exposed_frames", "valid_frames"),
        "criticality_mean_exposed": zero(share("sum_sev", "exposed_frames")),
        "recovery_time_3s_s": F.when(c("peak_s").isNull(), F.lit(0.0)).otherwise(
            F.greatest(F.coalesce(c("held_s") - F.lit(hold_s), c("last_s")) - c("peak_s"), F.lit(0.0))),
        "recovery_censored_3s": c("held_s").isNull(),
        "dominant_actor_turnover_rate": share("dominant_actor_turnover_count", "exposed_frames"),
        **{f"fraction_dominant_{n}": share(s, "exposed_frames") for n, s in (("vehicle", "veh"), ("pedestrian", "ped"), ("cyclist", "cyc"))}})
    return out.drop("sum_sev", "veh", "ped", "cyc", "held_s", "peak_s", "last_s")
