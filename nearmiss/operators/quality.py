"""Data-quality counts and contract audits. Each audit is one pass of conditional counts."""
import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.constants import FRAME_STATES, FUTURE_CONTACT, CENSORED, METHOD_BOX, UNSUPPORTED_FIELDS
from nearmiss.functions.columns import finite, flag
from nearmiss.operators.ranking import exact_quantiles
from nearmiss.session import durable

# Column names that must not be model inputs.
BANNED_COLUMNS = (
    "derived_ttc_2d_s", "ttc_min_s", "y_log_ttc", "ttc_censored", "derived_dtc_m", "derived_closing_speed_mps",
    "derived_overlap_now", "derived_hit_future", "derived_pair_valid", "derived_ttc_status", "n_eligible_pairs",
    "target_object_id", "target_object_type", "target_status", "exposure_flag", "derived_accel_mps2",
    "derived_jerk_mps3", "closing_speed", "relative_speed", "collision_flag", "overlap_flag", "hit_future",
    "drac", "rss", "jerk", "acceleration", "cross_track_error", "best_ttci",
)
LEGACY_TARGET_COLUMNS = (
    "derived_ttc_2d_s", "ttc_min_s", "circle_ttc_s", "ttc_circle_s", "circle_frame_status", "circle_overlap_now",
    "circle_hit_future", "ttc_method_circle",
)
BANNED_PATTERNS = ("ttc", "ttci", "collision", "drac", "rss", "closing", "overlap")


def ratio(n: Column, d: Column, scale=1.0, digits=4) -> Column:
    return F.when(d > 0, F.round(F.lit(scale) * n / F.greatest(d, F.lit(1)), digits))


def duplicate_keys(df: DataFrame, keys: list) -> DataFrame:
    """Rows that share their key with another row, all members counted."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
                 F.count("*").alias("distinct_keys")))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child keys without a parent row."""
    missing = child.select(key).distinct().join(parent.select(key).distinct(), key, "left_anti")
    return missing.agg(F.count("*").alias("orphan_keys"))


def validity_ratios(states: DataFrame) -> DataFrame:
    """Share of invalid states, whether these are all NULL, and missing percentages of valid ones."""
    cols = ["center_x", "center_y", "center_z", "velocity_x", "velocity_y", "heading", "length", "width", "height"]
    ok = flag(F.col("valid"))
    n_ok = F.count_if(ok)
    return states.agg(
        F.count("*").alias("n_states"), ratio(F.count_if(~ok), F.count("*")).alias("invalid_state_ratio"),
        (F.count_if(~ok & F.col("center_x").isNotNull()) == 0).alias("invalid_states_are_null"),
        *[ratio(F.count_if(ok & F.col(c).isNull()), n_ok, 100.0).alias(f"missing_pct_{c}") for c in cols])


def map_coverage(points: DataFrame) -> DataFrame:
    """Points per feature type plus totals, as (measure, value) rows."""
    per_feature = points.groupBy("feature_type", "scenario_id", "feature_id").agg(F.count("*").alias("n"))
    return (per_feature.rollup("feature_type").agg(F.sum("n").alias("points"), F.count("*").alias("n_features"))
            .withColumn("feature_type", F.coalesce("feature_type", F.lit("ALL"))))


def signal_coverage(signals: DataFrame, frames: DataFrame) -> DataFrame:
    """Entries, frames with signals, distinct lanes and the covered share of frames."""
    per_frame = signals.groupBy("scenario_id", "time_index").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("total_entries"), F.count("*").alias("timesteps_with_signals"))
    lanes = signals.select("scenario_id", "lane_id").distinct().agg(F.count("*").alias("unique_lanes"))
    total = frames.select("scenario_id", "time_index").distinct().agg(F.count("*").alias("n_frames"))
    return (per_frame.withColumns({"unique_lanes": lanes.scalar(), "n_frames": total.scalar()})
            .withColumn("signal_coverage_pct", ratio(F.col("timesteps_with_signals"), F.col("n_frames"), 100.0, 2)))


def field_coverage(records: DataFrame) -> DataFrame:
    """Present / absent counts per field of the nested records; optional fields that no record carries are unsupported."""
    has = lambda c: F.count_if(F.size(c) > 0)
    arrays = ["timestamps_seconds", "tracks", "dynamic_map_states", "map_features", "objects_of_interest"]
    extra = [f for f in UNSUPPORTED_FIELDS if f in records.columns]
    wide = records.agg(
        F.count("*").alias("n"), F.count_if(flag(F.length("scenario_id") > 0)).alias("scenario_id"),
        F.count("*").alias("sdc_track_index"), *[has(a).alias(a) for a in arrays],
        *[(has(f) if f in extra else F.lit(0).cast("long")).alias(f) for f in UNSUPPORTED_FIELDS])
    names = [c for c in wide.columns if c != "n"]
    long = wide.unpivot(["n"], names, "field", "present")
    return long.select("field", "present", (F.col("n") - F.col("present")).alias("absent"),
                       ratio(F.col("present"), F.col("n"), 100.0, 2).alias("coverage_pct"),
                       (F.col("field").isin(*UNSUPPORTED_FIELDS) & (F.col("present") == 0)).alias("unsupported"))


def timestamp_stats(frames: DataFrame) -> DataFrame:
    """Lengths per scenario and steps between consecutive frames.

    Exact medians come from value counts, so no group of raw values is gathered.
    """
    by_time = W.partitionBy("scenario_id").orderBy("time_index")
    steps = frames.select("scenario_id", F.bround(F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(by_time), 6).alias("v")).filter("v is not null")
    lengths = frames.groupBy("scenario_id").agg(F.count("*").cast("double").alias("v"))
    both = (lengths.select(F.lit("length").alias("measure"), "v")
            .unionByName(steps.select(F.lit("step").alias("measure"), "v")))
    counts = durable(both.groupBy("measure", "v").agg(F.count("*").alias("n")))
    n, v = F.col("n"), F.col("v")
    means = counts.groupBy("measure").agg((F.sum(v * n) / F.sum(n)).alias("mean"))
    off = v - F.col("mean")
    stats = counts.join(means, "measure").groupBy("measure").agg(
        F.sum(n).alias("count"), F.count("*").alias("unique_values"), F.min(v).alias("min"), F.max(v).alias("max"), F.first("mean").alias("mean"),
        F.sqrt(F.sum(off * off * n) / F.greatest(F.sum(n) - 1, F.lit(1))).alias("stdev"))
    median = exact_quantiles(counts, ["measure"], "v", [0.5], count=n).select("measure", F.col("quantile").alias("median"))
    return stats.join(median, "measure")


def status_distribution(targets: DataFrame, status: str = "target_status") -> DataFrame:
    return targets.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n_frames"))


def split_counts(df: DataFrame) -> DataFrame:
    """Rows and distinct scenarios per split (counted per scenario first)."""
    return (df.groupBy("split", "scenario_id").agg(F.count("*").alias("n"))
            .groupBy("split").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_scenarios")))


def feature_coverage(df: DataFrame, features: list) -> DataFrame:
    wide = df.agg(F.count("*").alias("n"), *[F.count(f).alias(f) for f in features])
    return wide.unpivot(["n"], features, "feature_name", "valid_count").select(
        "feature_name", "valid_count",
        F.when(F.col("n") > 0, F.col("valid_count") / F.greatest(F.col("n"), F.lit(1))).otherwise(F.lit(0.0)).alias("coverage_ratio"))


def holdout_qc(frames: DataFrame, features: list) -> DataFrame:
    """Size, null and prevalence summary of a labelled frame table."""
    per = frames.groupBy("scenario_id").agg(
        F.count("*").alias("n"), *[F.sum(f"target_y_tau_{t}s").alias(f"y{t}") for t in (2, 3, 5)],
        sum((F.count_if(F.col(f).isNull()) for f in features), F.lit(0)).alias("nulls"))
    return per.agg(F.sum("n").alias("total_frames"), F.count("*").alias("total_scenarios"),
                   (F.sum("n") / F.count("*")).alias("mean_frames_per_scenario"), F.sum("nulls").alias("null_values"),
                   *[(F.sum(f"y{t}") / F.sum("n")).alias(f"prevalence_tau_{t}s") for t in (2, 3, 5)])


def profile_summary(profile: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    with_episode = F.count_if(F.col("episode_count_3s") > 0)
    return profile.agg(F.count("*").alias("n_scenarios"), mean("criticality_peak"), mean("criticality_auc_s"), mean("tet_3s_s"),
                       with_episode.alias("scenarios_with_critical_episode_3s"),
                       (with_episode / F.count("*")).alias("critical_episode_scenario_rate"),
                       mean("dominant_actor_turnover_rate"))


def risk_set_audit(targets: DataFrame) -> DataFrame:
    """Counts that must be 0 in a usable label table, plus its size."""
    c = F.col
    primary = c("target_status").isin(FUTURE_CONTACT, CENSORED)
    event = c("target_status") == FUTURE_CONTACT
    per_key = targets.groupBy("scenario_id", "time_index").agg(
        F.count("*").alias("n"), F.count_if(primary).alias("primary"), F.count_if(event).alias("event"),
        F.count_if(primary & flag(c("overlap_now_flag"))).alias("overlap"),
        F.count_if(event & flag(c("right_censored"))).alias("cens"),
        F.count_if(event & ~flag(finite(c("ttc_obb_swept_s")) & (c("ttc_obb_swept_s") > 0))).alias("bad"),
        F.count_if(~c("target_status").isin(*FRAME_STATES)).alias("unknown"))
    total = lambda n, name: F.coalesce(F.sum(n), F.lit(0)).alias(name)
    return per_key.agg(
        total("n", "n_frames"), total("primary", "n_primary"), total("event", "n_events"),
        total("overlap", "overlap_in_primary"), total("cens", "censored_events"), total("bad", "bad_event_ttc"),
        total("unknown", "unknown_status"), total(F.col("n") - 1, "duplicate_frame_keys"))


def method_audit(targets: DataFrame, method: str = METHOD_BOX, banned=LEGACY_TARGET_COLUMNS) -> DataFrame:
    """The method column is present with one value, and no legacy column is there."""
    legacy = sorted(set(x.lower() for x in targets.columns) & set(banned))
    if "ttc_method" not in targets.columns:
        targets = targets.withColumn("ttc_method", F.lit(None).cast("string"))
    out = targets.agg(F.count("*").alias("n_rows"), F.count_if(flag(F.col("ttc_method") == method)).alias("n_method"),
                      F.count_if(flag(F.col("ttc_method") != method)).alias("n_other_method"))
    return out.withColumns({"legacy_columns": F.lit(len(legacy)).cast("long"),
                            "passed": (F.col("n_method") > 0) & (F.col("n_other_method") == 0) & F.lit(not legacy)})


def leakage_audit(features: list) -> dict:
    """Feature names against the banned list and patterns. Metadata only, no data is read."""
    found = [f for f in features if f.lower().strip() in BANNED_COLUMNS]
    hits = [(f, p) for f in features for p in BANNED_PATTERNS if re.search(re.escape(p), f.lower())]
    return {"status": "FAIL" if found or hits else "PASS", "banned_columns_found": found, "banned_pattern_matches": hits}


def feature_contract(df: DataFrame, features: list) -> DataFrame:
    """Per feature: present, all-null and constant flags (min = max, so no distinct set is built)."""
    present = [f for f in features if f in df.columns]
    aggs = [x for f in present for x in (F.count(f).alias(f"{f}|n"), F.min(f).cast("double").alias(f"{f}|lo"), F.max(f).cast("double").alias(f"{f}|hi"))]
    wide = df.agg(*(aggs or [F.count("*").alias("n")]))
    rows = [F.struct(F.lit(f).alias("feature_name"), F.lit(f in present).alias("present"),
                     (F.col(f"`{f}|n`") == 0 if f in present else F.lit(True)).alias("all_null"),
                     (flag(F.col(f"`{f}|lo`") == F.col(f"`{f}|hi`")) if f in present else F.lit(False)).alias("constant"))
            for f in features]
    out = wide.select(F.inline(F.array(*rows)))
    return out.withColumn("passed", F.col("present") & ~F.col("all_null") & ~F.col("constant"))


def finite_features(df: DataFrame, features: list) -> tuple[DataFrame, DataFrame]:
    """(rows with every feature finite, dropped-row counts per feature). Nothing is zero-filled."""
    keep = F.lit(True)
    for f in features:
        keep = keep & finite(F.col(f))
    counts = df.agg(F.count("*").alias("n_rows"), F.count_if(keep).alias("n_kept"),
                    *[F.count_if(~finite(F.col(f))).alias(f"nonfinite_{f}") for f in features])
    return df.filter(keep), counts


def primary_risk_set(targets: DataFrame) -> DataFrame:
    """Future contact and censored frames; overlap is kept for sensitivity runs only."""
    return targets.filter(F.col("target_status").isin(FUTURE_CONTACT, CENSORED))


def split_guard(df: DataFrame, wanted: str, allowed=("train", "internal_val")) -> DataFrame:
    """Rows of one split; a split outside the allowed ones is refused before anything is read."""
    if wanted not in allowed:
        raise PermissionError(f"split {wanted!r} may not be read here; allowed: {', '.join(allowed)}")
    return df.filter(F.col("split") == wanted)


def first_n_scenarios(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n scenario ids (the cap is the feature)."""
    ids = df.select("scenario_id").distinct().orderBy("scenario_id").limit(n)
    return df.join(ids, "scenario_id", "left_semi")


def dev_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split").isin("train", "internal_val"))
