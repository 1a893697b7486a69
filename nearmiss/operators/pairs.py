"""Ego-to-actor pairs: the join that everything else is reduced from."""
from pyspark.sql import Column, DataFrame, functions as F

from nearmiss.constants import (CENSORED, ELIGIBLE_TYPES, FUTURE_CONTACT, INVALID_TARGET,
                                METHOD_BOX, OVERLAP, RADIUS_M, T_MAX_S)
from nearmiss.functions import geometry as G
from nearmiss.functions.columns import all_salts, flag, salt_of
from nearmiss.session import durable_rows

FRAME = ["scenario_id", "time_index"]
# Copies of the small side in joins whose hot keys are not known beforehand.
SALT = 8

IS_EGO = "coalesce(is_sdc, false)"
FULL_STATE = " AND ".join(["coalesce(valid, false)", *[f"coalesce(abs({c}) < double('Infinity'), false)" for c in G.STATE],
                           "length > 0", "width > 0"])


def not_null(prefix: str = "") -> str:
    """Spelled out after a filter on usable states: Spark then generates code without null branches,
    small enough for the JVM to compile."""
    return " AND ".join(f"{prefix}{c} IS NOT NULL" for c in G.STATE)


def full_state() -> Column:
    """Valid flag set, every kinematic value finite, box of positive size."""
    return F.expr(FULL_STATE)


def eligible_type() -> Column:
    return F.col("object_type").isin(*ELIGIBLE_TYPES)


def salted_join(small: DataFrame, rows: DataFrame, keys: list, salt_on: list, how="inner", buckets=SALT) -> DataFrame:
    """Equi join of a one-row-per-key side with a many-row side whose keys may be hot.

    The many side is cut by a hash of `salt_on`; the small side is repeated once
    per cut, so no key is handled by a single task.
    """
    left = small.withColumn("salt", all_salts(buckets))
    right = rows.withColumn("salt", salt_of(*[F.col(c) for c in salt_on], buckets=buckets))
    return left.join(right.hint("merge"), [*keys, "salt"], how).drop("salt")


def frame_join(ego: DataFrame, actors: DataFrame, frame: str = "time_index") -> DataFrame:
    """Ego rows with the actor rows of the same scenario and frame.

    A plain join whose partitioning later per-frame aggregates reuse; frames that are much larger than others are left to
    Spark's skew join.
    """
    return ego.join(actors, ["scenario_id", frame])


def frame_presence(states: DataFrame) -> DataFrame:
    """One row per frame that has any row: presence flags, valid actors by class and the ego's own state.

    The only full pass over the actor table besides the pair join; reduced
    before the shuffle. Ego values (e_*) are those of a flagged-valid ego row.
    """
    ego = lambda c: f"max(CASE WHEN {IS_EGO} AND coalesce(valid, false) THEN {c} END) AS e_{c}"
    of = lambda kind, name: f"count_if(coalesce(valid, false) AND object_type = 'TYPE_{kind}') AS {name}"
    return states.groupBy(*FRAME).agg(*[F.expr(x) for x in (
        "count(*) > 0 AS any_row", "count(*) AS n_rows", "max(coalesce(valid, false)) AS any_valid",
        f"max({IS_EGO}) AS ego_row", f"max({IS_EGO} AND coalesce(valid, false)) AS ego_flagged", f"max({IS_EGO} AND {FULL_STATE}) AS ego_ok",
        f"max(CASE WHEN {IS_EGO} THEN track_id END) AS ego_track_id", "min(timestamp_seconds) AS clock_s",
        "count_if(coalesce(valid, false)) AS n_valid_agents", of("VEHICLE", "n_vehicles"), of("PEDESTRIAN", "n_pedestrians"), of("CYCLIST", "n_cyclists"), *[ego(c) for c in G.STATE])])


def ego_states(presence: DataFrame) -> DataFrame:
    """Usable ego states, one per frame."""
    return presence.filter(f"ego_ok AND {not_null('e_')}").select(*FRAME, "ego_track_id", *[f"e_{c}" for c in G.STATE])


def ego_track(presence: DataFrame) -> DataFrame:
    """The ego's rows in the layout of the actor table."""
    return presence.filter("ego_row").select(
        *FRAME, F.col("ego_track_id").alias("track_id"), F.col("clock_s").alias("timestamp_seconds"),
        F.lit(True).alias("is_sdc"), F.col("ego_flagged").alias("valid"), *[F.col(f"e_{c}").alias(c) for c in G.STATE])


def ego_target_pairs(states: DataFrame, presence: DataFrame | None = None, *, radius_m: float = RADIUS_M,
                     valid_targets_only: bool = True) -> DataFrame:
    """Every other vehicle, pedestrian or cyclist within `radius_m` of a usable ego state of its frame.

    With valid_targets_only=False, actors flagged valid but with unusable
    numerics stay as rows with pair_valid = false.
    """
    presence = durable_rows(frame_presence(states)) if presence is None else presence
    placed = "coalesce(valid, false) AND abs(center_x) < double('Infinity') AND abs(center_y) < double('Infinity')"
    keep = f"{FULL_STATE} AND {not_null()}" if valid_targets_only else placed
    targets = states.filter(F.expr(f"NOT {IS_EGO} AND {keep}") & eligible_type())
    # Values of rows that are not usable are never read: pair_valid guards every result.
    value = (lambda c: F.col(c)) if valid_targets_only else (lambda c: F.coalesce(F.col(c), F.lit(0.0)))
    targets = targets.select(*FRAME, F.col("track_id").alias("target_track_id"), F.col("object_type").alias("target_object_type"),
                             (F.lit(True) if valid_targets_only else full_state()).alias("pair_valid"), *[value(c).alias(f"t_{c}") for c in G.STATE])
    pairs = G.with_relative_state(frame_join(ego_states(presence), targets))
    return pairs.filter(F.col("pair_distance_m") <= radius_m)


def pair_metrics(states: DataFrame, presence: DataFrame | None = None, *, clearance: bool = True, t_max: float = T_MAX_S, **join) -> DataFrame:
    """Box time-to-contact, closing speed and (optionally) boundary clearance for every pair."""
    pairs = G.with_swept_contact(G.with_box_axes(ego_target_pairs(states, presence, **join)), t_max, clearance=clearance)
    ok = F.col("pair_valid")
    cols = {
        "closing_speed_mps": F.when(ok, G.closing_speed()),
        "obb_ttc_s": F.expr(f"CASE WHEN pair_valid THEN ttc_s ELSE {float(t_max)!r}D END"),
        "obb_hit_future": F.expr("pair_valid AND hit_future"),
        "obb_overlap_now": F.expr("pair_valid AND overlap_now"),
        "obb_status": F.expr(f"CASE WHEN NOT pair_valid THEN '{INVALID_TARGET}' WHEN overlap_now THEN '{OVERLAP}' "
                             f"WHEN hit_future THEN '{FUTURE_CONTACT}' ELSE '{CENSORED}' END"),
        "ttc_method": F.lit(METHOD_BOX),
        "ttc_horizon_s": F.lit(float(t_max)),
    }
    if clearance:
        cols["clearance_m"] = F.when(ok, F.col("box_gap_m"))
    return pairs.withColumns(cols).drop(*G.BOX_TEMP, "ttc_s", "contact_exit_s", "overlap_now", "hit_future", "box_gap_m")


def circle_pair_metrics(states: DataFrame, presence: DataFrame | None = None, *, radius_m: float = RADIUS_M, t_max: float = T_MAX_S) -> DataFrame:
    """Circle time-to-contact per pair. Missing velocities count as standing still here."""
    still = {v: F.expr(f"CASE WHEN abs({v}) < double('Infinity') THEN {v} ELSE 0D END") for v in ("velocity_x", "velocity_y")}
    presence = durable_rows(frame_presence(states)) if presence is None else presence
    base = states.filter("coalesce(valid, false) AND center_x IS NOT NULL AND center_y IS NOT NULL AND abs(center_x) < double('Infinity') "
                         "AND abs(center_y) < double('Infinity') AND length > 0 AND width > 0").withColumns(still)
    ego = base.filter(IS_EGO).select(*FRAME, F.col("track_id").alias("ego_track_id"), *G.prefixed("e_"))
    targets = (base.filter(F.expr(f"NOT {IS_EGO}") & eligible_type())
               .select(*FRAME, F.col("track_id").alias("target_track_id"),
                       F.col("object_type").alias("target_object_type"), *G.prefixed("t_")))
    pairs = G.with_relative_state(frame_join(ego, targets))
    pairs = G.with_circle_contact(pairs.filter(F.col("pair_distance_m") <= radius_m), t_max)
    return pairs.select(
        *FRAME, "ego_track_id", "target_track_id", "target_object_type", "pair_distance_m",
        F.col("circle_ttc_s").alias("derived_ttc_2d_s"), F.col("circle_dtc_m").alias("derived_dtc_m"),
        G.closing_speed().alias("derived_closing_speed_mps"),
        F.col("circle_overlap_now").alias("derived_overlap_now"),
        F.col("circle_hit_future").alias("derived_hit_future"),
        F.lit(True).alias("derived_pair_valid"),
        F.when(F.col("circle_hit_future"), "event").otherwise(CENSORED).alias("derived_ttc_status"))


def circle_vs_box(states: DataFrame, **join) -> DataFrame:
    """Both methods on one pair row, for the containment audit."""
    pairs = G.with_circle_contact(G.with_swept_contact(G.with_box_axes(ego_target_pairs(states, **join))))
    return pairs.select(*FRAME, "ego_track_id", "target_track_id", "target_object_type",
                        "circle_ttc_s", F.col("ttc_s").alias("obb_ttc_s"),
                        "circle_overlap_now", F.col("overlap_now").alias("obb_overlap_now"),
                        "circle_hit_future", F.col("hit_future").alias("obb_hit_future"))


def containment_audit(both: DataFrame) -> DataFrame:
    """A box contact needs a circle contact, no later than the box contact."""
    c = F.col
    return both.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(c("obb_overlap_now") & ~c("circle_overlap_now")).alias("overlap_violations"),
        F.count_if(c("obb_hit_future") & ~c("circle_hit_future")).alias("hit_violations"),
        F.count_if(c("obb_hit_future") & (c("circle_ttc_s") > c("obb_ttc_s") + 1e-6)).alias("order_violations"))


def pair_key(pairs: DataFrame) -> DataFrame:
    """String key of a pair row plus digests of the ego and target state it was computed from."""
    text = lambda c: F.coalesce(F.bround(F.col(c), 3).cast("decimal(20,3)").cast("string"), F.lit(""))
    digest = lambda cols: F.sha2(F.concat_ws("|", *[text(c) for c in cols]), 256)
    return pairs.withColumns({
        "target_pair_key": F.concat_ws("_", "scenario_id", "time_index", "ego_track_id", "target_track_id"),
        "state_hash": digest([p + c for p in ("e_", "t_") for c in G.STATE[:5]]),
        "dimension_hash": digest([p + c for p in ("e_", "t_") for c in G.STATE[5:]])})


def pair_key_audit(pairs: DataFrame) -> DataFrame:
    """Row, distinct-key and distinct-state counts; keys must be unique."""
    per_key = pair_key(pairs).groupBy("target_pair_key").agg(F.count("*").alias("n"), F.count_if(F.length("state_hash") == 64).alias("h"))
    return per_key.agg(F.sum("n").alias("n_pairs"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"),
                       F.sum("h").alias("hashed_rows"))
