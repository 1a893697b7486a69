"""Catalog: flattening, audits, splits and indicators."""
import uuid

from pyspark.sql import functions as F

from nearmiss.operators import frames as FR, kpi as KP, models as MD, quality as Q, splits as SP
from nearmiss.operators.kinematics import kinematics
from nearmiss.operators.pairs import frame_presence
from nearmiss.plans.catalog import query, rounded
from nearmiss.plans.core import frames_of, profile_of
from nearmiss.session import durable, shared_dir
from nearmiss.sources import records as R, tables as TB
from nearmiss.sources.fixture import map_points, mixed_map_points, mixed_states, records, scores, signals, states
from nearmiss.sources.tables import file_manifest as file_manifest_of


@query
def flatten_scenario(spark, sf_dir):
    return rounded(R.flatten_scenario(records(spark, sf_dir)))


@query
def flatten_agent_state(spark, sf_dir):
    return rounded(R.flatten_agent_state(records(spark, sf_dir)), 4)


@query
def flatten_frame_context(spark, sf_dir):
    return rounded(R.flatten_frame_context(records(spark, sf_dir)))


@query
def flatten_map_features(spark, sf_dir):
    return rounded(R.flatten_map_features(records(spark, sf_dir)))


@query
def flatten_dynamic_signals(spark, sf_dir):
    return rounded(R.flatten_dynamic_signals(records(spark, sf_dir)))


@query
def flatten_sdc_paths(spark, sf_dir):
    return rounded(R.flatten_sdc_paths(records(spark, sf_dir)))


@query
def with_aliases(spark, sf_dir):
    return rounded(R.with_aliases(states(spark, sf_dir)).select("scenario_id", "time_index", "track_id", "segment_id", "frame_label", "obj_id"))


@query
def field_coverage(spark, sf_dir):
    return rounded(Q.field_coverage(records(spark, sf_dir)))


@query
def timestamp_stats(spark, sf_dir):
    clock = states(spark, sf_dir).select("scenario_id", "time_index", "timestamp_seconds").distinct()
    return rounded(Q.timestamp_stats(clock))


@query
def duplicate_keys(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Q.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query
def orphan_keys(spark, sf_dir):
    lines, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    return Q.orphans(lines.select(F.col("l_orderkey").alias("k")), part.select(F.col("o_orderkey").alias("k")), "k")


@query
def validity_ratios(spark, sf_dir):
    return rounded(Q.validity_ratios(states(spark, sf_dir)))


@query
def map_coverage(spark, sf_dir):
    return Q.map_coverage(map_points(spark, sf_dir))


@query
def signal_coverage(spark, sf_dir):
    return rounded(Q.signal_coverage(signals(spark, sf_dir), states(spark, sf_dir)))


@query
def status_distribution(spark, sf_dir):
    return Q.status_distribution(FR.frame_targets(states(spark, sf_dir)))


@query
def split_counts(spark, sf_dir):
    return Q.split_counts(SP.assign_split(states(spark, sf_dir)))


@query
def feature_coverage(spark, sf_dir):
    k = kinematics(states(spark, sf_dir))
    return rounded(Q.feature_coverage(k, ["center_x", "heading", "derived_speed_mps", "derived_accel_mps2", "derived_jerk_mps3"]))


@query
def holdout_qc(spark, sf_dir):
    t = SP.assign_split(FR.frame_labels(frames_of(spark, sf_dir))).filter("split = 'internal_holdout'")
    return rounded(Q.holdout_qc(t, ["focal_clearance_m", "dominant_clearance_m"]))


@query
def profile_summary(spark, sf_dir):
    return rounded(Q.profile_summary(profile_of(spark, sf_dir)))


@query
def risk_set_audit(spark, sf_dir):
    return Q.risk_set_audit(FR.frame_targets(states(spark, sf_dir)))


@query
def method_audit(spark, sf_dir):
    return Q.method_audit(FR.frame_targets(states(spark, sf_dir)))


@query
def feature_contract(spark, sf_dir):
    k = kinematics(states(spark, sf_dir))
    return Q.feature_contract(k, ["center_x", "height", "derived_speed_mps", "derived_jerk_mps3", "no_such_feature"])


@query
def finite_features(spark, sf_dir):
    kept, counts = Q.finite_features(kinematics(states(spark, sf_dir)), ["center_x", "derived_speed_mps", "derived_accel_mps2"])
    return counts


@query
def primary_risk_set(spark, sf_dir):
    return rounded(Q.primary_risk_set(FR.frame_targets(states(spark, sf_dir))).select("scenario_id", "time_index", "target_status", "ttc_obb_swept_s"))


@query
def first_n_scenarios(spark, sf_dir):
    s = Q.first_n_scenarios(states(spark, sf_dir), 20)
    return s.groupBy("scenario_id").agg(F.count("*").alias("n_states"))


@query
def dev_only(spark, sf_dir):
    s = Q.dev_only(SP.assign_split(states(spark, sf_dir)))
    return s.groupBy("scenario_id", "split").agg(F.count("*").alias("n_states"))


@query
def assign_split(spark, sf_dir):
    ids = states(spark, sf_dir).select("scenario_id").distinct()
    c = F.col("scenario_id")
    return rounded(ids.select("scenario_id", SP.split_uniform(c).alias("u"), SP.split_of(c).alias("split"),
                              SP.legacy_split_of(c).alias("legacy_split"), SP.hash_sample(c).alias("warp_sample")), 9)


@query
def split_overlap(spark, sf_dir):
    """Scenarios whose canonical and legacy split differ, found as an overlap of the union."""
    ids = states(spark, sf_dir).select("scenario_id").distinct()
    both = (ids.withColumn("split", SP.split_of(F.col("scenario_id")))
            .unionByName(ids.withColumn("split", SP.legacy_split_of(F.col("scenario_id")))))
    return SP.split_overlap(both)


@query
def membership_audit(spark, sf_dir):
    s = states(spark, sf_dir)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("scenario_id"))
    return SP.membership_audit(s, SP.split_membership(supplier))


@query
def membership_digest(spark, sf_dir):
    return SP.membership_digest(SP.split_membership(states(spark, sf_dir)))


@query
def attach_split(spark, sf_dir):
    s = states(spark, sf_dir)
    joined = SP.attach_split(s, SP.split_membership(s))
    return joined.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if(F.col("split").isNull()).alias("n_unassigned"))


@query
def trajectory_signature(spark, sf_dir):
    return rounded(SP.trajectory_signature(states(spark, sf_dir)), 5)


@query
def near_duplicate_audit(spark, sf_dir):
    """Half-metre signatures over the scenarios and moved copies of every fourth one."""
    s = states(spark, sf_dir)
    copies = s.filter(F.col("scenario_id").cast("int") % 4 == 0).withColumns({"scenario_id": F.concat("scenario_id", F.lit("c")), "center_x": F.col("center_x") + 1024.0})
    return SP.near_duplicate_audit(SP.trajectory_signature(s.unionByName(copies)))


@query
def kpis(spark, sf_dir):
    return rounded(KP.all_kpis(states(spark, sf_dir), map_points(spark, sf_dir)), 4)


@query
def kpi_coverage(spark, sf_dir):
    return rounded(KP.kpi_coverage(KP.all_kpis(states(spark, sf_dir), map_points(spark, sf_dir))))


@query
def response_kpis(spark, sf_dir):
    s = states(spark, sf_dir)
    presence = durable(frame_presence(s))
    return rounded(KP.response_kpis(presence, FR.scene_criticality(s, presence)), 5)


@query
def motion_continuity(spark, sf_dir):
    return rounded(KP.motion_continuity(mixed_states(spark, sf_dir), mixed_map_points(spark, sf_dir)), 3)


@query
def continuity_pass_rates(spark, sf_dir):
    return rounded(KP.continuity_pass_rates(KP.motion_continuity(mixed_states(spark, sf_dir), mixed_map_points(spark, sf_dir))))


@query
def file_manifest(spark, sf_dir):
    """Name, extension, size and digest of every table file."""
    m = file_manifest_of(spark, sf_dir, glob="*.parquet")
    return m.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "split", "extension", "size_bytes", "sha256")


def stored(spark, sf_dir):
    """The actor table written by scenario bucket, in two parts with different bucket counts."""
    path = f"{shared_dir(spark)}/nearmiss/{uuid.uuid4().hex}"
    s = durable(states(spark, sf_dir))
    even = F.col("scenario_id").cast("int") % 2 == 0
    TB.write_table(s.filter(even), path, "agent_state", buckets=8, rows_per_file=5000)
    TB.write_table(s.filter(~even), path, "agent_state", buckets=3, mode="append")
    return path


@query
def write_read_table(spark, sf_dir):
    """Rows of the stored table by class, read with only the columns needed."""
    back = TB.read_table(spark, stored(spark, sf_dir), "agent_state", columns=["object_type", "scenario_id", "center_x", "valid"])
    return rounded(back.groupBy("object_type").agg(F.count("*").alias("n_rows"), F.count_distinct("scenario_id").alias("n_scenarios"),
                                                   F.count_if("valid").alias("n_valid"), F.avg("center_x").alias("mean_x")), 5)


@query
def read_scenario_slice(spark, sf_dir):
    """The stored rows of two scenarios, one from each part."""
    path = stored(spark, sf_dir)
    cols = ["scenario_id", "time_index", "track_id", "center_x", "valid"]
    one = lambda i: TB.read_scenario_slice(spark, path, "agent_state", i).select(*cols)
    return rounded(one("2").unionByName(one("7")))


@query
def scenario_ids(spark, sf_dir):
    return TB.scenario_ids(TB.read_table(spark, stored(spark, sf_dir), "agent_state", columns=["scenario_id"]))


@query
def incremental_pairs(spark, sf_dir):
    """Frame targets after the records arrive in two batches of files, with some scenarios in both."""
    from nearmiss.streaming.incremental import run_incremental
    base = f"{shared_dir(spark)}/nearmiss/{uuid.uuid4().hex}"
    r = durable(records(spark, sf_dir))
    even = F.col("scenario_id").cast("int") % 2 == 0
    for part in (even, ~even | (F.col("scenario_id").cast("int") % 4 == 0)):
        r.filter(part).write.mode("append").parquet(f"{base}/arrived")
        run_incremental(spark, f"{base}/arrived", f"{base}/out")
    out = spark.read.parquet(f"{base}/out/frame_targets")
    # Both contact states count as contact here.
    kind = F.when(F.col("target_status").isin("current_geometry_overlap", "future_contact_event"), "contact").otherwise(F.col("target_status"))
    return rounded(out.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_frames"), F.count_distinct("scenario_id").alias("n_scenarios")))


@query
def recomputed_outputs(spark, sf_dir):
    """Frame kinds and pairs per frame after one batch lost its frames, the other its pairs, and a further run made them again."""
    from nearmiss.streaming.incremental import run_incremental
    base = f"{shared_dir(spark)}/nearmiss/{uuid.uuid4().hex}"
    r = durable(records(spark, sf_dir))
    third = F.col("scenario_id").cast("int") % 3 == 0
    for part in (third, ~third | (F.col("scenario_id").cast("int") % 6 == 0)):
        r.filter(part).write.mode("append").parquet(f"{base}/arrived")
        run_incremental(spark, f"{base}/arrived", f"{base}/out")
    for batch, name in enumerate(("frame_targets", "pair_metrics")):
        place = f"{base}/out/{name}/batch={batch}"
        spark.createDataFrame([], spark.read.parquet(place).schema).write.mode("overwrite").parquet(place)
    run_incremental(spark, f"{base}/arrived", f"{base}/out")
    frames, pairs = (spark.read.parquet(f"{base}/out/{name}") for name in ("frame_targets", "pair_metrics"))
    kind = F.when(F.col("target_status").isin("current_geometry_overlap", "future_contact_event"), "contact").otherwise(F.col("target_status"))
    met = pairs.groupBy("scenario_id", "time_index").agg(F.count("*").alias("n"))
    return rounded(frames.join(met, ["scenario_id", "time_index"], "left").select(
        "scenario_id", "time_index", kind.alias("kind"), "n_eligible_pairs", F.coalesce("n", F.lit(0)).alias("n_pairs")))


@query
def read_scenarios(spark, sf_dir):
    """Records read from two splits of files that repeat some scenarios, within a file and, changed, across files; a third split is not asked for."""
    path = f"{shared_dir(spark)}/nearmiss/{uuid.uuid4().hex}"
    r = durable(records(spark, sf_dir))
    of = lambda n: r.filter(F.col("scenario_id").cast("int") % n == 0)
    changed = F.lit(99)
    r.unionByName(of(5)).repartition("scenario_id").write.parquet(f"{path}/split=a")
    of(3).withColumn("sdc_track_index", changed).write.parquet(f"{path}/split=b")
    of(2).withColumns({"sdc_track_index": changed, "scenario_id": F.concat("scenario_id", F.lit("x"))}).write.parquet(f"{path}/split=c")
    back = R.read_scenarios(spark, path, splits=["a", "b"])
    names = back.select("scenario_id", F.regexp_extract("source_file", r"split=([^/]+)", 1).alias("split"))
    return rounded(R.flatten_scenario(back).join(names, "scenario_id"))


def by_split(spark, sf_dir):
    return SP.assign_split(scores(spark, sf_dir))


@query
def split_guard(spark, sf_dir):
    """What the guard lets a development job read of each split: rows and positives, or a refusal."""
    df, out = by_split(spark, sf_dir), None
    for wanted in ("train", "internal_val", "internal_holdout", "external"):
        try:
            part = Q.split_guard(df, wanted).agg(F.lit(wanted).alias("split"), F.lit(False).alias("refused"), F.count("*").alias("n_rows"), F.sum("y").alias("n_positive"))
        except PermissionError:
            part = spark.range(1).select(F.lit(wanted).alias("split"), F.lit(True).alias("refused"), F.lit(0).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("n_positive"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def source_role_guard(spark, sf_dir):
    """The score table stored under a folder per source role: files that an audit of the scan blocks, and the rows behind them."""
    path = f"{shared_dir(spark)}/nearmiss/{uuid.uuid4().hex}"
    role = F.element_at(F.array(*[F.lit(r) for r in ("training", "validation", "testing")]), F.col("scenario_id").cast("int") % 3 + 1)
    rows = scores(spark, sf_dir).withColumn("role", role)
    for r in ("training", "validation", "testing"):
        rows.filter(F.col("role") == r).drop("role").write.parquet(f"{path}/{r}")
    scan = spark.read.option("recursiveFileLookup", "true").parquet(path)
    flags = TB.blocked_files(scan)
    found = F.regexp_extract("file_path", r"/(training|validation|testing)/[^/]*$", 1)
    n = (scan.select(F.lower("_metadata.file_path").alias("file_path")).groupBy("file_path").agg(F.count("*").alias("n"))
         .join(flags, "file_path", "left"))
    return n.groupBy(found.alias("role")).agg(F.max(F.coalesce("blocked", F.lit(False))).alias("blocked"), F.sum("n").alias("n_rows"))


@query
def write_reports(spark, sf_dir):
    """One result table written as CSV, JSON lines and Parquet and read back."""
    path = f"{shared_dir(spark)}/nearmiss/{uuid.uuid4().hex}"
    report = durable(rounded(by_split(spark, sf_dir).groupBy("split", "scenario_id").agg(F.count("*").alias("n_rows"), F.avg("p_full").alias("mean_p_full"))))
    out = None
    for fmt in ("csv", "json", "parquet"):
        TB.write_report(report, f"{path}/{fmt}", fmt)
        reader = spark.read.schema(report.schema).format(fmt)
        back = (reader.option("header", True) if fmt == "csv" else reader).load(f"{path}/{fmt}").withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query
def select_feature_set(spark, sf_dir):
    """A named feature set with its product columns, per frame."""
    pairs = [("gap_m", "n_lines"), ("gap_m", "p_base")]
    df = MD.with_interactions(scores(spark, sf_dir).withColumn("n_lines", F.col("n_lines").cast("double")), pairs)
    return rounded(df.select("scenario_id", "time_index", "gap_m", "n_lines", "p_base", *[f"{a}__x__{b}" for a, b in pairs]))
