"""Sources, sinks, splits, audits and the incremental run."""
import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from nearmiss.operators import linear as L, models as ML, quality as Q, splits as SP
from nearmiss.plans.catalog import QUERIES
from nearmiss.sources import fixture as FX, records as R, tables as T
from nearmiss.streaming import incremental as INC
from tests.conftest import state

SF = "/root/testdata/sf0.001"


def test_split_matches_digest(spark):
    ids = [f"id{i:x}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "scenario_id string")
    out = df.select("scenario_id", SP.split_uniform(F.col("scenario_id")).alias("u"), SP.legacy_split_of(F.col("scenario_id")).alias("old"), SP.hash_sample(F.col("scenario_id")).alias("w")).collect()
    for r in out:
        h = hashlib.sha256(f"womd_r2_split_v1|42|{r.scenario_id}".encode()).digest()
        assert r.u == struct.unpack(">Q", h[:8])[0] / 2 ** 64
        m = int(hashlib.md5(f"{r.scenario_id}_42".encode()).hexdigest(), 16) % 10000
        assert r.old == ("train" if m < 7000 else "internal_val" if m < 8500 else "internal_holdout")
        assert r.w == (int(hashlib.sha256(f"WACV2027_WARP_SEED_V3:{r.scenario_id}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < 0.2)


def test_membership_round_trip(spark, tmp_path):
    ids = spark.createDataFrame([(f"s{i}",) for i in range(50)], "scenario_id string")
    m = SP.split_membership(ids)
    T.save_membership(m, str(tmp_path / "m"))
    back = T.load_membership(spark, str(tmp_path / "m"))
    digest = lambda d: sorted(map(tuple, SP.membership_digest(d).collect()))
    assert digest(back) == digest(m)
    clean = SP.membership_audit(ids, back).first()
    assert (clean.n_overlap, clean.n_unassigned, clean.n_unknown, clean.n_external) == (0, 0, 0, 0)
    broken = back.filter("scenario_id <> 's1'").unionByName(spark.createDataFrame([("s2", "external_test"), ("zz", "train")], "scenario_id string, split string"))
    bad = SP.membership_audit(ids, broken).first()
    assert (bad.n_overlap, bad.n_unassigned, bad.n_unknown, bad.n_external) == (1, 1, 1, 1)


def test_near_duplicates(states_df):
    def path(name, x0, step):
        return [state(name, t, 0, x=x0 + step * t, y=x0) for t in range(12)]
    df = states_df(path("a", 0.0, 1.0) + path("b", 50.0, 1.0) + path("c", 0.0, 2.0) + path("short", 0.0, 1.0)[:5])
    sig = SP.trajectory_signature(df)
    assert sig.count() == 3
    assert SP.near_duplicate_clusters(sig).first().cluster_size == 2
    audit = SP.near_duplicate_audit(sig).first()
    assert (audit.unique_trajectory_signatures, audit.duplicate_cluster_count) == (2, 1)


def test_write_read_slice(spark, states_df, tmp_path):
    rows = [state(f"s{i}", t, 0) for i in range(20) for t in range(3)]
    T.write_table(states_df(rows), str(tmp_path), "agent_state", buckets=4)
    back = T.read_table(spark, str(tmp_path), "agent_state")
    assert back.count() == 60 and "segment_id" in back.columns and back.filter("height is not null").count() == 0
    one = T.read_scenario_slice(spark, str(tmp_path), "agent_state", "s7")
    assert one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [isnotnull(buckets" in plan
    narrow = T.read_table(spark, str(tmp_path), "agent_state", columns=["scenario_id", "time_index"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<scenario_id:string,time_index:int>" in narrow
    assert T.scenario_ids(back).count() == 20


def test_guards(spark, tmp_path):
    for bad in ("/data/validation/part-0", "/data/x/testing_01.parquet", "/data/test/a"):
        with pytest.raises(PermissionError):
            T.check_source_paths([bad])
    T.check_source_paths(["/data/training/part-0"])
    df = spark.createDataFrame([("a", "train")], "scenario_id string, split string")
    with pytest.raises(PermissionError):
        Q.split_guard(df, "internal_holdout")
    assert Q.split_guard(df, "train").count() == 1


def test_file_manifest(spark, tmp_path):
    d = tmp_path / "split=train"
    d.mkdir()
    (d / "a.bin").write_bytes(b"abc")
    r = T.file_manifest(spark, str(tmp_path)).first()
    assert (r.split, r.extension, r.size_bytes, r.sha256) == ("train", "bin", 3, hashlib.sha256(b"abc").hexdigest())


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for fmt in ("csv", "json", "parquet"):
        T.write_report(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b"]
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_duplicate_scenarios_are_read_once(spark, tmp_path):
    rec = FX.records(spark, SF)
    rec.withColumn("split", F.lit("training")).write.partitionBy("split").parquet(str(tmp_path / "r"))
    rec.limit(3).withColumn("split", F.lit("training")).write.mode("append").partitionBy("split").parquet(str(tmp_path / "r"))
    n = rec.count()
    assert R.read_scenarios(spark, str(tmp_path / "r"), splits=["training"]).count() == n
    assert R.read_scenarios(spark, str(tmp_path / "r"), splits=["other"]).count() == 0
    assert R.read_scenarios(spark, str(tmp_path / "r"), max_scenarios=2).count() == 2


def test_short_clock_and_unknown_type(spark):
    st = {"valid": True, "center_x": 1.0, "center_y": 2.0, "center_z": 0.0, "velocity_x": 0.0, "velocity_y": 0.0, "heading": 0.0, "length": 4.0, "width": 2.0, "height": 1.0}
    sign = {"id": 4, "stop_sign": {"position": None}}
    rec = spark.createDataFrame([{"scenario_id": "a", "timestamps_seconds": [0.0], "tracks": [{"id": 9, "object_type": 8, "states": [st, {**st, "valid": False}]}], "sdc_track_index": 0,
                                  "objects_of_interest": [9], "map_features": [sign, {"id": 5}], "dynamic_map_states": [{"lane_states": [{"lane": 1, "state": 4, "stop_point": None}]}], "sdc_paths": [{"x": 1.0, "y": 1.0, "z": 0.0}]}], R.RECORD)
    s = R.flatten_agent_state(rec).orderBy("time_index").collect()
    assert (s[0].object_type, s[0].timestamp_seconds, s[1].timestamp_seconds, s[1].center_x, s[0].is_sdc, s[0].is_object_of_interest) == ("UNKNOWN_8", 0.0, None, None, True, True)
    m = R.flatten_map_features(rec).collect()
    assert len(m) == 1 and m[0].feature_type == "stop_sign" and m[0].x is None
    r = R.flatten_scenario(rec).first()
    assert r.duration_seconds == 0.0 and r.has_sdc_paths
    assert R.flatten_sdc_paths(rec).count() == 1 and R.flatten_dynamic_signals(rec).first().signal_state == "LANE_STATE_STOP"
    assert R.flatten_frame_context(rec).first().n_other == 1


def test_audits_on_broken_tables(spark):
    good = [("a", 0, "future_contact_event", 2.0, False, False), ("a", 1, "right_censored", 10.0, True, False)]
    bad = good + [("a", 1, "right_censored", 10.0, True, True), ("b", 0, "future_contact_event", None, True, False), ("b", 1, "event", 1.0, False, False)]
    mk = lambda rows: spark.createDataFrame(rows, "scenario_id string, time_index int, target_status string, ttc_obb_swept_s double, right_censored boolean, overlap_now_flag boolean")
    names = ("overlap_in_primary", "censored_events", "bad_event_ttc", "unknown_status", "duplicate_frame_keys")
    pick = lambda rows: tuple(Q.risk_set_audit(mk(rows)).first()[n] for n in names)
    assert pick(good) == (0, 0, 0, 0, 0) and pick(bad) == (1, 1, 1, 1, 1)
    assert Q.method_audit(mk(good).withColumn("ttc_method", F.lit("circle"))).first().passed is False
    assert Q.method_audit(mk(good)).first().passed is False
    legacy = mk(good).withColumns({"ttc_method": F.lit("obb_swept_sat_cv_fixed_heading_v1"), "ttc_min_s": F.lit(1.0)})
    assert Q.method_audit(legacy).first().legacy_columns == 1 and not Q.method_audit(legacy).first().passed
    assert Q.leakage_audit(["ego_speed_mps"])["status"] == "PASS" and Q.leakage_audit(["max_closing_speed_mps"])["status"] == "FAIL"
    dup = Q.duplicate_keys(mk(bad), ["scenario_id", "time_index"]).first()
    assert (dup.duplicate_rows, dup.distinct_keys) == (2, 4)


def test_incremental_run_processes_files_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rec = FX.records(spark, SF)
    ids = [r.scenario_id for r in rec.select("scenario_id").orderBy("scenario_id").limit(4).collect()]
    part = lambda a, b: rec.filter(F.col("scenario_id").isin(ids[a:b])).coalesce(1)
    part(0, 2).write.parquet(src + "/one")
    assert INC.run_incremental(spark, src, out) >= 1
    n1 = spark.read.parquet(out + "/frame_targets").count()
    assert n1 == 2 * 91 and INC.run_incremental(spark, src, out) == 0
    part(2, 4).write.parquet(src + "/two")
    part(0, 1).write.parquet(src + "/validation")
    assert INC.run_incremental(spark, src, out) >= 1
    assert spark.read.parquet(out + "/frame_targets").count() == 4 * 91
    done = spark.read.parquet(out + "/progress")
    assert done.count() == 2 and done.filter("source_file like '%validation%'").count() == 0
    files = done.select("source_file").unionByName(spark.createDataFrame([("file:/x",)], "source_file string"))
    assert INC.missing_outputs(spark, done, files).count() == 1
    with pytest.raises(PermissionError):
        INC.run_incremental(spark, src + "/validation", out)


def test_lost_outputs_are_computed_again(spark, tmp_path):
    import glob
    import shutil
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rec = FX.records(spark, SF)
    ids = [r.scenario_id for r in rec.select("scenario_id").orderBy("scenario_id").limit(4).collect()]
    for i, (a, b) in enumerate([(0, 3), (2, 4)]):  # the third scenario arrives twice
        rec.filter(F.col("scenario_id").isin(ids[a:b])).coalesce(1).write.parquet(f"{src}/{i}")
        assert INC.run_incremental(spark, src, out) >= 1
    rows = lambda name: sorted(str(tuple(r)) for r in spark.read.parquet(f"{out}/{name}").collect())
    want = {n: rows(n) for n in INC.OUTPUTS}
    lost = lambda: {(r.batch, r.output, r.n_lost) for r in INC.lost_outputs(spark, out).collect()}
    assert lost() == set() and INC.run_incremental(spark, src, out) == 0
    shutil.rmtree(f"{out}/frame_targets/batch=0")
    assert lost() == {(0, "frame_targets", 3)} and INC.run_incremental(spark, src, out) == 1
    for f in glob.glob(f"{out}/pair_metrics/batch=1/part-*"):  # cut in the middle: neither magic nor footer
        data = open(f, "rb").read()
        open(f, "wb").write(data[: len(data) // 2])
    shutil.rmtree(f"{out}/frame_targets")
    assert {(b, o) for b, o, _ in lost()} == {(0, "frame_targets"), (1, "frame_targets"), (1, "pair_metrics")}
    assert INC.run_incremental(spark, src, out) == 2 and lost() == set()
    assert {n: rows(n) for n in INC.OUTPUTS} == want
    assert INC.run_incremental(spark, src, out) == 0


def test_repeats_are_found_without_moving_records(spark):
    rows = [("a", "f1", 5, 1), ("a", "f1", 2, 2), ("a", "f0", 9, 3), (None, "f1", 0, 4), (None, "f2", 0, 5), ("b", "f2", 1, 6), ("", "f2", 3, 7)]
    df = spark.createDataFrame(rows, "scenario_id string, source_file string, position long, body int")
    keep = {3, 4, 6, 7}
    assert {r.body for r in R.without_repeats(df).collect()} == keep
    assert {r.body for r in R.without_repeats(df, broadcast_rows=0).collect()} == keep
    assert R.without_repeats(df.limit(0)).count() == 0
    plan = R.without_repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_freeze_and_load(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)], "a double, b double, y int")
    m = ML.logistic(df, ["a", "b"], "y", reg=0.01)
    ML.freeze(m, ["a", "b"], str(tmp_path / "m"))
    back, features = ML.load(spark, str(tmp_path / "m"))
    assert features == ["a", "b"]
    p = lambda model: [r.p for r in ML.score(model, df, features, "p").collect()]
    assert p(back) == pytest.approx(p(m))


def test_gram_matches_numpy(spark):
    import numpy as np
    df = spark.range(50).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    z = np.column_stack([np.ones(50), np.arange(50) % 7, np.arange(50) % 3])
    assert np.allclose(L.gram(df.repartition(5), ["a", "b"]), z.T @ z)


# Catalog queries next to their SQL on the smallest data set.
SAMPLE = ["most_critical_scenarios", "pair_metrics", "frame_targets", "scenario_profile", "frame_feature_table", "kpis", "per_split_evaluation", "paired_delta_ci",
          "diagnostic_vector", "conditional_effect", "model_table", "followup_labels", "landmark_pair_features", "trajectory_signature", "flatten_agent_state"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    import duckdb
    import __spark_entry__ as entry
    from check import TABLES, canon
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), [d[0] for d in cur.description])


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 100


def test_constant_steps_have_no_deviation(spark):
    from nearmiss.operators.quality import timestamp_stats
    for n in (3, 6, 7, 12, 14, 91):
        frames = spark.createDataFrame([("s", t, 1000.1 + t / 10) for t in range(n)], "scenario_id string, time_index int, timestamp_seconds double")
        step = timestamp_stats(frames).filter("measure = 'step'").first()
        assert 0 <= step.stdev < 1e-12 and step["median"] == 0.1 and step["count"] == n - 1


def test_attach_split_stops_on_unassigned_and_doubly_assigned(spark):
    from nearmiss.operators.splits import attach_split
    df = spark.createDataFrame([("a",), ("b",)], "scenario_id string")
    known = lambda rows: spark.createDataFrame(rows, "scenario_id string, split string")
    assert {tuple(r) for r in attach_split(df, known([("a", "train"), ("b", "val"), ("a", "train")])).collect()} == {("a", "train"), ("b", "val")}
    for rows in ([("a", "train")], [("a", "train"), ("b", "val"), ("b", "train")]):
        with pytest.raises(Exception, match="split"):
            attach_split(df, known(rows)).collect()
