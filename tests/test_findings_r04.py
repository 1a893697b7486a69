"""Findings of round 4: disk, time and memory of growing tables."""
import hashlib
import os

from pyspark.sql import functions as F

from conftest import state


def test_history_is_grouped_where_it_was_joined(states_df, tmp_path):
    """the frames before a frame are met in its span, so that the two grouped passes shuffle nothing."""
    from nearmiss.operators import features as X, frames as FR, pairs as P
    rows = [state(t=t, track=k, x=4.0 * k + t * 0.1 * k, vx=1.0 * k) for t in (0, 1, 9, 20, 30, 31, 35, 40, 61, 62, 90) for k in range(4)]
    df = states_df(rows)
    presence = P.frame_presence(df)
    past = X.past_actor_pairs(df, presence, X.focal_of(FR.scene_criticality(df, presence)))
    frames = sorted({r[1] for r in rows})
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(X.actor_context(past)) == exchanges(past.select("*"))
    want = sorted((t, u, k) for t in frames for u in frames if t - 10 <= u <= t for k in (1, 2, 3))
    assert sorted((r.time_index, r.u, r.track_id) for r in past.collect()) == want


def test_lane_points_of_small_scenarios_travel_once(spark):
    """a position of a small scenario is one row, whatever the number of cells around it."""
    from nearmiss.operators.mapjoin import lane_context
    pts = spark.createDataFrame([("a", 1, "lane", i, i * 3.0, 0.0) for i in range(40)], "scenario_id string, feature_id long, feature_type string, point_index int, x double, y double")
    pos = spark.createDataFrame([("a", t, t * 5.0, 1.0) for t in range(20)], "scenario_id string, time_index int, x0 double, y0 double")
    out = lane_context(pos, pts)
    assert "gx" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.time_index: (r.lane_points, r.lane_dispersion) for r in out.collect()}
    assert got == {t: (float(sum((i * 3.0 - t * 5.0) ** 2 + 1 <= 2500 for i in range(40))), 0.0) for t in range(20)}


def test_stored_tables_leave_no_shuffle_files(spark):
    """F8: the shuffles behind a stored table are gone when it is written."""
    from nearmiss.session import durable
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    kept = lambda: sum(f.getName().startswith("shuffle_") for d in env.blockManager().diskBlockManager().localDirs() for s in (d.listFiles() or []) for f in (s.listFiles() or []))
    spark.sparkContext._jvm.System.gc()
    before = kept()
    assert len(durable(spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count()).collect()) == 97
    assert kept() <= before


def test_manifest_of_files_that_are_no_single_value(spark, tmp_path):
    """a file above the size of one value is digested as a stream, also in a store that only the JVM opens."""
    from nearmiss.sources.tables import file_manifest
    d = tmp_path / "split=a b"
    d.mkdir()
    data = {"small.bin": b"abc", "large 1.bin": os.urandom(3_000_001), "large.gz": b"\n" * 2_500_000}
    for name, content in data.items():
        (d / name).write_bytes(content)
    with open(d / "huge.bin", "wb") as f:
        f.truncate((1 << 31) + 10)
    want = {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in data.items()}
    with open(d / "huge.bin", "rb") as f:
        want["huge.bin"] = ((1 << 31) + 10, hashlib.file_digest(f, "sha256").hexdigest())
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.f6.link./in", f"file://{tmp_path}")
    for path in (str(tmp_path), "viewfs://f6/in"):
        rows = file_manifest(spark, path, whole_bytes=1_000_000).collect()
        assert {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in rows} == want and {r.split for r in rows} == {"a b"}


def test_records_that_come_once_are_not_shuffled(spark):
    """only ids and the records of repeated ids are shuffled, and the same record of them stays."""
    from nearmiss.sources.records import distinct_scenarios
    rows = [(f"s{i}" if i else None, f"file{i % 3}", "x" * 50 + str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "scenario_id string, source_file string, body string")
    once = distinct_scenarios(df)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() == 20
    again = df.unionByName(df.filter("scenario_id is null or scenario_id in ('s4', 's5')").withColumn("source_file", F.lit("a first file")))
    got = {r.scenario_id: (r.source_file, r.body) for r in distinct_scenarios(again).collect()}
    assert got == {i: ("a first file" if i in (None, "s4", "s5") else f, b) for i, f, b in rows}


def test_few_records_are_read_at_once(spark, tmp_path, monkeypatch):
    """a batch of a reader is bounded while records are processed, and the session's setting comes back."""
    from nearmiss.streaming import incremental as INC
    seen, key = [], "spark.sql.parquet.columnarReaderBatchSize"
    monkeypatch.setattr(INC, "process_batch", lambda df, batch, out: seen.append(df.sparkSession.conf.get(key)))
    spark.createDataFrame([], INC.RECORD).coalesce(1).write.parquet(f"{tmp_path}/in")
    INC.run_incremental(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert set(seen) == {"128"} and spark.conf.get(key) == "4096"


def test_a_split_is_summed_for_one_of_its_children(spark, monkeypatch):
    """below the root, sums of the smaller child of each split reach the driver, and rows wait in cached blocks with their margins."""
    from nearmiss.operators import boosting as B
    rows = [(float(i % 17), float(i * 7 % 23), int((i % 17) * (i * 7 % 23) % 5 > 1)) for i in range(800)]
    train, levels, summed = spark.createDataFrame(rows, "a double, b double, y int"), [], B._summed

    def noted(parts, tasks):
        out = summed(parts, tasks)
        levels.append(out[0].shape[-1] // 16)
        return out

    monkeypatch.setattr(B, "_summed", noted)
    model = B.fit_together(train, {"f": (["a", "b"], "y")}, max_iter=2, max_depth=3, min_rows=5, bins=16)
    assert len(levels) == 6 and levels[0] == levels[3] == 1 and levels[1] == levels[4] == 1 and max(levels) <= 2
    assert all((feature[:7] >= 0).sum() >= 3 for feature, _, _ in model.fits["f"].trees)
