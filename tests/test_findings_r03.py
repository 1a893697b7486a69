"""Cases of the findings of round 3."""
from pyspark.sql import functions as F, types as T

from nearmiss.operators import diagnostics as D, mapjoin as MJ, resample as RS
from nearmiss.sources import records as R


def test_growing_tables_are_not_broadcast(spark):
    positions = spark.createDataFrame([("s", 0, 1.0, 2.0)], "scenario_id string, time_index int, x0 double, y0 double")
    points = spark.createDataFrame([("s", 1, "lane", i, float(i), 0.0) for i in range(4)],
                                   "scenario_id string, feature_id long, feature_type string, point_index int, x double, y double")
    for found in (MJ.nearest_distance(positions, points), MJ.lane_context(positions, points)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert MJ.nearest_distance(positions, points).first().distance_m == 2.0


def test_draws_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    ids = spark.createDataFrame([(str(i),) for i in range(50)], "scenario_id string")
    rows = lambda: sorted(map(tuple, RS.bootstrap_draws(ids, n_boot=40).collect()))
    whole = rows()
    monkeypatch.setattr(RS, "_DRAWS_PER_TASK", 100)
    assert rows() == whole
    assert sum(m for _, _, m in whole) == 50 * 40


def test_packed_draws_hold_every_multiplicity(spark):
    draws = spark.createDataFrame([(0, "a", 300), (2, "a", 1), (1, "b", 2)], "replicate int, scenario_id string, m long")
    packed = {r.scenario_id: RS._multiplicities(bytes(r.m)).tolist() for r in RS.packed_draws(draws, 3).collect()}
    assert packed == {"a": [300.0, 0.0, 1.0], "b": [0.0, 2.0, 0.0]}


def test_contact_at_tau_counts_whatever_its_last_bit(spark):
    df = spark.createDataFrame([(False, t, 10.0) for t in (2.0, 2.0000000000000004, 2.1)], "right_censored boolean, ttc_obb_swept_s double, censor_time_s double")
    assert D.conditional_brier(df, F.lit(1.0), F.lit(1.0), 2.0).first().n_events_at_tau == 2


def test_records_keep_double_precision(spark, tmp_path):
    state = dict(valid=True, center_x=0.0, center_y=0.0, center_z=0.0, velocity_x=0.1, velocity_y=0.0, heading=0.7853981633974483, length=4.5, width=0.8, height=1.5)
    row = {"scenario_id": "s", "timestamps_seconds": [0.0], "tracks": [{"id": 1, "object_type": 1, "states": [state]}], "sdc_track_index": 0}
    single = T.StructType.fromJson(R.RECORD.jsonValue())
    for f in single["tracks"].dataType.elementType["states"].dataType.elementType.fields[4:]:
        f.dataType = T.FloatType()
    spark.createDataFrame([row], R.RECORD).write.parquet(f"{tmp_path}/double")
    spark.createDataFrame([row], single).write.parquet(f"{tmp_path}/single")
    a, b = (R.flatten_agent_state(R.read_scenarios(spark, f"{tmp_path}/{n}")).first() for n in ("double", "single"))
    assert (a.velocity_x, a.heading, a.width) == (0.1, 0.7853981633974483, 0.8)
    assert abs(b.velocity_x - 0.1) < 1e-7 and b.velocity_x != 0.1


def test_records_are_written_by_several_tasks(spark):
    import glob

    from nearmiss.plans.tables import read_scenarios
    from nearmiss.session import shared_dir

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        read_scenarios(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{shared_dir(spark)}/nearmiss/*/split=a/part-*")) > 1


def test_feature_and_continuity_queries_broadcast_no_table(spark):
    from nearmiss.plans import context, tables

    sf = "/root/testdata/sf0.001"
    for query in (context.frame_feature_table, context.scenario_feature_means, tables.motion_continuity):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, query.__name__


def test_sums_of_units_hold_a_part_at_a_time(monkeypatch):
    import tracemalloc

    import numpy as np

    from nearmiss.llm import crosstok

    units = crosstok.Units(["a b a", "", "c", "a c c c"])
    for size in (1, 3, 100):
        monkeypatch.setattr(crosstok, "_SLICE", size)
        assert units.sums(np.array([1, 10, 100])).tolist() == [12, 0, 100, 301]
    monkeypatch.setattr(crosstok, "_SLICE", 1 << 16)
    units.at, units.n = np.zeros(1 << 21, np.int32), np.full(1 << 9, 1 << 12, np.int64)
    tracemalloc.start()
    assert units.sums(np.array([3])).tolist() == [3 << 12] * (1 << 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # 32 MB with all units at once


def test_toxicity_learns_from_every_labelled_row(spark):
    from nearmiss.llm import toxicity
    from nearmiss.llm.langid import held_out

    ids = [r.id for r in spark.range(2600).filter(~held_out(F.col("id"))).collect()]
    rows = [(i, f"{'vile%d' % (n % 40) if n % 4 == 0 else 'plain%d' % (n % 50)} text of row {n % 7}", "en" if n % 3 else "de", int(n % 4 == 0)) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), block_rows=500)
    scored = toxicity.score(docs.select("text", "toxic"), model).collect()
    assert sum(r.predicted != r.toxic for r in scored) <= 0.02 * len(scored)
    assert set(model.by_language) == {"de", "en"}
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 3 == 0, "vile").otherwise("kind")).alias("text"))
    count = many.filter(~held_out(F.col("doc_id"))).count()
    kept = []
    whole = toxicity._fit_blocks
    toxicity._fit_blocks = lambda blocks, n: kept.append(blocks.select(F.explode("rows")).count()) or whole(blocks, n, epochs=1)
    try:
        toxicity.fit(many, many.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    finally:
        toxicity._fit_blocks = whole
    assert kept == [count]


def test_toxicity_blocks_hold_no_unpacked_text(spark, monkeypatch):
    from nearmiss.llm import toxicity

    rows = [(i, None if i % 50 == 0 else f"{'vile' if i % 3 == 0 else 'kind'} text {i} " * 40, "en" if i % 2 else None, int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen = []
    whole = toxicity._fit_blocks
    monkeypatch.setattr(toxicity, "_fit_blocks", lambda blocks, n: seen.append((blocks.schema, blocks.collect())) or whole(blocks, n, epochs=1))
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), block_rows=50)
    schema, blocks = seen[0]
    assert schema["rows"].dataType.elementType.fieldNames() == ["y", "half", "lang"] and schema["texts"].dataType == T.BinaryType()
    import pyarrow as pa
    of = {(r[1] or ""): r for r in rows}
    texts = 0
    for b in blocks:
        kept = [t for part in toxicity._unpack_texts(pa.scalar(bytes(b.texts))) for t in part.to_pylist()]
        assert len(kept) == len(b.rows) and sum(len(t or "") for t in kept) > 10 * len(b.texts)
        for t, r in zip(kept, b.rows):
            assert not t or (of[t][3], of[t][2]) == (r.y, r.lang)
        texts += len(kept)
    assert texts == sum(len(b.rows) for b in blocks) > 250 and model.profiles.names == ["en"]


def test_small_maps_are_looked_up_in_one_row_per_type(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    points = [(s, 0, kind, i, float(x), float(y)) for s, n in (("small", 30), ("crowded", 120)) for kind in ("lane", "road_edge") for i, (x, y) in enumerate(rng.uniform(-900, 900, (n, 2)))]
    places = [(s, t, float(x), float(y)) for s in ("small", "crowded", "no_map") for t, (x, y) in enumerate(rng.uniform(-2000, 2000, (20, 2)))]
    pos = spark.createDataFrame(places, "scenario_id string, time_index int, x0 double, y0 double")
    pts = spark.createDataFrame(points, "scenario_id string, feature_id long, feature_type string, point_index int, x double, y double")
    want = {(s, t, k): min((x - x0) ** 2 + (y - y0) ** 2 for q, _, j, _, x, y in points if (q, j) == (s, k)) ** 0.5 for s, t, x0, y0 in places if s != "no_map" for k in ("lane", "road_edge")}
    joins = {}
    for limit in (0, 100, 1000):
        monkeypatch.setattr(MJ, "PACKED", limit)
        found = MJ.nearest_distance(pos, pts)
        rows = found.collect()
        assert len(rows) == len(want) and all(abs(want[r.scenario_id, r.time_index, r.feature_type] - r.distance_m) < 1e-9 for r in rows)
        joins[limit] = found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert joins[1000] == 1 < joins[100]  # one look-up where all maps are small


def test_warped_rows_do_not_carry_their_track(states_df):
    from conftest import state
    from nearmiss.operators import warp as WP

    rows = states_df([state("w", t, 5, x=1.0 * t + 0.01 * t * t) for t in range(40)]).selectExpr("scenario_id", "cast(track_id as long) track_id", "time_index", *WP.KINEMATIC)
    tracks = WP._track_verdicts(rows)
    moved = WP.retimed(rows, tracks, 0.15)
    assert not any(isinstance(f.dataType, T.ArrayType) for f in moved.schema)
    assert WP.broken_limits(moved, tracks).first().broken == ""
    away = moved.withColumn("my", F.when(F.col("time_index") >= 20, 1.5).otherwise(F.col("my")))
    assert "CROSS_TRACK" in WP.broken_limits(away, tracks).first().broken


def _ranked_in_full(rows, n_boot, multiplicity):
    """Spearman per replicate from expanded rows."""
    import numpy as np

    def ranks(v):
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[at]

    out = {}
    for b in range(n_boot):
        times = [multiplicity.get((b, s), 0) for s, *_ in rows]
        x, y, w = (np.repeat([r[i] for r in rows], times) for i in (1, 2, 3))
        u, v = ranks(x), ranks(y)
        u, v = u - np.average(u, weights=w), v - np.average(v, weights=w)
        out[b] = (w * u * v).sum() / np.sqrt((w * u * u).sum() * (w * v * v).sum())
    return out


def test_rank_replicates_of_tied_and_cut_values(spark, monkeypatch):
    """Values that fill a range, values that many scenarios share, and free ones, in ranges of a few rows and of all."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(f"s{i % 60}", float(rng.choice([0, 0, 0, 1, rng.normal()])), float(rng.choice([2, 2, 5, rng.normal()])), float(1 + i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "scenario_id string, x double, y double, w double").repartition(3)
    draws = RS.bootstrap_draws(df, n_boot=12)
    multiplicity = {(r.replicate, r.scenario_id): r.m for r in draws.collect()}
    merged = []
    whole = RS._merged
    monkeypatch.setattr(RS, "_merged", lambda n: merged.append(n) or whole(n), raising=False)
    for weight, own in ((F.col("w"), rows), (None, [(*r[:3], 1.0) for r in rows])):
        want = _ranked_in_full(own, 12, multiplicity)
        for range_rows, chunk in ((20_000, 512), (40, 7), (5, 2)):
            monkeypatch.setattr(RS, "_RANGE_ROWS", range_rows)
            monkeypatch.setattr(RS, "_CHUNK", chunk)
            got = {r.replicate: r.rho for r in RS.bootstrap_spearman(df, [], "x", "y", draws, weight=weight).collect()}
            assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-9 for b in want)
    assert merged


def test_equal_rows_are_summed_before_they_are_dealt():
    import numpy as np
    import pyarrow as pa

    names = ["k", "part_x", "part_y", "x", "y", "w", "f", "m"]
    m = RS.zlib.compress(np.array([[1, 0, 3], [0, 0, 1]], np.uint8).tobytes(), 1)  # 1, 0 and 259 times
    rows = [("a", 0, 0, 1.0, 2.0, 1.0, 1.0, m)] * 300 + [("a", 0, 0, float(i), 0.5, 2.0, 1.0, m) for i in range(20)]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
    out = list(RS._merged(3)([pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)]))
    assert [b.num_rows for b in out] == [20, 1]
    assert RS._vector(out[1].column(7)[0].as_py(), 3).tolist() == [300.0, 0.0, 259 * 300.0]


def test_packed_ranks_are_exact():
    import numpy as np

    for v in ([], [3], [1, 2, 70_000], [0, 1 << 40, 5], list(range(1000))):
        v = np.array(v, float)
        assert RS._unpack(RS._pack(v), len(v)).tolist() == v.tolist()
    assert len(RS._pack(720_000 + np.arange(1000.0))) == 2008


def test_paired_replicates_with_shared_and_free_scores(spark, monkeypatch):
    """Summed rows, single rows and small ranges give the same numbers."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(f"s{i % 40}", int(rng.random() < 0.3), float(rng.integers(0, 6)) / 10, float(rng.random())) for i in range(1500)]
    df = spark.createDataFrame(rows, "scenario_id string, y int, a double, b double")
    draws = RS.bootstrap_draws(df, n_boot=6)
    multiplicity = {(r.replicate, r.scenario_id): r.m for r in draws.collect()}
    for merge, range_rows, held in ((8, 20_000, 1000), (10**9, 20_000, 1000), (8, 3, 2)):
        for name, v in (("_MERGE", merge), ("_RANGE_ROWS", range_rows), ("_HELD", held)):
            monkeypatch.setattr(RS, name, v, raising=False)
        for r in RS.paired_metric_replicates(df, draws, "y", F.lit(1.0), {"a": "a", "b": "b"}).collect():
            p = np.array([row[2 if r.model == "a" else 3] for row in rows])
            m, y = np.array([multiplicity.get((r.replicate, row[0]), 0) for row in rows], float), np.array([row[1] for row in rows])
            auc = sum((m * (1 - y) * ((p < q) + 0.5 * (p == q))).sum() * n for q, n, one in zip(p, m, y) if one)
            ap = sum(n * (m * y * (p >= q)).sum() / (m * (p >= q)).sum() for q, n, one in zip(p, m, y) if one and n)
            assert abs(r.auroc - auc / ((m * y).sum() * (m * (1 - y)).sum())) < 1e-9 and abs(r.pr_auc - ap / (m * y).sum()) < 1e-9


def test_tables_are_written_by_as_many_tasks_as_their_rows_need(spark, monkeypatch, tmp_path):
    import glob
    import re

    from nearmiss.sources import tables as TB

    monkeypatch.setattr(TB, "_ROWS_PER_TASK", 100, raising=False)
    df = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 50).alias("scenario_id"), (F.col("id") % 91).cast("int").alias("time_index"))
    TB.write_table(df, str(tmp_path), "agent_state", buckets=2, rows_per_file=50)
    tasks = {re.search(r"part-(\d+)", f).group(1) for f in glob.glob(f"{tmp_path}/agent_state/*/*/part-*")}
    assert len(tasks) > 12 and TB.read_table(spark, str(tmp_path), "agent_state").count() == 4000
