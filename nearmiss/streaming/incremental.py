"""Incremental pair and frame tables: each new source file is processed once.

The file source's checkpoint is the ledger of finished files and the sink's
folder per batch makes a repeated batch overwrite itself, so a restart neither
skips nor doubles a file. Each batch also notes how many rows every output
holds of every scenario; outputs that hold fewer or none are computed again
from the files of their batch.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from nearmiss.operators.frames import frame_targets
from nearmiss.operators.pairs import frame_presence, pair_metrics
from nearmiss.session import durable
from nearmiss.sources.records import RECORD, by_ids, distinct_scenarios, flatten_agent_state
from nearmiss.sources.tables import BANNED_PATH_TOKENS, check_source_paths


def allowed_path() -> "Column":
    """False for files whose path marks validation or testing data."""
    path = F.lower(F.col("_metadata.file_path"))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ok = F.lit(True)
    for token in BANNED_PATH_TOKENS:
        ok = ok & ~F.contains(name, F.lit(token)) & ~F.contains(path, F.lit(f"/{token}/"))
    return ok


def _new_scenarios(records: DataFrame, batch_id: int, out: str) -> DataFrame:
    """Records of scenarios that no earlier batch has processed; the ids of this batch are noted."""
    spark, path = records.sparkSession, f"{out}/scenarios"
    if _exists(spark, path):
        seen = spark.read.parquet(path).filter(F.col("batch") < batch_id).select("scenario_id")
        records = by_ids(records, durable(records.select("scenario_id").distinct().join(seen, "scenario_id", "left_semi")), "left_anti")
    records.select("scenario_id").distinct().write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return records


OUTPUTS = ("pair_metrics", "frame_targets")
#: Records that a reader unpacks at once; Spark's 4,096 are hundreds of megabytes of nested states.
_READ_AT_ONCE, _RECORDS_AT_ONCE = "spark.sql.parquet.columnarReaderBatchSize", 128


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_outputs(records: DataFrame, batch_id: int, out: str, names=OUTPUTS) -> None:
    """The named outputs of a batch's records, in the folder of the batch; what is there is replaced."""
    states = durable(flatten_agent_state(distinct_scenarios(records)))
    presence = durable(frame_presence(states))
    if "pair_metrics" in names:
        pairs = pair_metrics(states, presence, clearance=False, valid_targets_only=False)
        keep = [c for c in pairs.columns if not c.startswith(("e_", "t_")) and c not in ("dx", "dy", "dvx", "dvy")]
        pairs.select(*keep).write.mode("overwrite").parquet(f"{out}/pair_metrics/batch={batch_id}")
    if "frame_targets" in names:
        frame_targets(states, presence).write.mode("overwrite").parquet(f"{out}/frame_targets/batch={batch_id}")


def held_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that each output now holds of each scenario, by batch. Unreadable files count as lost."""
    found = spark.createDataFrame([], "batch int, scenario_id string, output string, n_rows long")
    for name in OUTPUTS:
        if _exists(spark, f"{out}/{name}"):
            rows = spark.read.schema("scenario_id string, batch int").option("ignoreCorruptFiles", "true").parquet(f"{out}/{name}")
            found = found.unionByName(rows.groupBy("batch", "scenario_id").agg(F.count("*").alias("n_rows")).withColumn("output", F.lit(name)))
    return found


def process_batch(records: DataFrame, batch_id: int, out: str) -> None:
    """Pairs, frame targets, the rows written and one completion event per source file; a scenario of an earlier batch is left out."""
    spark, records = records.sparkSession, durable(records)
    new = _new_scenarios(records, batch_id, out)
    write_outputs(new, batch_id, out)
    every = new.select("scenario_id").distinct().select("scenario_id", F.explode(F.array(*[F.lit(n) for n in OUTPUTS])).alias("output"))
    own = held_rows(spark, out).filter(F.col("batch") == batch_id).drop("batch")
    written = every.join(own, ["scenario_id", "output"], "left").select("scenario_id", "output", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    written.write.mode("overwrite").parquet(f"{out}/written/batch={batch_id}")
    events = records.groupBy("source_file").agg(F.countDistinct("scenario_id").alias("n_scenarios"))
    events.withColumn("status", F.lit("completed")).write.mode("overwrite").parquet(f"{out}/progress/batch={batch_id}")


def lost_outputs(spark: SparkSession, out: str) -> DataFrame:
    """(batch, output, n_lost): finished batches whose output lacks rows, with the number of scenarios concerned."""
    written = spark.read.schema("scenario_id string, output string, n_rows long, batch int").parquet(f"{out}/written")
    finished = spark.read.schema("source_file string, batch int").parquet(f"{out}/progress").select("batch").distinct()
    held = held_rows(spark, out).withColumnRenamed("n_rows", "n_held")
    short = written.join(held, ["batch", "scenario_id", "output"], "left").filter(F.col("n_rows") != F.coalesce("n_held", F.lit(0)))
    return short.join(finished, "batch", "left_semi").groupBy("batch", "output").agg(F.count("*").alias("n_lost"))


def recompute_lost(spark: SparkSession, out: str, *, fmt: str = "parquet") -> int:
    """Compute lost outputs again, batch by batch, from the batch's own files and scenarios; returns the number of batches.

    A batch has at most `files_per_batch` files, which bounds what the driver
    names; batches with losses are two numbers each.
    """
    if not _exists(spark, f"{out}/written"):
        return 0
    lost = lost_outputs(spark, out).groupBy("batch").agg(F.collect_set("output").alias("outputs")).orderBy("batch").collect()
    for row in lost:
        files = [r.source_file for r in spark.read.parquet(f"{out}/progress/batch={row.batch}").select("source_file").collect()]
        records = spark.read.schema(RECORD).format(fmt).load(files).withColumn("source_file", F.col("_metadata.file_path"))
        taken = spark.read.schema("scenario_id string").parquet(f"{out}/scenarios/batch={row.batch}")
        others = durable(records.select("scenario_id").distinct().join(taken, "scenario_id", "left_anti"))
        write_outputs(by_ids(records, others, "left_anti"), row.batch, out, row.outputs)
    return len(lost)


def run_incremental(spark: SparkSession, source: str, out: str, *, fmt: str = "parquet", files_per_batch: int = 1000) -> int:
    """Repeat batches that lost outputs, process every file not finished yet, then stop; returns the number of batches run or repeated.

    A folder that is itself marked as validation or testing data is refused
    before anything is listed; single files marked so are left out. A record
    is a whole scenario, so tasks hold few of them at once while this runs.
    """
    check_source_paths([source])
    at_once = spark.conf.get(_READ_AT_ONCE)
    spark.conf.set(_READ_AT_ONCE, str(min(int(at_once), _RECORDS_AT_ONCE)))
    try:
        return _run(spark, source, out, fmt, files_per_batch)
    finally:
        spark.conf.set(_READ_AT_ONCE, at_once)


def _run(spark: SparkSession, source: str, out: str, fmt: str, files_per_batch: int) -> int:
    stream = (spark.readStream.schema(RECORD).format(fmt).option("maxFilesPerTrigger", files_per_batch)
              .option("recursiveFileLookup", "true").load(source)
              .withColumn("source_file", F.col("_metadata.file_path")).filter(allowed_path()))
    repeated, done = recompute_lost(spark, out, fmt=fmt), []

    def sink(df, batch_id):
        process_batch(df, batch_id, out)
        done.append(batch_id)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/ledger").trigger(availableNow=True).start()
    query.awaitTermination()
    return repeated + len(done)


def missing_outputs(spark: SparkSession, progress: DataFrame, source_files: DataFrame) -> DataFrame:
    """Source files without a completion event."""
    return source_files.join(progress.select("source_file").distinct(), "source_file", "left_anti")
