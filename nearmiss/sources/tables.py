"""Flat table storage: declared schemas, bucketed layout, guards and manifests."""
import hashlib

from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.operators.quality import split_guard  # noqa: F401  (re-exported next to the readers)

S, I, L, B, D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


SCHEMAS = {
    "scenario_table": _schema(scenario_id=S, segment_id=S, n_timestamps=I, n_tracks=I, sdc_track_index=I, n_map_features=I,
                              n_dynamic_signal_steps=I, n_objects_of_interest=I, has_sdc_paths=B, timestamp_start=D,
                              timestamp_end=D, duration_seconds=D),
    "agent_state": _schema(scenario_id=S, segment_id=S, time_index=I, frame_label=I, timestamp_seconds=D, track_id=L, obj_id=L,
                           object_type=S, valid=B, center_x=D, center_y=D, center_z=D, velocity_x=D, velocity_y=D, heading=D,
                           length=D, width=D, height=D, is_sdc=B, is_object_of_interest=B, derived_speed_mps=D,
                           derived_accel_mps2=D, derived_yaw_rate_rps=D, derived_jerk_mps3=D, derived_kinematic_valid=B),
    "frame_context": _schema(scenario_id=S, segment_id=S, time_index=I, frame_label=I, timestamp_seconds=D, n_valid_agents=I,
                             n_vehicles=I, n_pedestrians=I, n_cyclists=I, n_other=I),
    "map_feature": _schema(scenario_id=S, feature_id=L, feature_type=S, point_index=I, x=D, y=D, z=D),
    "dynamic_signal": _schema(scenario_id=S, time_index=I, lane_id=L, signal_state=S, stop_point_x=D, stop_point_y=D),
    "sdc_path_points": _schema(scenario_id=S, point_index=I, x=D, y=D, z=D),
}
# Path parts of data that must not be parsed.
BANNED_PATH_TOKENS = ("validation", "testing", "test")


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Schema columns in order, cast; absent ones are NULL."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("scenario_id"), F.lit(buckets)).cast("int")


#: Rows that a task sorts by bucket before it writes them.
_ROWS_PER_TASK = 500_000


def write_table(df: DataFrame, path: str, name: str, *, buckets: int = 64, rows_per_file: int = 2_000_000, mode: str = "errorifexists") -> None:
    """Aligned Parquet, partitioned by the number of hash buckets of the scenario id and the bucket.

    A directory per scenario would be one tiny file each; buckets keep files large and still prune. The bucket count is part of the
    path, so readers need not know it and tables written with different counts can share a folder. A bucket is spread over as many
    tasks and files as its share of the rows needs, whatever scenario they belong to. The number of tasks follows that of the rows.
    """
    rows = df.count()
    spread = max(1, -(-rows // (buckets * rows_per_file)))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // _ROWS_PER_TASK))
    out = align(df, SCHEMAS[name]).withColumns({"buckets": F.lit(buckets), "bucket": bucket_of(buckets)})
    out = out.withColumn("spread", F.pmod(F.xxhash64(*[c for c in out.columns if c not in ("bucket", "buckets")]), F.lit(spread)))
    (out.repartition(tasks, "bucket", "spread").drop("spread").write.mode(mode).option("maxRecordsPerFile", 2 * rows_per_file)
     .partitionBy("buckets", "bucket").parquet(f"{path}/{name}"))


def read_table(spark, path: str, name: str, *, columns=None) -> DataFrame:
    """Stored table; `columns` are the only ones read."""
    df = spark.read.parquet(f"{path}/{name}")
    return df.select(*columns) if columns else df


def read_scenario_slice(spark, path: str, name: str, scenario_id: str) -> DataFrame:
    """Rows of one scenario; only its bucket's directory is scanned, for each bucket count found in the table."""
    own = F.pmod(F.xxhash64(F.lit(scenario_id)), F.col("buckets")).cast("int")
    return read_table(spark, path, name).filter((F.col("bucket") == own) & (F.col("scenario_id") == scenario_id))


def scenario_ids(df: DataFrame) -> DataFrame:
    return df.select("scenario_id").distinct()


def check_source_paths(paths) -> None:
    """Refuse paths marked as validation or testing data before anything is parsed."""
    for p in paths:
        folder, _, name = p.lower().rpartition("/")
        for token in BANNED_PATH_TOKENS:
            if token in name or f"/{token}/" in folder + "/":
                raise PermissionError(f"source path holds the banned token {token!r}: {p}")


def blocked_files(df: DataFrame) -> DataFrame:
    """Files of a read whose path holds a banned token, for an audit of an existing scan."""
    path = F.lower(F.col("_metadata.file_path"))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    bad = F.lit(False)
    for token in BANNED_PATH_TOKENS:
        bad = bad | F.contains(name, F.lit(token)) | F.contains(path, F.lit(f"/{token}/"))
    return df.select(path.alias("file_path"), bad.alias("blocked")).filter("blocked").distinct()


#: Files above this size are digested as a stream: Spark's value of a file ends at 2 GiB and is held whole.
_WHOLE_BYTES = 1 << 25


def _digest_in_jvm(spark, path: str) -> str:
    """SHA-256 of a file of any file system that Spark reads, a megabyte at a time."""
    jvm = spark._jvm
    place, digest = jvm.org.apache.hadoop.fs.Path(path), jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestInputStream(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 20, True)
    return bytes(digest.digest()).hex()


def _digest_in_task(path: str) -> str:
    """SHA-256 of a file: URI, read as a stream."""
    with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_manifest(spark, path: str, *, glob: str = "*", whole_bytes: int = _WHOLE_BYTES) -> DataFrame:
    """Path, split part, extension, size and SHA-256 of every file below a folder.

    Files of up to `whole_bytes` are one value each. Larger ones are streamed, each by one task; on file systems that only Spark's JVM
    opens, by the driver one after the other, because no task could read them in parts.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))
    about = ["path", F.regexp_extract("path", r"split=([^/]+)", 1).alias("split"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension"), F.col("length").alias("size_bytes")]
    small = files.filter(F.col("length") <= whole_bytes).select(*about, F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_bytes).select(*about)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        large = large.withColumn("sha256", F.udf(_digest_in_task)("path"))
    else:
        digests = [(r.path, _digest_in_jvm(spark, r.path)) for r in large.select("path").collect()]
        large = large.join(spark.createDataFrame(digests, "path string, sha256 string"), "path")
    return small.unionByName(large)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result table as Parquet, CSV (with header) or JSON lines."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def save_membership(membership: DataFrame, path: str) -> None:
    membership.select("scenario_id", "split").write.mode("errorifexists").parquet(path)


def load_membership(spark, path: str) -> DataFrame:
    return spark.read.schema("scenario_id string, split string").parquet(path)
