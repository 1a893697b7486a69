"""Session helpers."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict = {}
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, or a temporary one for local sessions without it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="run-"))


def durable(df: DataFrame) -> DataFrame:
    """Table cut from its lineage: written once to the shared folder and read back.

    For tables that several later steps read. A lost executor costs a re-read,
    not a recomputation, and later plans stay short. The shuffle files behind
    it go when it is written.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/nearmiss/{uuid.uuid4().hex}", spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def durable_rows(df: DataFrame) -> DataFrame:
    """Durable table that grows with the input: joins shuffle it and never broadcast it.

    Its compressed files can be under the broadcast threshold while its rows
    take a multiple of that in the driver.
    """
    return durable(df).hint("merge")
