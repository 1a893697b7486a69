"""Deterministic splits, hash sampling and trajectory near-duplicates."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.constants import SPLIT_FRACTIONS, SPLIT_NAMESPACE, SPLIT_SEED
from nearmiss.functions.columns import flag, hex_uniform

# Fixed value: seed string of the augmentation sample.
WARP_SEED = "WACV2027_WARP_SEED_V3"


def split_uniform(scenario_id: Column, namespace=SPLIT_NAMESPACE, seed=SPLIT_SEED) -> Column:
    """First 64 bits of SHA-256 of 'namespace|seed|id' as a number in [0, 1)."""
    digest = F.sha2(F.concat_ws("|", F.lit(namespace), F.lit(str(seed)), scenario_id), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("double")
    return (high * F.lit(2.0 ** 32) + low) / F.lit(2.0 ** 64)


def _by_fraction(u: Column, scale=1.0) -> Column:
    train = SPLIT_FRACTIONS["train"]
    val = train + SPLIT_FRACTIONS["internal_val"]
    return (F.when(u < round(train * scale, 9), "train").when(u < round(val * scale, 9), "internal_val")
            .otherwise("internal_holdout"))


def split_of(scenario_id: Column, namespace=SPLIT_NAMESPACE, seed=SPLIT_SEED) -> Column:
    return _by_fraction(split_uniform(scenario_id, namespace, seed))


def legacy_split_of(scenario_id: Column, seed=SPLIT_SEED) -> Column:
    """MD5 of 'id_seed' modulo 10000, taken 32 bits at a time."""
    digest = F.md5(F.concat_ws("_", scenario_id, F.lit(str(seed))))
    rest = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        rest = (rest * F.lit(2 ** 32) + part) % F.lit(10000)
    return _by_fraction(rest, 10000)


def assign_split(df: DataFrame, **kw) -> DataFrame:
    """Split is a function of the id, so no membership table has to be joined."""
    return df.withColumn("split", split_of(F.col("scenario_id"), **kw))


def split_membership(df: DataFrame) -> DataFrame:
    return assign_split(df.select("scenario_id").distinct())


def hash_sample(scenario_id: Column, ratio: float = 0.20, seed: str = WARP_SEED) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(seed), scenario_id), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF)) < ratio


def split_overlap(membership: DataFrame) -> DataFrame:
    """Scenarios listed under more than one split."""
    return (membership.groupBy("scenario_id")
            .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
            .filter("first_split <> last_split"))


def attach_split(df: DataFrame, membership: DataFrame) -> DataFrame:
    """Each row with the split of its scenario; a row without one, or a scenario listed under two, stops the job."""
    one = membership.groupBy("scenario_id").agg(F.min("split").alias("split"), F.max("split").alias("other"))
    stop = lambda what: F.raise_error(F.concat(F.lit(what), F.coalesce("scenario_id", F.lit("NULL")))).cast("string")
    checked = F.when(F.col("split").isNull(), stop("no split for scenario ")).when(F.col("split") != F.col("other"), stop("two splits for scenario ")).otherwise(F.col("split"))
    return df.join(one, "scenario_id", "left").withColumn("split", checked).drop("other")


def membership_audit(scenarios: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: overlap, unassigned, unknown and external scenarios must all be 0."""
    ids = scenarios.select("scenario_id").distinct().withColumn("known", F.lit(True))
    per_id = membership.groupBy("scenario_id").agg(
        F.min("split").alias("a"), F.max("split").alias("b"), F.count_if(F.col("split") == "external_test").alias("ext"))
    both = ids.join(per_id, "scenario_id", "full")
    return both.agg(
        F.count("*").alias("n_scenarios"), F.count_if(flag(F.col("a") != F.col("b"))).alias("n_overlap"),
        F.count_if(F.col("a").isNull()).alias("n_unassigned"), F.count_if(F.col("known").isNull()).alias("n_unknown"),
        F.count_if(F.coalesce("ext", F.lit(0)) > 0).alias("n_external"))


def membership_digest(membership: DataFrame) -> DataFrame:
    """Per split: size and an order-free digest (sum of 60-bit id hashes, exact)."""
    h = F.conv(F.substring(F.sha2("scenario_id", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return membership.groupBy("split").agg(F.count("*").alias("n_scenarios"), F.sum(h).cast("string").alias("digest"))


def trajectory_signature(states: DataFrame, *, step_m: float = 0.5, min_frames: int = 10) -> DataFrame:
    """Digest of the ego path relative to its start on a grid. At most one point per frame is gathered."""
    c = F.col
    by_time = W.partitionBy("scenario_id").orderBy("time_index")
    ego = states.filter(flag(c("is_sdc")) & flag(c("valid"))).select(
        "scenario_id", "time_index", "center_x", "center_y", "heading", "velocity_x", "velocity_y")
    dx, dy = c("center_x") - F.lag("center_x").over(by_time), c("center_y") - F.lag("center_y").over(by_time)
    cell = lambda axis: F.bround((c(axis) - F.first(axis).over(by_time)) / step_m, 0).cast("long").cast("string")
    rows = ego.withColumns({"step": F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)),
                            "point": F.concat_ws(",", cell("center_x"), cell("center_y")),
                            "speed": F.sqrt(c("velocity_x") * c("velocity_x") + c("velocity_y") * c("velocity_y"))})
    points = F.transform(F.array_sort(F.collect_list(F.struct("time_index", "point"))), lambda p: p["point"])
    out = rows.groupBy("scenario_id").agg(
        F.count("*").alias("n_frames"), F.sha2(F.concat_ws(";", points), 256).alias("signature_hash"),
        F.sum("step").alias("total_distance_m"), F.avg("speed").alias("avg_speed_mps"),
        F.min_by("heading", "time_index").alias("start_heading"), F.max_by("heading", "time_index").alias("end_heading"))
    return assign_split(out.filter(c("n_frames") >= min_frames))


def near_duplicate_clusters(signatures: DataFrame) -> DataFrame:
    """Signatures shared by several scenarios, and whether they cross splits."""
    return (signatures.groupBy("signature_hash")
            .agg(F.count("*").alias("cluster_size"), F.min("split").alias("a"), F.max("split").alias("b"))
            .filter("cluster_size > 1").withColumn("cross_split", F.col("a") != F.col("b")).drop("a", "b"))


def near_duplicate_audit(signatures: DataFrame) -> DataFrame:
    per = signatures.groupBy("signature_hash").agg(
        F.count("*").alias("n"), (F.min("split") != F.max("split")).alias("crosses"))
    dup = F.col("n") > 1
    leak = dup & F.col("crosses")
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_scenarios_audited"),
                  F.count("*").alias("unique_trajectory_signatures"),
                  F.count_if(dup).alias("duplicate_cluster_count"),
                  F.count_if(leak).alias("cross_split_leakage_cluster_count"),
                  F.coalesce(F.sum(F.when(leak, F.col("n"))), F.lit(0)).alias("cross_split_scenarios_count"))
    return out.withColumn("verdict", F.when(F.col("cross_split_leakage_cluster_count") == 0, "PASS")
                          .otherwise("RESOLVED_BY_GROUPING"))
