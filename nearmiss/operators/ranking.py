"""Order statistics without a global window.

Everything that needs "how much lies before this value" goes through
prefix_sums: rows are reduced to one per distinct value and stored, cut into
ranges at approximate quantiles, each range is summed on its own and the range
totals (a bounded table) supply the offsets. The quantiles only balance the
work; the sums are exact wherever the cuts fall.
"""
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.operators.pairs import salted_join
from nearmiss.session import durable

def range_root(df: DataFrame) -> int:
    """Root of the number of ranges, following the session's shuffle width."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(4, math.ceil(math.sqrt(width)))


def range_of(df: DataFrame, value: str) -> Column:
    """Range number of a value: how many approximate quantiles of the column lie below it.

    The quantiles are at most a few thousand numbers; they are compared in two
    steps of `root` each.
    """
    root = range_root(df)
    n = root * root
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], max(1000, 10 * n))).first()[0]
    cuts = cuts or [0.0] * (n - 1)
    bounds = F.array(*[F.lit(float(b)) for b in cuts])
    every = F.array(*[F.lit(float(b)) for b in cuts[root - 1::root]])
    coarse = F.size(F.filter(every, lambda b: b < F.col(value)))
    return coarse * root + F.size(F.filter(F.slice(bounds, coarse * root + 1, root), lambda b: b < F.col(value)))


def prefix_sums(df: DataFrame, keys: list, value: str, sums: dict) -> DataFrame:
    """One row per (keys, value), ascending: sums at it, before it and in total.

    `sums` maps names to the columns to add up; results are name, name_before
    and name_total. NULL values are left out.
    """
    names = list(sums)
    points = durable(df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
                     .agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = (W.unboundedPreceding, -1)
    ranged = points.withColumn("range", range_of(points, value))
    inside = W.partitionBy(*keys, "range").orderBy(value).rowsBetween(*upto)
    per_range = ranged.groupBy(*keys, "range").agg(*[F.sum(n).alias(f"{n}_range") for n in names])
    ahead = group.orderBy("range").rowsBetween(*upto)
    offsets = per_range.select(*keys, "range", *[F.coalesce(F.sum(f"{n}_range").over(ahead), F.lit(0.0)).alias(f"{n}_off") for n in names],
                               *[F.sum(f"{n}_range").over(group).alias(f"{n}_total") for n in names])
    ranged = ranged.withColumns({f"{n}_in": F.coalesce(F.sum(n).over(inside), F.lit(0.0)) for n in names})
    out = ranged.join(offsets, [*keys, "range"])
    return out.select(*keys, value, *names, *[(F.col(f"{n}_off") + F.col(f"{n}_in")).alias(f"{n}_before") for n in names],
                      *[f"{n}_total" for n in names])


def average_ranks(df: DataFrame, keys: list, value: str, count: Column) -> DataFrame:
    """Average rank of each distinct value (ties share it), with counts as multiplicities."""
    p = prefix_sums(df, keys, value, {"n": count})
    return p.select(*keys, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"), F.col("n_total"))


def exact_quantiles(df: DataFrame, keys: list, value: str, levels: list, *, count: Column | None = None) -> DataFrame:
    """Linearly interpolated quantiles per group; only the two bracketing values meet per level.

    `count` is the multiplicity of a row, 1 if not given.
    """
    p = prefix_sums(df, keys, value, {"n": F.lit(1.0) if count is None else count.cast("double")})
    n, before = F.col("n_total") - 1, F.col("n_before")
    meets = lambda q: (before <= F.ceil(q * n)) & (F.floor(q * n) < before + F.col("n"))
    rows = p.withColumn("q", F.explode(F.filter(F.array(*[F.lit(float(q)) for q in levels]), meets))).withColumn("pos", F.col("q") * n)
    covers = lambda at: (before <= at) & (at < before + F.col("n"))
    low, high = F.floor("pos"), F.ceil("pos")
    hit = rows.filter(covers(low) | covers(high))
    frac = F.max(F.col("pos") - low)
    return hit.groupBy(*keys, "q").agg(
        (F.max(F.when(covers(low), F.col(value))) * (F.lit(1.0) - frac) + F.max(F.when(covers(high), F.col(value))) * frac).alias("quantile"))


def correlation(w: Column, x: Column, y: Column) -> Column:
    """Weighted Pearson correlation as one aggregate; NULL without spread."""
    s, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) / s - sx / s * (sy / s)
    vx = F.sum(w * x * x) / s - sx / s * (sx / s)
    vy = F.sum(w * y * y) / s - sy / s * (sy / s)
    return F.when((vx > 1e-14) & (vy > 1e-14), cov / F.sqrt(F.greatest(vx, F.lit(1e-300)) * F.greatest(vy, F.lit(1e-300))))


def spearman(df: DataFrame, keys: list, x: str, y: str, *, weight: Column | None = None,
             count: Column | None = None) -> DataFrame:
    """Rank correlation per group with average ranks.

    `count` is a row multiplicity (it shifts ranks), `weight` only weighs the
    moments. Rows are first merged by (x, y).
    """
    count = F.lit(1.0) if count is None else count.cast("double")
    weight = F.lit(1.0) if weight is None else weight
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = durable(df.groupBy(*keys, x, y).agg(F.sum(count).alias("f"), F.sum(weight * count).alias("w")))
    rx = average_ranks(pairs, keys, x, F.col("f")).withColumnRenamed("rank", "rx")
    ry = average_ranks(pairs, keys, y, F.col("f")).select(*keys, y, F.col("rank").alias("ry"))
    rows = salted_join(ry, salted_join(rx, pairs, [*keys, x], [y], buckets=2), [*keys, y], [x], buckets=2)
    n = F.col("n_total")
    agg = [correlation(F.col("w"), F.col("rx") / n, F.col("ry") / n).alias("rho"), F.max(n).cast("long").alias("n")]
    return rows.groupBy(*keys).agg(*agg) if keys else rows.agg(*agg)


def kendall_tau_b(df: DataFrame, keys: list, x: str, y: str) -> DataFrame:
    """Tau-b from discordance counts, without forming pairs.

    y is replaced by its dense order; two rows are discordant with y_i > y_j
    exactly once, at the highest bit in which their orders differ. Per bit and
    common prefix, rows with the bit set are counted before rows without it in
    the order of x: n log n rows in place of n^2 pairs.
    """
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = durable(df.groupBy(*keys, x, y).agg(F.count("*").cast("double").alias("f")))
    order_y = prefix_sums(pairs.select(*keys, y).distinct(), keys, y, {"k": F.lit(1.0)})
    order_y = order_y.select(*keys, y, F.col("k_before").cast("long").alias("oy"), F.col("k_total").cast("long").alias("ny"))
    rows = salted_join(order_y, pairs, [*keys, y], [x], buckets=2)
    top = F.ceil(F.log2(F.greatest(F.col("ny"), F.lit(2)).cast("double"))).cast("int")
    bits = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), top)))
    shifted = F.call_function("shiftright", F.col("oy"), F.col("bit"))
    bits = bits.withColumns({"prefix": F.call_function("shiftright", F.col("oy"), F.col("bit") + 1),
                             "one": shifted.bitwiseAND(F.lit(1).cast("long")) == 1})
    level = [*keys, "bit", "prefix"]
    seen = prefix_sums(bits, level, x, {"ones": F.when(F.col("one"), F.col("f")).otherwise(F.lit(0.0)),
                                        "zeros": F.when(F.col("one"), F.lit(0.0)).otherwise(F.col("f"))})
    choose = lambda n: n * (n - 1) / 2
    group = lambda d, *aggs: d.groupBy(*keys).agg(*aggs) if keys else d.agg(*aggs)
    discordant = group(seen, F.sum(F.col("zeros") * F.col("ones_before")).alias("d"))
    ties = lambda c, name: group(pairs.groupBy(*keys, c).agg(F.sum("f").alias("n")), F.sum(choose(F.col("n"))).alias(name))
    both = group(pairs, F.sum(choose(F.col("f"))).alias("n3"), F.sum("f").alias("n"))
    parts = [discordant, ties(x, "n1"), ties(y, "n2")]
    out = both
    if keys:
        for p in parts:
            out = out.join(p, keys)
    else:
        out = out.withColumns({c: p.scalar() for p, c in zip(parts, ("d", "n1", "n2"))})
    n0 = choose(F.col("n"))
    con_minus_dis = n0 - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d") * 2
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return out.select(*keys, F.when(den > 0, con_minus_dis / F.greatest(den, F.lit(1e-300))).alias("tau"), F.col("n").cast("long").alias("n"))


def top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k highest scenarios; ties go to the smaller id."""
    return df.select("scenario_id", score).orderBy(F.desc(score), "scenario_id").limit(k)


def positions(df: DataFrame, score: str, most: int, keys: list = ()) -> DataFrame:
    """Place of each scenario (of each group) by falling score, ties by id, for places up to `most`.

    Rows above a value come from prefix_sums; only rows of one value are numbered in a window.
    """
    rows = df.select(*keys, "scenario_id", F.col(score).alias("s")).filter(F.col("s").isNotNull())
    above = prefix_sums(rows, [*keys], "s", {"n": F.lit(1.0)}).select(*keys, "s", (F.col("n_total") - F.col("n_before") - F.col("n")).alias("above"))
    ties = W.partitionBy(*keys, "s").orderBy("scenario_id")
    placed = rows.join(above.filter(F.col("above") < most), [*keys, "s"]).withColumn("place", F.row_number().over(ties))
    return placed.select(*keys, "scenario_id", (F.col("above") + F.col("place")).cast("long").alias("pos")).filter(F.col("pos") <= most)


def top_k_overlap(ref: DataFrame, other: DataFrame, score_a: str, score_b: str, ks: list) -> DataFrame:
    """Share of common scenarios among the k highest of two rankings; NULL if either has fewer."""
    most = max(ks)
    a, b = positions(ref, score_a, most), positions(other, score_b, most)
    worst = a.join(b.withColumnRenamed("pos", "pos_b"), "scenario_id").select(F.greatest("pos", "pos_b").alias("worst"))
    size = lambda d: d.agg(F.count("*")).scalar()
    row = worst.agg(*[F.count_if(F.col("worst") <= k).alias(f"k{k}") for k in ks]).withColumns({"na": size(a), "nb": size(b)})
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(k).cast("long").alias("k"),
        F.when(F.least("na", "nb") >= k, F.col(f"k{k}") / F.lit(float(k))).alias("overlap")) for k in ks])))
