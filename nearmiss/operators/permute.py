"""Label-blind permutation of context columns within strata."""
from pyspark.sql import DataFrame, Window as W, functions as F

from nearmiss.functions.columns import hex_uniform
from nearmiss.operators import ranking as RK
from nearmiss.session import durable


def quartile_of(df: DataFrame, column: str):
    """Quartile bin 0..3 of a column by its exact quartiles (right-closed, like a quantile cut)."""
    cuts = [r["quantile"] for r in RK.exact_quantiles(df, [], column, [0.25, 0.5, 0.75]).orderBy("q").collect()]
    v = F.col(column)
    return sum(((v > float(q)).cast("int") for q in cuts), F.lit(0))


def permute_within(df: DataFrame, columns: list, keys: list, strata: list, *, seed: int) -> DataFrame:
    """Replace `columns` by those of another row of the same stratum, a random one-to-one assignment.

    Both orders are hashes of (row key, seed); each row's position in either
    order comes from range-wise prefix counts, so a stratum holding a large
    share of the rows is not sorted in one task.
    """
    return _permuted(durable(df), columns, keys, strata, F.lit(str(seed)))


def _permuted(rows: DataFrame, columns: list, keys: list, strata: list, seed) -> DataFrame:
    text = [F.col(k).cast("string") for k in keys]
    draw = lambda tag: hex_uniform(F.md5(F.concat_ws("|", F.concat(seed, F.lit(tag)), *text)), 13)
    rows = rows.withColumns({"h_to": draw("a"), "h_from": draw("b")})

    def place(d: DataFrame, h: str) -> DataFrame:
        before = RK.prefix_sums(d, strata, h, {"n": F.lit(1.0)}).select(*strata, h, "n_before")
        tie = F.row_number().over(W.partitionBy(*strata, h).orderBy(*text))
        return d.join(before, [*strata, h]).withColumn("pos", (F.col("n_before") + tie - 1).cast("long"))

    to = place(rows, "h_to").drop("h_to", "h_from", *columns)
    source = place(rows, "h_from").select(*strata, "pos", *columns)
    return to.join(source, [*strata, "pos"]).drop("pos")


def permuted_copies(df: DataFrame, columns: list, keys: list, strata: list, *, seeds) -> DataFrame:
    """keys and, for every seed, <column>__<seed>: the columns as permute_within deals them; all seeds in one pass. Keys name rows."""
    own = list(dict.fromkeys([*keys, *strata]))
    rows = durable(df.select(*own, *columns, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed_")))
    mixed = _permuted(rows, columns, keys, [*strata, "seed_"], F.col("seed_").cast("string"))
    return mixed.groupBy(*keys).agg(*[F.max(F.when(F.col("seed_") == s, F.col(c))).alias(f"{c}__{s}") for s in seeds for c in columns])
