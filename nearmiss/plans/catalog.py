"""Registry of queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.functions.columns import r6

QUERIES: dict = {}


def query(fn):
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, integers widened to long."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = r6(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(cols)
