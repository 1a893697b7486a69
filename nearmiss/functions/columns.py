"""Small column expressions shared by the operators."""
import math

from pyspark.sql import Column, functions as F


def flag(cond: Column) -> Column:
    """Boolean column with NULL read as false."""
    return F.coalesce(cond, F.lit(False))


def finite(c: Column) -> Column:
    """Not NULL, NaN or infinite (Spark orders NaN above infinity)."""
    return flag(F.abs(c) < F.lit(float("inf")))


def clip(c: Column, low, high) -> Column:
    """Value limited to [low, high]; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def wrap_angle(a: Column) -> Column:
    """Angle difference in [-pi, pi)."""
    return F.pmod(a + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)


def r6(c: Column, digits: int = 6) -> Column:
    """Half-up rounding with negative zero removed, for comparisons."""
    return F.round(c, digits) + F.lit(0.0)


def decode_enum(code: Column, names: dict) -> Column:
    """Enum code to name; an unlisted code becomes UNKNOWN_<code>."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code),
                      F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def hex_uniform(digest: Column, digits: int = 8) -> Column:
    """Leading hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("double") / F.lit(float(16 ** digits))


def salt_of(*keys: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def all_salts(buckets: int) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(buckets)]))
