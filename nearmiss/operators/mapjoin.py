"""Distances from moving positions to static points of the same scenario.

Points are first summarised per grid cell (tight bounding box, count, heading
sums). Positions look up the cells around them by key, never all cells of their
scenario; only cells that can hold the answer are opened. Results are exact: the cell bounds are true bounds.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nearmiss.operators.pairs import FRAME, salted_join
from nearmiss.session import durable_rows

# Cells are 25 m, 200 m and 1,600 m wide; beyond these a scenario is one cell.
CELL_M, FACTOR, LEVELS = 25.0, 8, 3
# Added to the reach of a look-up, so that rounding never loses a cell.
SLACK_M = 1e-6
# A scenario of at most so many points is one packed cell.
PACKED = 256


def _cell(c: str) -> Column:
    return F.floor(F.col(c) / CELL_M)


def with_cells(points: DataFrame) -> DataFrame:
    return (points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
            .withColumns({"gx": _cell("x"), "gy": _cell("y")}))


def cell_summary(points: DataFrame, extra=()) -> DataFrame:
    return points.groupBy("scenario_id", "feature_type", "gx", "gy").agg(
        F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), *extra)


def _bounds(df: DataFrame) -> DataFrame:
    """Smallest and largest possible squared distance from (x0, y0) to a point of the cell."""
    c = F.col
    near = lambda p, a, b: F.greatest(c(a) - c(p), c(p) - c(b), F.lit(0.0))
    far = lambda p, a, b: F.greatest(F.abs(c(p) - c(a)), F.abs(c(p) - c(b)))
    nx, ny, fx, fy = near("x0", "x1", "x2"), near("y0", "y1", "y2"), far("x0", "x1", "x2"), far("y0", "y1", "y2")
    return df.withColumns({"low2": nx * nx + ny * ny, "high2": fx * fx + fy * fy})


def _d2() -> Column:
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    return dx * dx + dy * dy


def _side() -> Column:
    """Width of the row's cells."""
    return F.get(F.array(*[F.lit(CELL_M * FACTOR ** k) for k in range(LEVELS + 1)]), F.col("level"))


def _level_cell(c: str) -> Column:
    """Coordinate at `level` of a cell given at level 0; the last level is one cell."""
    level = F.col("level")
    return F.when(level == LEVELS, F.lit(0)).otherwise(F.floor(F.col(c) / F.pow(F.lit(float(FACTOR)), level))).cast("long")


def _window(low: Column, high: Column) -> Column:
    """Cells of the row's level that meet the interval; the last level has only cell 0."""
    at = lambda v: F.when(F.col("level") == LEVELS, F.lit(0)).otherwise(F.floor(v / _side())).cast("long")
    return F.explode(F.sequence(at(low), at(high)))


def _gap2() -> Column:
    """Squared distance from (x0, y0) to the square of cell (cx, cy)."""
    gap = lambda p, c: F.greatest(F.col(c) * _side() - F.col(p), F.col(p) - (F.col(c) + 1) * _side(), F.lit(0.0))
    gx, gy = gap("x0", "cx"), gap("y0", "cy")
    return gx * gx + gy * gy


def nearest_distance(positions: DataFrame, points: DataFrame) -> DataFrame:
    """Exact distance from each position (scenario, frame, x0, y0) to the nearest point of each feature type.

    Cells form levels of growing size, the last one cell per scenario. A position looks up the four cells nearest to it on each level by key; the
    tightest far corner found bounds the distance. On the first level with a cell the bound spans at most three cells either way, so the
    cells within it are again looked up by key, and those that can beat the nearest far corner are opened. The points of a small scenario
    (`PACKED`) travel as one array per type in its one cell of the last level, so a position needs one row for each type.
    """
    points = durable_rows(with_cells(points).select("scenario_id", "feature_type", "gx", "gy", "x", "y"))
    crowded = durable_rows(points.groupBy("scenario_id").agg(F.count("*").alias("n")).filter(F.col("n") > PACKED).select("scenario_id"))
    if crowded.isEmpty():
        return _nearest_packed(positions, points)
    only = lambda df, how: df.join(crowded, "scenario_id", how)
    return (_nearest_packed(only(positions, "left_anti"), only(points, "left_anti"))
            .unionByName(_nearest_in_cells(only(positions, "left_semi"), durable_rows(only(points, "left_semi")))))


_OF_LEVEL = ["scenario_id", "level", "cx", "cy"]


def _packed(positions: DataFrame, points: DataFrame, fields: list) -> tuple:
    """Positions and points on the last level, whose points are one array per cell and type."""
    in_level = points.withColumn("level", F.lit(LEVELS)).withColumns({"cx": _level_cell("gx"), "cy": _level_cell("gy")})
    looked = positions.withColumn("level", F.lit(LEVELS)).withColumn("cx", _window(F.col("x0"), F.col("x0"))).withColumn("cy", _window(F.col("y0"), F.col("y0")))
    return looked, durable_rows(in_level.groupBy(*_OF_LEVEL, "feature_type").agg(F.collect_list(F.struct(*fields)).alias("points")))


def _nearest_packed(positions: DataFrame, points: DataFrame) -> DataFrame:
    """nearest_distance for scenarios of few points, each one cell."""
    looked, packed = _packed(positions, points, ["x", "y"])

    def d2(p):
        dx, dy = p["x"] - F.col("x0"), p["y"] - F.col("y0")
        return dx * dx + dy * dy

    return looked.join(packed, _OF_LEVEL).select(*FRAME, "feature_type", F.sqrt(F.array_min(F.transform("points", d2))).alias("distance_m"))


def _nearest_in_cells(positions: DataFrame, points: DataFrame) -> DataFrame:
    """nearest_distance by cells of all levels."""
    at_cell = ["scenario_id", "feature_type", "gx", "gy"]
    of_level = ["scenario_id", "level", "cx", "cy"]
    base = cell_summary(points).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    members = durable_rows(base.withColumns({"cx": _level_cell("gx"), "cy": _level_cell("gy")}))
    cells = members.groupBy(*of_level, "feature_type").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    half = _side() / 2
    around = (positions.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
              .withColumn("cx", _window(F.col("x0") - half, F.col("x0") + half)).withColumn("cy", _window(F.col("y0") - half, F.col("y0") + half)))
    reach = _bounds(around.join(cells, of_level)).groupBy(*FRAME, "feature_type").agg(
        F.min("high2").alias("reach2"), F.min("level").alias("level"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    r = F.sqrt("reach2") + SLACK_M
    within = (reach.withColumn("cx", _window(F.col("x0") - r, F.col("x0") + r)).withColumn("cy", _window(F.col("y0") - r, F.col("y0") + r))
              .filter((F.col("level") == LEVELS) | (_gap2() <= r * r)))
    met = _bounds(within.join(members, [*of_level, "feature_type"])).filter(F.col("low2") <= F.col("reach2"))
    best = F.min("high2").over(W.partitionBy(*FRAME, "feature_type"))
    near_cells = met.withColumn("best2", best).filter(F.col("low2") <= F.col("best2")).select(*at_cell, "time_index", "x0", "y0")
    opened = salted_join(near_cells, points.select(*at_cell, "x", "y"), at_cell, ["x", "y"], buckets=2)
    return (opened.groupBy(*FRAME, "feature_type").agg(F.min(_d2()).alias("d2"))
            .select(*FRAME, "feature_type", F.sqrt("d2").alias("distance_m")))


def lane_headings(points: DataFrame, *, chunk: int = 4096) -> DataFrame:
    """Heading of each lane point towards the next one; the last repeats the one before, a lone point is 0.

    A feature is handled in chunks of point indices; the first and last point of
    each chunk (a small table) link the chunks, so a very long polyline is not
    one group.
    """
    c = F.col
    lanes = points.filter((c("feature_type") == "lane") & c("x").isNotNull() & c("y").isNotNull())
    lanes = lanes.withColumn("chunk", F.floor(c("point_index") / chunk))
    part = ["scenario_id", "feature_id", "chunk"]
    at = F.struct("x", "y")
    ends = lanes.groupBy(*part).agg(F.min_by(at, "point_index").alias("first"), F.max_by(at, "point_index").alias("last"))
    chunks = W.partitionBy("scenario_id", "feature_id").orderBy("chunk")
    links = ends.select(*part, F.lead("first").over(chunks).alias("next_first"), F.lag("last").over(chunks).alias("prev_last"))
    inside = W.partitionBy(*part).orderBy("point_index")
    rows = lanes.join(links.hint("merge"), part).withColumns({"n": F.coalesce(F.lead(at).over(inside), c("next_first")), "p": F.coalesce(F.lag(at).over(inside), c("prev_last"))})
    ahead, behind = F.atan2(c("n.y") - c("y"), c("n.x") - c("x")), F.atan2(c("y") - c("p.y"), c("x") - c("p.x"))
    return rows.withColumn("lane_heading", F.coalesce(ahead, behind, F.lit(0.0))).drop("n", "p", "next_first", "prev_last", "chunk")


def lane_context(positions: DataFrame, points: DataFrame, *, radius_m: float = 50.0) -> DataFrame:
    """Lane points within the radius and their heading dispersion.

    The points of a small scenario (`PACKED`) travel as one array, which each of its positions meets once. In others, cells within reach are
    looked up by key; those wholly inside contribute their sums, only cells on the rim are opened.
    """
    lanes = durable_rows(with_cells(lane_headings(points)).select("scenario_id", "feature_type", "gx", "gy", "x", "y", F.cos("lane_heading").alias("c"), F.sin("lane_heading").alias("s")))
    crowded = durable_rows(lanes.groupBy("scenario_id").agg(F.count("*").alias("n")).filter(F.col("n") > PACKED).select("scenario_id"))
    if crowded.isEmpty():
        out = _lanes_packed(positions, lanes, radius_m)
    else:
        only = lambda df, how: df.join(crowded, "scenario_id", how)
        out = (_lanes_packed(only(positions, "left_anti"), only(lanes, "left_anti"), radius_m)
               .unionByName(_lanes_in_cells(only(positions, "left_semi"), durable_rows(only(lanes, "left_semi")), radius_m)))
    return out.select(*FRAME, F.col("n").cast("double").alias("lane_points"),
                      F.when(F.col("n") > 2, dispersion(F.col("sc") / F.col("n"), F.col("ss") / F.col("n")))
                       .otherwise(F.lit(0.0)).alias("lane_dispersion"))


def _lanes_packed(positions: DataFrame, lanes: DataFrame, radius_m: float) -> DataFrame:
    """Count and heading sums (n, sc, ss) per position for scenarios of few points, each one array."""
    looked, packed = _packed(positions, lanes, ["x", "y", "c", "s"])

    def inside(p):
        dx, dy = p["x"] - F.col("x0"), p["y"] - F.col("y0")
        return dx * dx + dy * dy <= radius_m * radius_m

    near = looked.join(packed, _OF_LEVEL).select(*FRAME, F.filter("points", inside).alias("near")).filter(F.size("near") > 0)
    total = lambda field: F.aggregate("near", F.lit(0.0), lambda a, p: a + p[field])
    return near.select(*FRAME, F.size("near").cast("long").alias("n"), total("c").alias("sc"), total("s").alias("ss"))


def _lanes_in_cells(positions: DataFrame, lanes: DataFrame, radius_m: float) -> DataFrame:
    """The same by cells."""
    cells = cell_summary(lanes, [F.count("*").alias("n"), F.sum("c").alias("sc"), F.sum("s").alias("ss")])
    r2 = radius_m * radius_m
    at_cell = ["scenario_id", "feature_type", "gx", "gy"]
    reach = radius_m + SLACK_M
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / CELL_M), F.floor((F.col(c) + reach) / CELL_M)))
    looked = positions.withColumn("gx", around("x0")).withColumn("gy", around("y0"))
    met = _bounds(looked.join(cells.hint("merge"), ["scenario_id", "gx", "gy"])).filter(F.col("low2") <= r2)
    inside = met.filter(F.col("high2") <= r2).select(*FRAME, "n", "sc", "ss")
    rim = met.filter(F.col("high2") > r2).select(*at_cell, "time_index", "x0", "y0")
    opened = salted_join(rim, lanes.select(*at_cell, "x", "y", "c", "s"), at_cell, ["x", "y"], buckets=2).filter(_d2() <= r2)
    opened = opened.select(*FRAME, F.lit(1).cast("long").alias("n"), F.col("c").alias("sc"), F.col("s").alias("ss"))
    return inside.unionByName(opened).groupBy(*FRAME).agg(F.sum("n").alias("n"), F.sum("sc").alias("sc"), F.sum("ss").alias("ss"))


def dispersion(mean_cos: Column, mean_sin: Column) -> Column:
    """Circular dispersion 1 - R, clipped to [0, 1]."""
    r = F.sqrt(mean_cos * mean_cos + mean_sin * mean_sin)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - r))


def signal_context(positions: DataFrame, signals: DataFrame, *, radius_m: float = 70.0) -> DataFrame:
    """Nearest stop point of the frame's signals and the count of stop signals within the radius."""
    placed = signals.filter(F.col("stop_point_x").isNotNull() & F.col("stop_point_y").isNotNull()).select(
        *FRAME, "lane_id", F.upper("signal_state").alias("state"), F.col("stop_point_x").alias("x"), F.col("stop_point_y").alias("y"))
    met = salted_join(positions, placed, FRAME, ["lane_id"]).withColumn("d2", _d2())
    stop = F.col("state").contains("STOP") | F.col("state").contains("RED")
    return met.groupBy(*FRAME).agg(
        F.sqrt(F.min("d2")).alias("signal_m"),
        F.count_if(stop & (F.col("d2") <= radius_m * radius_m)).cast("double").alias("stop_signals"))
