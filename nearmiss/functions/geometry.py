"""Pair geometry as native expressions over ego (e_*) and target (t_*) columns.

Each step is its own projection, so a shared term is computed once per row and
the whole chain stays inside code generation.
"""
from pyspark.sql import Column, DataFrame, functions as F

from nearmiss.constants import CONTACT_TOL, STATIC_EPS, T_MAX_S

STATE = ["center_x", "center_y", "velocity_x", "velocity_y", "heading", "length", "width"]


def prefixed(prefix: str) -> list:
    return [F.col(c).alias(prefix + c) for c in STATE]


def with_exprs(df: DataFrame, **exprs: str) -> DataFrame:
    """One projection adding SQL expressions."""
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in exprs.items()])


def with_relative_state(df: DataFrame) -> DataFrame:
    """Position and velocity of the target relative to the ego, and centre distance."""
    df = with_exprs(df, dx="t_center_x - e_center_x", dy="t_center_y - e_center_y",
                    dvx="t_velocity_x - e_velocity_x", dvy="t_velocity_y - e_velocity_y")
    return with_exprs(df, pair_distance_m="sqrt(dx * dx + dy * dy)")


def closing_speed(dist: str = "pair_distance_m") -> Column:
    """Speed at which the gap shrinks along the line of centres; 0 when centres coincide."""
    return F.expr(f"CASE WHEN {dist} > 1e-6 THEN -(dvx * (dx / {dist}) + dvy * (dy / {dist})) ELSE 0D END")


def in_heading_frame(x: str, y: str, heading: str) -> tuple[Column, Column]:
    """(longitudinal, lateral) components of a vector in a heading frame."""
    return (F.expr(f"{x} * cos({heading}) + {y} * sin({heading})"),
            F.expr(f"-{x} * sin({heading}) + {y} * cos({heading})"))


def speed(prefix: str = "") -> Column:
    vx, vy = f"{prefix}velocity_x", f"{prefix}velocity_y"
    return F.expr(f"sqrt({vx} * {vx} + {vy} * {vy})")


def with_box_axes(df: DataFrame) -> DataFrame:
    """Per separating axis (two per box): centre offset o, relative speed v, summed support radius r."""
    df = with_exprs(df, ec="cos(e_heading)", es="sin(e_heading)", tc="cos(t_heading)", ts="sin(t_heading)",
                    ehl="e_length / 2", ehw="e_width / 2", thl="t_length / 2", thw="t_width / 2")
    df = with_exprs(df, rc="ec * tc + es * ts", rs="ec * ts - es * tc")
    axes = [("ec", "es"), ("(-es)", "ec"), ("tc", "ts"), ("(-ts)", "tc")]
    return with_exprs(
        df, **{f"o{k}": f"dx * {x} + dy * {y}" for k, (x, y) in enumerate(axes)},
        **{f"v{k}": f"dvx * {x} + dvy * {y}" for k, (x, y) in enumerate(axes)},
        r0="ehl + abs(rc) * thl + abs(rs) * thw", r1="ehw + abs(rs) * thl + abs(rc) * thw",
        r2="thl + abs(rc) * ehl + abs(rs) * ehw", r3="thw + abs(rs) * ehl + abs(rc) * ehw")


BOX_TEMP = ["ec", "es", "tc", "ts", "ehl", "ehw", "thl", "thw", "rc", "rs",
            *[p + str(k) for p in "ovr" for k in range(4)]]


def with_swept_contact(df: DataFrame, t_max: float = T_MAX_S, *, clearance: bool = False) -> DataFrame:
    """Constant-velocity contact window of two boxes (needs with_box_axes).

    Adds ttc_s, contact_exit_s, overlap_now, hit_future: the intersection over
    the four axes of the times at which the projections touch, within
    [0, t_max]; on request also the boundary distance, box_gap_m.

    The axes are handled by one array function. It keeps this projection out of
    the fused stage, whose single method would otherwise be too long for the
    JVM to compile; the projection's own code is split into small methods.
    """
    tm, axes = f"{float(t_max)!r}D", ", ".join(f"named_struct('o', o{k}, 'v', v{k}, 'r', r{k})" for k in range(4))
    window = f"""transform(array({axes}), a -> CASE WHEN abs(a.v) < {STATIC_EPS!r}D
        THEN CASE WHEN abs(a.o) <= a.r + {CONTACT_TOL!r}D THEN named_struct('i', 0D, 'x', {tm})
                  ELSE named_struct('i', double('Infinity'), 'x', double('-Infinity')) END
        ELSE named_struct('i', least((-a.r - a.o) / a.v, (a.r - a.o) / a.v), 'x', greatest((-a.r - a.o) / a.v, (a.r - a.o) / a.v)) END)"""
    df = with_exprs(df, axis_window=window, **({"box_gap_m": box_clearance()} if clearance else {}))
    each = lambda f: ", ".join(f"axis_window[{k}].{f}" for k in range(4))
    df = with_exprs(df, enter_s=f"greatest(0D, {each('i')})", leave_s=f"least({tm}, {each('x')})")
    df = with_exprs(df, hit_future=f"enter_s <= leave_s + {CONTACT_TOL!r}D")
    return with_exprs(df, overlap_now=f"hit_future AND enter_s <= {CONTACT_TOL!r}D",
                      ttc_s=f"CASE WHEN hit_future THEN enter_s ELSE {tm} END",
                      contact_exit_s="CASE WHEN hit_future THEN leave_s END").drop("axis_window", "enter_s", "leave_s")


def box_clearance() -> str:
    """Boundary distance of two boxes (needs with_box_axes).

    Disjoint convex boxes are nearest at a corner of one of them, so the
    distance of eight corners to the other box, taken in that box's own frame,
    is exact; touching or overlapping boxes are at distance 0.
    """
    def corners(ox, oy, sin, hl, hw, bl, bw):
        for a in ("", "-"):
            for b in ("", "-"):
                x = f"{ox} + {a}{hl} * rc + {b}{hw} * {sin}"
                y = f"{oy} - {a}{hl} * {sin} + {b}{hw} * rc"
                yield f"pow(greatest(abs({x}) - {bl}, 0D), 2) + pow(greatest(abs({y}) - {bw}, 0D), 2)"

    gaps = [*corners("-o2", "-o3", "rs", "ehl", "ehw", "thl", "thw"), *corners("o0", "o1", "(-rs)", "thl", "thw", "ehl", "ehw")]
    apart = " OR ".join(f"abs(o{k}) > r{k} + {CONTACT_TOL!r}D" for k in range(4))
    return f"CASE WHEN {apart} THEN sqrt(least({', '.join(gaps)})) ELSE 0D END"


def with_circle_contact(df: DataFrame, t_max: float = T_MAX_S) -> DataFrame:
    """Contact of the circumscribed circles: first root of |p + v t| = R within the horizon.

    Adds circle_ttc_s, circle_overlap_now, circle_hit_future (also true for an
    overlap) and circle_dtc_m, the smallest gap of the circles on the way.
    """
    tm = f"{float(t_max)!r}D"
    radius = lambda p: f"sqrt({p}length * {p}length + {p}width * {p}width) / 2"
    df = with_exprs(df, cr=f"{radius('e_')} + {radius('t_')}", qa="dvx * dvx + dvy * dvy",
                    qb="2 * (dx * dvx + dy * dvy)", d2="dx * dx + dy * dy")
    df = with_exprs(df, overlap="sqrt(d2) <= cr", disc="qb * qb - 4 * qa * (d2 - cr * cr)")
    df = with_exprs(df, t_close=f"CASE WHEN qa > {STATIC_EPS!r}D THEN -qb / (2 * qa) ELSE 0D END",
                    root=f"CASE WHEN qa > {STATIC_EPS!r}D AND disc >= 0 THEN (-qb - sqrt(disc)) / (2 * qa) END")
    df = with_exprs(df, meets=f"NOT overlap AND coalesce(root > 0 AND root <= {tm}, false)",
                    nearest2=f"CASE WHEN t_close > 0 AND t_close <= {tm} THEN greatest(qa * t_close * t_close + qb * t_close + d2, 0D) ELSE d2 END")
    return with_exprs(
        df, circle_overlap_now="overlap", circle_hit_future="overlap OR meets",
        circle_ttc_s=f"CASE WHEN overlap THEN 0D WHEN meets THEN root ELSE {tm} END",
        circle_dtc_m="CASE WHEN overlap OR meets THEN 0D ELSE greatest(sqrt(nearest2) - cr, 0D) END",
    ).drop("cr", "qa", "qb", "d2", "overlap", "disc", "t_close", "root", "meets", "nearest2")
