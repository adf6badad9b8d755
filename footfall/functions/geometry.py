"""Column expressions over points, triangles and planes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.constants import NORM_EPS

XYZ = ("x", "y", "z")


def normal(prefixes: tuple[str, str, str] = XYZ) -> tuple[Column, Column, Column]:
    """Unnormalised face normal from columns x0..z2."""
    e1 = [F.col(f"{p}1") - F.col(f"{p}0") for p in prefixes]
    e2 = [F.col(f"{p}2") - F.col(f"{p}0") for p in prefixes]
    return (
        e1[1] * e2[2] - e1[2] * e2[1],
        e1[2] * e2[0] - e1[0] * e2[2],
        e1[0] * e2[1] - e1[1] * e2[0],
    )


def length(n: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])


def unit_normal(n: tuple[Column, Column, Column]) -> list[Column]:
    """Normal over its guarded length (degenerate faces give about zero)."""
    size = length(n) + F.lit(NORM_EPS)
    return [c / size for c in n]


def tilt_deg(n_up: Column, size: Column) -> Column:
    """Angle between face and horizontal; degenerate faces count as horizontal."""
    cosine = F.when(size > NORM_EPS, F.abs(n_up) / size).otherwise(F.lit(1.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), cosine)))


def plane_height(a: Column, b: Column, c: Column, w: Column, d: Column) -> Column:
    return a * w + b * d + c


def depth(predicted: Column, u: Column) -> Column:
    return F.greatest(F.lit(0.0), predicted - u)


def flat_area() -> Column:
    """Area of the triangle w0,d0..w2,d2 projected on the base plane."""
    return 0.5 * F.abs(
        (F.col("w1") - F.col("w0")) * (F.col("d2") - F.col("d0"))
        - (F.col("w2") - F.col("w0")) * (F.col("d1") - F.col("d0"))
    )


def pick_axis(axis: str | Column, x: str | Column = "x", y: str | Column = "y", z: str | Column = "z") -> Column:
    axis = F.col(axis) if isinstance(axis, str) else axis
    x, y, z = (F.col(v) if isinstance(v, str) else v for v in (x, y, z))
    return F.when(axis == 0, x).when(axis == 1, y).otherwise(z)


def axis_name(axis: Column) -> Column:
    return F.element_at(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), axis + 1)


def plane_through(p0: str, p1: str, p2: str) -> Column:
    """Plane u = a w + b d + c through three points (structs of w, d, u); null if none is unique."""
    def diff(p: str, axis: str) -> Column:
        return F.col(f"{p}.{axis}") - F.col(f"{p0}.{axis}")

    w1, d1, u1, w2, d2, u2 = (diff(p, k) for p in (p1, p2) for k in ("w", "d", "u"))
    det = w1 * d2 - w2 * d1
    a = F.try_divide(u1 * d2 - u2 * d1, det)
    b = F.try_divide(w1 * u2 - w2 * u1, det)
    c = F.col(f"{p0}.u") - a * F.col(f"{p0}.w") - b * F.col(f"{p0}.d")
    return F.when(det != 0, F.struct(a.alias("a"), b.alias("b"), c.alias("c")))


MOMENTS = ("mw", "md", "mu", "vw", "vd", "cwd", "cwu", "cdu")


def plane_moments(w: str = "w", d: str = "d", u: str = "u") -> list[Column]:
    """Aggregates that determine a least-squares plane; they combine map-side."""
    return [
        F.avg(w).alias("mw"), F.avg(d).alias("md"), F.avg(u).alias("mu"),
        F.var_pop(w).alias("vw"), F.var_pop(d).alias("vd"), F.covar_pop(w, d).alias("cwd"),
        F.covar_pop(w, u).alias("cwu"), F.covar_pop(d, u).alias("cdu"),
    ]


def plane_from_moments() -> Column:
    """Least-squares plane from the moment columns.

    Support on one line or one point leaves the plane open; then the solution of
    smallest norm is taken, as a least-squares solver would.
    """
    mw, md, mu, vw, vd, cwd, cwu, cdu = (F.col(m) for m in MOMENTS)
    det = vw * vd - cwd * cwd
    full = det > 1e-12 * vw * vd
    a = F.try_divide(cwu * vd - cdu * cwd, det)
    b = F.try_divide(cdu * vw - cwu * cwd, det)
    regular = F.struct(a.alias("a"), b.alias("b"), (mu - a * mw - b * md).alias("c"))

    spread = vw + vd
    ew = F.sqrt(F.try_divide(vw, spread))
    ed = F.when(cwd < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.sqrt(F.try_divide(vd, spread))
    slope = F.try_divide(ew * cwu + ed * cdu, spread)
    rest = mu - slope * (ew * mw + ed * md)
    across = ew * md - ed * mw
    t = across * rest / (1 + across * across)
    la, lb = slope * ew - t * ed, slope * ed + t * ew
    line = F.struct(la.alias("a"), lb.alias("b"), (mu - la * mw - lb * md).alias("c"))

    norm = 1 + mw * mw + md * md
    point = F.struct((mu * mw / norm).alias("a"), (mu * md / norm).alias("b"), (mu / norm).alias("c"))
    return F.when(full, regular).when(spread > 0, line).otherwise(point)
