"""Mesh tables: bounds, triangle gather, axis roles, tread segmentation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from footfall.functions import constants as K
from footfall.functions import geometry as G
from footfall.operators.keyed import KeyTable, attach, settle
from footfall.operators.quantiles import exact_quantiles
from footfall.session import materialize


@dataclass(frozen=True)
class Mesh:
    """vertices(mesh_id, vid, x, y, z) and faces(mesh_id, fid, v0, v1, v2)."""

    vertices: DataFrame
    faces: DataFrame
    normals: DataFrame | None = None


def scaled(vertices: DataFrame, scale: float | F.Column) -> DataFrame:
    factor = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    return vertices.withColumns({c: F.col(c) * factor for c in G.XYZ})


def bounds(vertices: DataFrame) -> DataFrame:
    """One row per mesh: n_vertices and min/max/center/size of every axis."""
    aggs = [F.count(F.lit(1)).alias("n_vertices")]
    for c in G.XYZ:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_center")]
    out = vertices.groupBy("mesh_id").agg(*aggs)
    return out.withColumns({f"{c}_size": F.col(f"{c}_max") - F.col(f"{c}_min") for c in G.XYZ})


def triangles(mesh: Mesh) -> DataFrame:
    """One row per face with its corner coordinates x0..z2.

    Corners are exploded and looked up by one equi-join keyed by (mesh, vertex), so a
    large mesh spreads over all tasks; a face with an unknown vertex is an error for every reader.
    """
    corners = mesh.faces.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid"))
    found = corners.join(mesh.vertices, ["mesh_id", "vid"], "left")
    picked = [
        F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in G.XYZ
    ]
    out = found.groupBy("mesh_id", "fid").agg(F.count("x").alias("_n"), *picked)
    return out.where(_or_raise(F.col("_n") == 3, "face refers to a missing vertex in mesh ")).drop("_n")


def _or_raise(test: F.Column, message: str) -> F.Column:
    """A filter that keeps every row and fails, naming the mesh, where ``test`` doesn't hold; filters are never pruned."""
    return F.when(test, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(message), F.col("mesh_id"))).cast("boolean"))


def mean_abs_normals(tris: DataFrame) -> DataFrame:
    nx, ny, nz = G.unit_normal(G.normal())
    return tris.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("n_faces"),
        F.avg(F.abs(nx)).alias("anx"), F.avg(F.abs(ny)).alias("any"), F.avg(F.abs(nz)).alias("anz"),
    )


def axis_roles(box: DataFrame, tris: DataFrame) -> DataFrame:
    """Infer up axis (largest mean absolute normal) and width/depth (smaller/larger extent).

    Returns the bounds row plus ``width_axis, depth_axis, up_axis`` (0, 1 or 2). A mesh without
    faces is an error: its axes must be given.
    """
    joined = box.join(mean_abs_normals(tris), "mesh_id", "left")
    joined = joined.where(_or_raise(F.col("n_faces").isNotNull(), "no faces to infer axes from in mesh "))
    means = F.array("anx", "any", "anz")
    up = (F.array_position(means, F.array_max(means)) - 1).cast("int")
    joined = joined.withColumn("up_axis", up)
    first = F.when(F.col("up_axis") == 0, 1).otherwise(0)
    second = F.when(F.col("up_axis") == 2, 1).otherwise(2)
    r0 = G.pick_axis(first, "x_size", "y_size", "z_size")
    r1 = G.pick_axis(second, "x_size", "y_size", "z_size")
    return joined.withColumns({
        "width_axis": F.when(r0 < r1, first).otherwise(second).cast("int"),
        "depth_axis": F.when(r0 < r1, second).otherwise(first).cast("int"),
    })


def given_roles(box: DataFrame, width: int, depth: int, up: int) -> DataFrame:
    """Fixed axis roles; faces are not looked at, so their number stays unknown."""
    return box.withColumns({
        "n_faces": F.lit(None).cast("long"), "width_axis": F.lit(width), "depth_axis": F.lit(depth), "up_axis": F.lit(up),
    })


def axis_names(roles: DataFrame) -> DataFrame:
    cols = {k: G.axis_name(F.col(f"{k}_axis")) for k in ("width", "depth", "up")}
    text = F.concat(
        F.lit("AxisConfig(width="), cols["width"], F.lit(", depth="), cols["depth"],
        F.lit(", up="), cols["up"], F.lit(")"),
    )
    return roles.select("mesh_id", *[c.alias(k) for k, c in cols.items()], text.alias("axis_repr"))


def frame(roles: DataFrame) -> KeyTable:
    """Per-mesh frame: axis roles and extents along width (w), depth (d) and up (u)."""
    extents = {}
    for short, role in (("w", "width_axis"), ("d", "depth_axis"), ("u", "up_axis")):
        for edge in ("min", "max"):
            extents[f"{short}_{edge}"] = G.pick_axis(role, *[f"{c}_{edge}" for c in G.XYZ])
    return settle(
        roles.withColumns(extents).select(
            "mesh_id", "n_vertices", "n_faces", "width_axis", "depth_axis", "up_axis", *extents
        ),
        "frame", most_vertices=F.max("n_vertices"), vertices=F.sum("n_vertices"), most_faces=F.max("n_faces"),
    ).with_hot("n_vertices")


def roles_of(frame_table: KeyTable) -> KeyTable:
    return frame_table.of(frame_table.df.select("mesh_id", "width_axis", "depth_axis", "up_axis"))


def oriented_points(vertices: DataFrame, frame_table: KeyTable) -> DataFrame:
    """vertices as (mesh_id, vid, w, d, u)."""
    joined = attach(vertices, roles_of(frame_table), spread=["vid"])
    return joined.select(
        "mesh_id", "vid", *[G.pick_axis(f"{role}_axis").alias(s) for s, role in (("w", "width"), ("d", "depth"), ("u", "up"))]
    )


def oriented_triangles(tris: DataFrame, frame_table: KeyTable) -> DataFrame:
    """triangles as (mesh_id, fid, w0, d0, u0, .., u2)."""
    joined = attach(tris, roles_of(frame_table), spread=["fid"])
    cols = [
        G.pick_axis(f"{role}_axis", *[f"{c}{k}" for c in G.XYZ]).alias(f"{s}{k}")
        for k in range(3) for s, role in (("w", "width"), ("d", "depth"), ("u", "up"))
    ]
    return joined.select("mesh_id", "fid", *cols)


def with_tilt(tris: DataFrame) -> DataFrame:
    """Oriented triangles plus centroid (cw, cd) and tilt angle."""
    n = G.normal(("w", "d", "u"))
    return tris.withColumns({
        "cw": (F.col("w0") + F.col("w1") + F.col("w2")) / 3.0,
        "cd": (F.col("d0") + F.col("d1") + F.col("d2")) / 3.0,
        "tilt": G.tilt_deg(n[2], G.length(n)),
    })


def roi_window(tilted: DataFrame, quantiles: Sequence[float], **kw) -> DataFrame:
    """Per-mesh centroid window over all faces: w_lo, w_hi, d_lo, d_hi."""
    qw = exact_quantiles(tilted, "cw", quantiles, **kw)
    qd = exact_quantiles(tilted, "cd", quantiles, **kw)
    return qw.select("mesh_id", "n", F.col("q")[0].alias("w_lo"), F.col("q")[1].alias("w_hi")).join(
        qd.select("mesh_id", F.col("q")[0].alias("d_lo"), F.col("q")[1].alias("d_hi")), "mesh_id"
    )


def segment_tread(
    tris: DataFrame,
    angle_deg: float = K.TREAD_ANGLE_DEG,
    roi: Sequence[float] = K.ROI_QUANTILES,
    largest: int | None = None,
) -> DataFrame:
    """Oriented triangles plus ``is_tread``: near-horizontal and inside the centroid window."""
    tilted = with_tilt(tris)
    window = settle(roi_window(tilted, roi, largest=largest), "roi")
    inside = F.col("cw").between(F.col("w_lo"), F.col("w_hi")) & F.col("cd").between(F.col("d_lo"), F.col("d_hi"))
    return (
        attach(tilted, window.with_hot("n"), spread=["fid"])
        .withColumn("is_tread", (F.col("tilt") < angle_deg) & inside)
        .drop("w_lo", "w_hi", "d_lo", "d_hi", "n")
    )


def tread_summary(segmented: DataFrame) -> DataFrame:
    tread = F.count_if("is_tread")
    return segmented.groupBy("mesh_id").agg(
        tread.alias("tread_count"),
        (F.count(F.lit(1)) - tread).alias("excluded_count"),
        (1.0 - tread / F.count(F.lit(1))).alias("excluded_fraction"),
    )


def prepare(mesh: Mesh, axes: tuple[int, int, int] | None = None) -> tuple[Mesh, DataFrame, KeyTable]:
    """Write the gathered triangles once and derive the frame: (mesh, triangles, frame)."""
    tris = materialize(triangles(mesh), "triangles")
    box = bounds(mesh.vertices)
    roles = axis_roles(box, tris) if axes is None else given_roles(box, *axes)
    return mesh, tris, frame(roles)
