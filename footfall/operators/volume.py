"""Wear volume by triangle integration over one plane per mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions import geometry as G
from footfall.operators.keyed import KeyTable, attach


def corner_depths(tris: DataFrame) -> DataFrame:
    """Triangles joined to plane columns a, b, c: corner depths, their mean, and flat area."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    out = tris.withColumns({
        f"dep{k}": G.depth(G.plane_height(a, b, c, F.col(f"w{k}"), F.col(f"d{k}")), F.col(f"u{k}"))
        for k in range(3)
    })
    return out.withColumns({
        "mean_dep": (F.col("dep0") + F.col("dep1") + F.col("dep2")) / 3.0,
        "area": G.flat_area(),
    })


def wear_volume(tread: DataFrame, plane: KeyTable) -> DataFrame:
    """Per mesh: volume (m3), max_depth and mean_depth (mm), triangles_used.

    ``tread`` holds tread triangles only; meshes without any get zeros.
    """
    planes = plane.of(plane.df.select("mesh_id", "a", "b", "c"))
    worn = F.when(F.col("mean_dep") > 0, F.col("mean_dep"))
    summed = corner_depths(attach(tread, planes, spread=["fid"])).groupBy("mesh_id").agg(
        F.sum(F.col("mean_dep") * F.col("area")).alias("volume"),
        (F.max(F.greatest("dep0", "dep1", "dep2")) * 1000.0).alias("max_depth"),
        (F.avg(worn) * 1000.0).alias("mean_depth"),
        F.count(F.lit(1)).alias("triangles_used"),
    )
    filled = {c: 0.0 for c in ("volume", "max_depth", "mean_depth")} | {"triangles_used": 0}
    return planes.df.select("mesh_id").join(summed, "mesh_id", "left").fillna(filled)
