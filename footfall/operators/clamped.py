"""Sums of max(0, height difference) over many planes at once.

Evaluating every plane at every triangle is a product of two large inputs. The planes of
a mesh are close together, so interval bounds settle most rows for all planes in one
pass: rows below every plane are linear in the plane and collapse to a few sums, rows
above every plane add nothing. Only rows that some planes cut are evaluated per plane,
in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import geometry as G
from footfall.operators.keyed import BLOCK, KeyTable, attach, block_count, settle
from footfall.session import materialize

CHUNK = 2048
BOX = ("a", "b", "c", "s")


def centred_planes(params: DataFrame, frame_table: KeyTable) -> DataFrame:
    """params(mesh_id, pid, a, b, c, s) for height a w + b d + c - s u, moved to the mesh centre."""
    mid = frame_table.df.select("mesh_id", *[
        ((F.col(f"{x}_min") + F.col(f"{x}_max")) / 2.0).alias(f"m{x}") for x in ("w", "d", "u")
    ])
    moved = F.col("c") + F.col("a") * F.col("mw") + F.col("b") * F.col("md") - F.col("s") * F.col("mu")
    return attach(params, frame_table.of(mid), spread=["pid"]).withColumn("c", moved).select(
        "mesh_id", "pid", "a", "b", "c", "s"
    )


def plane_box(planes: DataFrame, frame_table: KeyTable) -> KeyTable:
    """Middle and half-range of the planes of each mesh, with the mesh centre."""
    parts = []
    for p in BOX:
        lo, hi = F.min(p), F.max(p)
        parts += [((lo + hi) / 2.0).alias(f"{p}0"), ((hi - lo) / 2.0).alias(f"r{p}")]
    mid = frame_table.df.select("mesh_id", *[
        ((F.col(f"{x}_min") + F.col(f"{x}_max")) / 2.0).alias(f"m{x}") for x in ("w", "d", "u")
    ])
    return settle(planes.groupBy("mesh_id").agg(*parts).join(mid, "mesh_id"), "box", frame_table)


def _bounds(w: Column, d: Column, u: Column) -> tuple[Column, Column]:
    """Height difference at the middle plane and a safe radius over all planes."""
    mid = F.col("a0") * w + F.col("b0") * d + F.col("c0") - F.col("s0") * u
    radius = F.col("ra") * F.abs(w) + F.col("rb") * F.abs(d) + F.col("rc") + F.col("rs") * F.abs(u)
    slack = 1e-12 * (F.abs(F.col("c0")) + F.abs(F.col("s0") * u) + F.abs(F.col("a0") * w) + F.abs(F.col("b0") * d))
    return mid, radius * (1 + 1e-12) + slack


def _evaluate(rows: DataFrame, id_col: str, planes: DataFrame, score, out: str, size: int) -> DataFrame:
    """Run ``score(key, rows, planes)`` for bounded blocks of rows against the mesh's planes."""
    rows = materialize(rows, "cut")
    counts = settle(rows.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")), "cutn").with_hot("n")
    numbered = attach(rows, counts, spread=[id_col]).withColumn(
        "block", F.pmod(F.xxhash64(id_col), block_count(size=size))
    ).drop("n")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), block_count(size=size) - 1))
    copies = attach(planes, counts, spread=["pid"]).select(*planes.columns, blocks.alias("block"))
    return numbered.groupBy("mesh_id", "block").cogroup(copies.groupBy("mesh_id", "block")).applyInPandas(score, out)


def volume_by_plane(tread: DataFrame, params: DataFrame, frame_table: KeyTable, size: int = BLOCK) -> DataFrame:
    """Wear volume, max and mean depth of the tread for every plane: (mesh_id, pid, volume, max_depth, mean_depth)."""
    planes = materialize(centred_planes(params, frame_table), "planes")
    box = plane_box(planes, frame_table)
    corners = []
    rows = attach(tread, box, spread=["fid"])
    rows = rows.withColumns({"area": G.flat_area()})
    rows = rows.withColumns({
        f"{x}{k}": F.col(f"{x}{k}") - F.col(f"m{x}") for x in ("w", "d", "u") for k in range(3)
    })
    for k in range(3):
        mid, radius = _bounds(F.col(f"w{k}"), F.col(f"d{k}"), F.col(f"u{k}"))
        rows = rows.withColumns({f"e{k}": mid, f"lo{k}": mid - radius, f"hi{k}": mid + radius})
        corners.append(k)
    settled = F.lit(True)
    for k in corners:
        settled = settled & ((F.col(f"lo{k}") > 0) | (F.col(f"hi{k}") < 0))
    rows = rows.withColumn("settled", settled)

    def over_corners(weight: Column, value) -> Column:
        terms = [F.when(F.col("settled") & (F.col(f"lo{k}") > 0), weight * value(k)).otherwise(F.lit(0.0)) for k in corners]
        return F.sum(terms[0] + terms[1] + terms[2])

    sums = []
    for tag, weight in (("v", F.col("area") / 3.0), ("t", F.lit(1.0 / 3.0))):
        sums += [
            over_corners(weight, lambda k: F.col(f"e{k}")).alias(f"{tag}e"),
            over_corners(weight, lambda k: F.col(f"w{k}")).alias(f"{tag}w"),
            over_corners(weight, lambda k: F.col(f"d{k}")).alias(f"{tag}d"),
            over_corners(weight, lambda k: F.lit(1.0)).alias(f"{tag}1"),
        ]
    top_lo, top_hi = F.greatest("lo0", "lo1", "lo2"), F.greatest("hi0", "hi1", "hi2")
    linear = settle(
        rows.groupBy("mesh_id").agg(
            *sums, F.count_if(F.col("settled") & (top_lo > 0)).alias("cnt"),
            F.greatest(F.lit(0.0), F.max(top_lo)).alias("floor"),
        ),
        "linear", frame_table,
    )
    # A triangle can hold the maximum only if its upper bound reaches the best lower bound.
    floor = linear.of(linear.df.select("mesh_id", "floor"))
    cut = attach(rows, floor, spread=["fid"]).where(~F.col("settled") | (top_hi >= F.col("floor"))).select(
        "mesh_id", "fid", "settled", "area", *[f"{x}{k}" for k in range(3) for x in ("w", "d", "u")]
    )

    def score(key: tuple[Any, ...], tri: pd.DataFrame, pl: pd.DataFrame) -> pd.DataFrame:
        n = len(pl)
        vol, dep, top, cnt = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, dtype="int64")
        a, b, c = (pl[p].to_numpy()[:, None] for p in ("a", "b", "c"))
        for at in range(0, len(tri), CHUNK):
            part = tri.iloc[at:at + CHUNK]
            depth = np.stack([
                np.maximum(a * part[f"w{k}"].to_numpy() + b * part[f"d{k}"].to_numpy() + c - part[f"u{k}"].to_numpy(), 0.0)
                for k in range(3)
            ])
            if depth.size:
                top = np.maximum(top, depth.max(axis=(0, 2)))
            mean = (depth[0] + depth[1] + depth[2])[:, ~part["settled"].to_numpy(dtype=bool)] / 3.0
            vol += mean @ part.loc[~part["settled"].astype(bool), "area"].to_numpy()
            dep += mean.sum(axis=1)
            cnt += (mean > 0).sum(axis=1)
        return pd.DataFrame({
            "mesh_id": pd.Series([key[0]] * n, dtype=object), "pid": pl["pid"].to_numpy(dtype="int64"),
            "vol": vol, "dep": dep, "top": top, "cnt2": cnt,
        })

    direct = _evaluate(
        cut, "fid", planes, score, "mesh_id string, pid long, vol double, dep double, top double, cnt2 long", size
    ).groupBy("mesh_id", "pid").agg(
        F.sum("vol").alias("vol"), F.sum("dep").alias("dep"), F.max("top").alias("top"), F.sum("cnt2").alias("cnt2")
    )
    shift = box.df.select("mesh_id", "a0", "b0", "c0").join(linear.df, "mesh_id", "left").fillna(0)
    joined = attach(planes, box.of(shift), spread=["pid"]).join(direct, ["mesh_id", "pid"], "left").fillna(0)

    def at_plane(tag: str) -> Column:
        return (
            F.col(f"{tag}e") + (F.col("a") - F.col("a0")) * F.col(f"{tag}w")
            + (F.col("b") - F.col("b0")) * F.col(f"{tag}d") + (F.col("c") - F.col("c0")) * F.col(f"{tag}1")
        )

    worn = F.col("cnt") + F.col("cnt2")
    return joined.select(
        "mesh_id", "pid", (at_plane("v") + F.col("vol")).alias("volume"), (F.col("top") * 1000.0).alias("max_depth"),
        F.when(worn > 0, F.try_divide(at_plane("t") + F.col("dep"), worn) * 1000.0).otherwise(F.lit(0.0)).alias("mean_depth"),
    )


def nosing_by_plane(points: DataFrame, params: DataFrame, frame_table: KeyTable, size: int = BLOCK) -> DataFrame:
    """Mean clamped depth of the front quarter and the centre half: (mesh_id, pid, front, centre, n_front, n_centre)."""
    planes = materialize(centred_planes(params, frame_table), "planes")
    box = plane_box(planes, frame_table)
    edges = frame_table.df.select("mesh_id", "d_min", "d_max").join(box.df, "mesh_id")
    rows = attach(points, box.of(edges), spread=["vid"])
    reach = F.col("d_max") - F.col("d_min")
    front = F.col("d") < F.col("d_min") + 0.25 * reach
    centre = F.col("d").between(F.col("d_min") + 0.25 * reach, F.col("d_max") - 0.25 * reach)
    rows = rows.withColumn("zone", F.when(front, 0).when(centre, 1)).where(F.col("zone").isNotNull())
    rows = rows.withColumns({x: F.col(x) - F.col(f"m{x}") for x in ("w", "d", "u")})
    mid, radius = _bounds(F.col("w"), F.col("d"), F.col("u"))
    rows = rows.withColumns({"e": mid, "lo": mid - radius, "hi": mid + radius})
    sums = []
    for z, tag in ((0, "f"), (1, "m")):
        here = F.col("zone") == z
        sure = here & (F.col("lo") > 0)
        sums.append(F.count_if(here).alias(f"{tag}n"))
        for name, value in (("e", F.col("e")), ("w", F.col("w")), ("d", F.col("d")), ("u", F.col("u")), ("1", F.lit(1.0))):
            sums.append(F.sum(F.when(sure, value).otherwise(F.lit(0.0))).alias(f"{tag}{name}"))
    linear = settle(rows.groupBy("mesh_id").agg(*sums), "nosing")
    cut = rows.where((F.col("lo") <= 0) & (F.col("hi") >= 0)).select("mesh_id", "vid", "zone", "w", "d", "u")

    def score(key: tuple[Any, ...], pts: pd.DataFrame, pl: pd.DataFrame) -> pd.DataFrame:
        n = len(pl)
        total = np.zeros((2, n))
        a, b, c, s = (pl[p].to_numpy()[:, None] for p in BOX)
        for z in (0, 1):
            zone = pts[pts["zone"] == z]
            for at in range(0, len(zone), CHUNK):
                w, d, u = zone[["w", "d", "u"]].to_numpy()[at:at + CHUNK].T
                total[z] += np.maximum(a * w + b * d + c - s * u, 0.0).sum(axis=1)
        return pd.DataFrame({
            "mesh_id": pd.Series([key[0]] * n, dtype=object), "pid": pl["pid"].to_numpy(dtype="int64"),
            "f2": total[0], "m2": total[1],
        })

    direct = _evaluate(cut, "vid", planes, score, "mesh_id string, pid long, f2 double, m2 double", size).groupBy(
        "mesh_id", "pid"
    ).agg(F.sum("f2").alias("f2"), F.sum("m2").alias("m2"))
    shift = box.df.select("mesh_id", "a0", "b0", "c0", "s0").join(linear.df, "mesh_id", "left").fillna(0)
    joined = attach(planes, box.of(shift), spread=["pid"]).join(direct, ["mesh_id", "pid"], "left").fillna(0)

    def mean(tag: str) -> Column:
        total = (
            F.col(f"{tag}e") + (F.col("a") - F.col("a0")) * F.col(f"{tag}w") + (F.col("b") - F.col("b0")) * F.col(f"{tag}d")
            + (F.col("c") - F.col("c0")) * F.col(f"{tag}1") - (F.col("s") - F.col("s0")) * F.col(f"{tag}u") + F.col(f"{tag}2")
        )
        return F.try_divide(total, F.col(f"{tag}n"))

    return joined.select(
        "mesh_id", "pid", mean("f").alias("front"), mean("m").alias("centre"),
        F.col("fn").alias("n_front"), F.col("mn").alias("n_centre"),
    )


def nosing_ratio(front: Column, centre: Column, compat: bool = True) -> Column:
    """Front over centre wear. No front points: 0; no centre points: divide by 1e-10.

    A centre without wear gives infinity or NaN as plain division does; without
    ``compat`` it gives null.
    """
    top = F.coalesce(front, F.lit(0.0))
    bottom = F.coalesce(centre, F.lit(1e-10))
    none = F.lit(None).cast("double")
    if compat:
        none = F.when(top > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(bottom == 0, none).otherwise(F.try_divide(top, bottom))
