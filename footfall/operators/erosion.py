"""Wear by feet and by weather told apart, and the test of a single Gaussian track.

Both read sums by mesh and grid column; the grid itself is only read once, map-side combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import constants as K
from footfall.operators.flight import trend
from footfall.operators.grid import node
from footfall.operators.keyed import KeyTable, attach, settle

ONE_SIDED_95 = 1.6448536269514722  # 95th percentile of the normal distribution


def column_depths(cells: DataFrame, extents: KeyTable, g: int = K.GRID) -> DataFrame:
    """Mean depth of each grid column, nodes without wear counting zero: (mesh_id, j, x, depth_mm)."""
    sums = cells.groupBy("mesh_id", "j").agg(F.sum("depth_mm").alias("_s"))
    line = extents.df.select("mesh_id", "w_min", "w_max", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("j"))
    return line.join(sums, ["mesh_id", "j"], "left").select(
        "mesh_id", "j", node(F.col("w_min"), F.col("w_max"), F.col("j"), g).alias("x"), (F.coalesce("_s", F.lit(0.0)) / g).alias("depth_mm"))


def _at_edge(g: int) -> Column:
    """Columns beside the walls, where nobody walks."""
    margin = int(g * K.BORDER)
    return (F.col("j") < margin) | (F.col("j") >= g - margin)


def coupled_erosion(cells: DataFrame, extents: KeyTable, g: int = K.GRID) -> DataFrame:
    """Weathering and traffic of each mesh: an edge baseline, what is above it, and a joint estimate.

    ``baseline_mm``: mean depth of the edge columns. ``mechanical_share``: part of the worn volume above it.
    ``centre`` and ``spread``: mean and standard deviation of the column depths above the baseline.
    ``weathering_mm`` and ``traffic_mm``: least squares, neither below zero, of the column depths on a constant
    and on a Gaussian of that centre and spread (1 at its top); ``explained``: the part of their variation it explains.
    A mesh with nothing above its baseline has no track (null centre and spread): all its wear is weathering.
    """
    lines = settle(column_depths(cells, extents, g), "columns").df
    base = settle(lines.groupBy("mesh_id").agg(F.avg(F.when(_at_edge(g), F.col("depth_mm"))).alias("baseline_mm"), F.avg("depth_mm").alias("mean_mm")), "baseline", extents)
    own = base.of(base.df.select("mesh_id", "baseline_mm"))
    above = F.greatest(F.lit(0.0), F.col("depth_mm") - F.col("baseline_mm"))
    worn = attach(cells.select("mesh_id", "depth_mm"), own, spread=["depth_mm"]).groupBy("mesh_id").agg(
        F.sum(above).alias("_above"), F.sum("depth_mm").alias("_all"))
    at = lines.join(base.df, "mesh_id").withColumn("above", above)
    centre = at.groupBy("mesh_id").agg((F.try_divide(F.sum(F.col("above") * F.col("x")), F.sum("above"))).alias("centre"))
    off = F.col("x") - F.col("centre")
    spread = at.join(centre, "mesh_id").groupBy("mesh_id").agg(
        F.first("centre").alias("centre"), F.sqrt(F.try_divide(F.sum(F.col("above") * off * off), F.sum("above"))).alias("spread"))
    shape = F.when(F.col("spread") > 0, F.exp(-off * off / (2 * F.col("spread") * F.col("spread"))))
    fitted = lines.join(spread, "mesh_id").withColumn("g", F.coalesce(shape, F.lit(0.0))).groupBy("mesh_id").agg(
        F.first("centre").alias("centre"), F.first("spread").alias("spread"), F.count(F.lit(1)).alias("n"), F.avg("g").alias("mg"), F.avg("depth_mm").alias("my"),
        F.sum(F.col("g") * F.col("g")).alias("gg"), F.sum(F.col("g") * F.col("depth_mm")).alias("gy"), F.sum(F.col("depth_mm") * F.col("depth_mm")).alias("yy"))
    n, mg, my = F.col("n"), F.col("mg"), F.col("my")
    slope = F.try_divide(F.col("gy") - n * mg * my, F.col("gg") - n * mg * mg)
    alone = F.try_divide(F.col("gy"), F.col("gg"))  # through zero, where the constant would be negative
    track = F.coalesce(F.when(slope <= 0, F.lit(0.0)).when(my - slope * mg < 0, alone).otherwise(slope), F.lit(0.0))
    fitted = fitted.withColumn("traffic_mm", track).withColumn("weathering_mm", F.greatest(F.lit(0.0), my - F.col("traffic_mm") * mg))
    e0, e1 = F.col("weathering_mm"), F.col("traffic_mm")
    left = F.col("yy") - 2 * e0 * n * my - 2 * e1 * F.col("gy") + e0 * e0 * n + 2 * e0 * e1 * n * mg + e1 * e1 * F.col("gg")
    whole = F.col("yy") - n * my * my
    explained = F.when(whole > 1e-12 * F.col("yy"), 1 - left / whole)
    return base.df.join(fitted, "mesh_id").join(worn, "mesh_id", "left").select(
        "mesh_id", "baseline_mm", F.coalesce(F.try_divide(F.col("_above"), F.col("_all")), F.lit(0.0)).alias("mechanical_share"),
        "centre", "spread", "weathering_mm", "traffic_mm", explained.alias("explained"))


def log_profile(cells: DataFrame) -> DataFrame:
    """Whether the logarithm of the lateral wear profile is a parabola, as a single Gaussian track's is.

    The parabola is fitted to the columns' mean log depths (``depth_mm`` > 0), weighted by their cells. What it leaves
    between columns is compared with the scatter within columns (the saturated model) by an F ratio, turned into a
    normal ``score`` by cube roots (Paulson). Columns: n_columns, n_cells, centre and spread (null unless the parabola opens
    downward), lack (mean square between), pure (mean square within), score and verdict: SINGLE TRACK, NOT GAUSSIAN
    (score above the one-sided 95 %), NO TRACK (not opening downward), UNKNOWN (no degree of freedom in either, or no
    scatter within columns). Meshes without worn cells have no row.
    """
    worn = cells.where("depth_mm > 0").withColumn("_y", F.ln("depth_mm"))
    columns = worn.groupBy("mesh_id", "j").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y"), (F.var_pop("_y") * F.count(F.lit(1))).alias("within"))
    columns = settle(columns, "log-columns").df
    fit = trend(columns, ["mesh_id"], "x", "y", "n").withColumnsRenamed({"n": "n_columns"})
    whole = columns.groupBy("mesh_id").agg(F.sum("n").alias("n_cells"), F.sum("within").alias("within"))
    rows = fit.join(whole, "mesh_id")
    d1, d2 = F.col("n_columns") - F.col("rank"), F.col("n_cells") - F.col("n_columns")
    rows = rows.withColumns({"lack": F.when(d1 > 0, F.col("sse") / d1), "pure": F.when(d2 > 0, F.col("within") / d2)})
    ratio = F.cbrt(F.when(F.col("pure") > 0, F.col("lack") / F.col("pure")))
    a, b = 2.0 / (9.0 * d1), 2.0 / (9.0 * d2)
    rows = rows.withColumn("score", ((1 - b) * ratio - (1 - a)) / F.sqrt(b * ratio * ratio + a))
    down = (F.col("rank") == 3) & (F.col("b2") < 0)
    verdict = F.when(F.col("score").isNull(), "UNKNOWN").when(~down, "NO TRACK").when(F.col("score") > ONE_SIDED_95, "NOT GAUSSIAN").otherwise("SINGLE TRACK")
    top = F.col("x_mean") - (F.col("b1") - F.col("b2") * F.col("m1")) / (2 * F.col("b2"))
    return rows.select(
        "mesh_id", "n_columns", "n_cells", F.when(down, top).alias("centre"), F.when(down, F.sqrt(-0.5 / F.col("b2"))).alias("spread"),
        "lack", "pure", "score", verdict.alias("verdict"))
