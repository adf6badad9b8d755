"""Depth grids in sparse long form, and the profiles summed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import constants as K
from footfall.functions import geometry as G
from footfall.operators.keyed import KeyTable, attach, settle
from footfall.operators.quantiles import exact_quantiles
from footfall.session import materialize

TASK_POINTS = 1 << 18  # points of sparse meshes that one task takes, about


def node(lo: Column, hi: Column, index: Column, g: int) -> Column:
    """Position of one of g evenly spaced nodes; the last node is exactly ``hi``."""
    step = (hi - lo) / F.lit(float(g - 1))
    return F.when(index == g - 1, hi).otherwise(lo + index * step)


def _near_nodes(points: DataFrame, axis: str, index: str, g: int) -> DataFrame:
    """Rows repeated for each node of one axis closer than range/g (strict).

    Nodes are range/(g-1) apart, so only the two nodes around a point can qualify.
    """
    lo, hi = F.col(f"{axis}_min"), F.col(f"{axis}_max")
    below = F.floor(F.try_divide((F.col(axis) - lo) * F.lit(float(g - 1)), hi - lo)).cast("int")
    near = points.withColumn(index, F.explode(F.array(below, below + 1)))
    close = F.abs(F.col(axis) - node(lo, hi, F.col(index), g)) < (hi - lo) / F.lit(float(g))
    return near.where(F.col(index).between(0, g - 1) & close)


def surface_heights(points: DataFrame, extents: KeyTable, g: int, spread: Sequence[str] = ("w", "d")) -> DataFrame:
    """Highest point near each grid node: (mesh_id, i, j, u_top); nodes without points are absent.

    ``extents`` has w_min, w_max, d_min, d_max. i runs along depth, j along width.

    A point is near about four nodes. Meshes known to have more points than the grid has nodes are
    combined before the shuffle. In others hardly two points share a node: there the points are
    shuffled by mesh, before they are repeated, and nothing is shuffled after that.
    """
    box = extents.of(extents.df.select("mesh_id", "w_min", "w_max", "d_min", "d_max"))
    points = points.select("mesh_id", "w", "d", "u")

    def highest(rows: DataFrame) -> DataFrame:
        near = _near_nodes(_near_nodes(attach(rows, box, spread=list(spread)), "w", "j", g), "d", "i", g)
        return near.groupBy("mesh_id", "i", "j").agg(F.max("u").alias("u_top"))

    def by_mesh(rows: DataFrame, vertices: int) -> DataFrame:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        return highest(rows.repartition(max(cores, -(-vertices // TASK_POINTS)), "mesh_id"))

    if not {"most_vertices", "vertices"} <= extents.seen.keys() or "n_vertices" not in extents.df.columns:
        return highest(points)
    if (extents.seen["most_vertices"] or 0) <= g * g:
        return by_mesh(points, extents.seen["vertices"] or 0)
    full = settle(extents.df.where(F.col("n_vertices") > g * g).select("mesh_id", "n_vertices"), "full", vertices=F.sum("n_vertices"))
    if full.rows == extents.rows:
        return highest(points)
    names = full.of(full.df.select("mesh_id"))
    sparse = by_mesh(attach(points, names, how="left_anti", spread=list(spread)), extents.seen["vertices"] - full.seen["vertices"])
    return sparse.unionByName(highest(attach(points, names, how="left_semi", spread=list(spread))))


def depth_cells(points: DataFrame, extents: KeyTable, plane: KeyTable, g: int = K.GRID) -> DataFrame:
    """Wear depth below the plane at grid nodes: (mesh_id, i, j, y, x, depth_mm), positive cells only."""
    setting = extents.of(
        extents.df.select("mesh_id", "w_min", "w_max", "d_min", "d_max").join(
            plane.df.select("mesh_id", "a", "b", "c"), "mesh_id"
        )
    )
    cells = attach(surface_heights(points, extents, g), setting, spread=["i", "j"])
    x = node(F.col("w_min"), F.col("w_max"), F.col("j"), g)
    y = node(F.col("d_min"), F.col("d_max"), F.col("i"), g)
    deep = G.depth(G.plane_height(F.col("a"), F.col("b"), F.col("c"), x, y), F.col("u_top")) * 1000.0
    return cells.select("mesh_id", "i", "j", y.alias("y"), x.alias("x"), deep.alias("depth_mm")).where("depth_mm > 0")


def legacy_reference(points: DataFrame, extents: KeyTable) -> DataFrame:
    """Unworn height per mesh: 95th percentile of the outer width strips, else the top height."""
    box = extents.of(extents.df.select("mesh_id", "w_min", "w_max"))
    lo, hi = F.col("w_min"), F.col("w_max")
    margin = F.lit(K.BORDER) * (hi - lo)
    edge = attach(points, box, spread=["w", "d"]).where((F.col("w") < lo + margin) | (F.col("w") > hi - margin))
    largest = extents.seen.get("most_vertices")
    height = exact_quantiles(edge, "u", [K.LEGACY_EDGE_QUANTILE], largest=largest).select("mesh_id", F.col("q")[0].alias("q95"))
    return extents.df.select("mesh_id", "u_max").join(height, "mesh_id", "left").select(
        "mesh_id", F.coalesce("q95", "u_max").alias("reference_height")
    )


def legacy_cells(points: DataFrame, extents: KeyTable, g: int = K.GRID) -> tuple[DataFrame, KeyTable]:
    """Level-reference depth grid: sparse cells and the reference heights."""
    ref = settle(legacy_reference(points, extents), "legacy")
    setting = extents.of(extents.df.select("mesh_id", "w_min", "w_max", "d_min", "d_max").join(ref.df, "mesh_id"))
    cells = attach(surface_heights(points, extents, g), setting, spread=["i", "j"])
    deep = F.greatest(F.lit(0.0), F.col("reference_height") - F.col("u_top"))
    out = cells.select(
        "mesh_id", "i", "j", node(F.col("d_min"), F.col("d_max"), F.col("i"), g).alias("y"),
        node(F.col("w_min"), F.col("w_max"), F.col("j"), g).alias("x"), (deep * 1000.0).alias("depth_mm"),
    )
    return out.where("depth_mm > 0"), ref


def legacy_volume(cells: DataFrame, extents: KeyTable, g: int = K.GRID) -> DataFrame:
    """Per mesh: volume (m3) as cell sums, max_depth and mean_depth (mm) of worn cells."""
    sums = cells.groupBy("mesh_id").agg(
        F.sum(F.col("depth_mm") / 1000.0).alias("depth_sum"), F.max("depth_mm").alias("max_depth"),
        F.avg("depth_mm").alias("mean_depth"),
    )
    cell = ((F.col("w_max") - F.col("w_min")) / (g - 1)) * ((F.col("d_max") - F.col("d_min")) / (g - 1))
    return extents.df.join(sums, "mesh_id", "left").select(
        "mesh_id", (F.coalesce("depth_sum", F.lit(0.0)) * cell).alias("volume"),
        F.coalesce("max_depth", F.lit(0.0)).alias("max_depth"), F.coalesce("mean_depth", F.lit(0.0)).alias("mean_depth"),
    )


def dense_grid(cells: DataFrame, extents: KeyTable, g: int = K.GRID) -> DataFrame:
    """All g x g nodes of every mesh, 0 where nothing is worn."""
    axis = F.sequence(F.lit(0), F.lit(g - 1))
    nodes = (
        extents.df.select("mesh_id", "w_min", "w_max", "d_min", "d_max", F.explode(axis).alias("i"))
        .select("*", F.explode(axis).alias("j"))
        .select(
            "mesh_id", "i", "j", node(F.col("d_min"), F.col("d_max"), F.col("i"), g).alias("y"),
            node(F.col("w_min"), F.col("w_max"), F.col("j"), g).alias("x"),
        )
    )
    return nodes.join(cells.select("mesh_id", "i", "j", "depth_mm"), ["mesh_id", "i", "j"], "left").fillna(0.0, ["depth_mm"])


def _dense_line(sums: DataFrame, extents: KeyTable, index: str, axis: str, g: int) -> DataFrame:
    """One row per mesh and node of one axis with its summed depth (0 where absent) and the mesh's ``total`` (null without sums).

    A mesh's sums, one per node at most, travel as one row.
    """
    lo, hi = f"{axis}_min", f"{axis}_max"
    packed = sums.groupBy("mesh_id").agg(F.sum("value").alias("total"), F.map_from_entries(F.collect_list(F.struct(index, "value"))).alias("_sums"))
    line = extents.df.select("mesh_id", lo, hi).join(packed, "mesh_id", "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias(index))
    return line.select(
        "mesh_id", index, node(F.col(lo), F.col(hi), F.col(index), g).alias("pos"),
        F.coalesce(F.try_element_at("_sums", F.col(index)), F.lit(0.0)).alias("value"), "total",
    )


def lateral_profile(cells: DataFrame, extents: KeyTable, g: int = K.GRID) -> DataFrame:
    """Column sums as shares of the total: (mesh_id, j, x, share, weight).

    ``weight`` is the whole number of replicates the share stands for, rounded down. Depths
    are summed as whole nanometres, so that no order of summation can change it. A mesh
    without wear keeps zero shares.
    """
    nanometres = F.round(F.col("depth_mm") * 1e6).cast("long")
    sums = materialize(cells.groupBy("mesh_id", "j").agg(F.sum(nanometres).alias("value")), "lateral-sums")
    line = _dense_line(sums, extents, "j", "w", g)
    share = F.coalesce(F.try_divide(F.col("value"), F.col("total")), F.lit(0.0))
    return line.select(
        "mesh_id", "j", F.col("pos").alias("x"), share.alias("share"),
        F.when(F.col("total") > 0, F.expr(f"cast(value as bigint) * {K.LATERAL_REPLICATES} div total")).otherwise(0).cast("long").alias("weight"),
    )


def lateral_moments(profile: DataFrame) -> DataFrame:
    """Weighted population skewness and excess kurtosis of positions, sample count, nominal width."""
    mean = profile.groupBy("mesh_id").agg(
        F.sum("weight").alias("n_samples"),
        F.try_divide(F.sum(F.col("weight") * F.col("x")), F.sum("weight")).alias("mean"),
        (F.max("x") - F.min("x")).alias("w_nom"), F.max(F.col("share") > 0).alias("worn"),
    )
    off = F.col("x") - F.col("mean")
    powers = profile.join(mean, "mesh_id").groupBy("mesh_id").agg(
        F.first("n_samples").alias("n_samples"), F.first("w_nom").alias("w_nom"), F.first("worn").alias("worn"),
        *[F.try_divide(F.sum(F.col("weight") * off ** k), F.sum("weight")).alias(f"m{k}") for k in (2, 3, 4)],
    )
    return powers.select(
        "mesh_id", "n_samples", "w_nom", "worn",
        F.try_divide(F.col("m3"), F.col("m2") * F.sqrt("m2")).alias("skewness"),
        (F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")) - 3.0).alias("kurtosis"),
    )


def longitudinal_profile(cells: DataFrame, extents: KeyTable, g: int = K.GRID) -> DataFrame:
    """Row sums along depth: (mesh_id, i, y, value)."""
    sums = cells.groupBy("mesh_id", "i").agg(F.sum("depth_mm").alias("value"))
    return _dense_line(sums, extents, "i", "d", g).withColumnRenamed("pos", "y").drop("total")


def longitudinal_regions(profile: DataFrame, g: int = K.GRID, flip_depth: bool = False) -> DataFrame:
    """Front / centre / back means (quarters by index), nosing ratio, skewness of the values.

    Low depth is taken as the front edge; ``flip_depth`` swaps the ends.
    """
    q1, q3 = g // 4, 3 * g // 4
    at = (F.lit(g - 1) - F.col("i")) if flip_depth else F.col("i")

    def mean_of(inside: Column) -> Column:
        return F.coalesce(F.avg(F.when(inside, F.col("value"))), F.lit(0.0))

    out = profile.groupBy("mesh_id").agg(
        mean_of(at < q1).alias("nosing_wear"), mean_of((at >= q1) & (at < q3)).alias("center_wear"),
        mean_of(at >= q3).alias("back_wear"), F.skewness("value").alias("skewness"),
    )
    ratio = F.when(F.col("center_wear") > 0, F.try_divide(F.col("nosing_wear"), F.col("center_wear"))).otherwise(F.lit(0.0))
    return out.withColumn("nosing_wear_ratio", ratio)


def temporal_drift(
    cells: DataFrame,
    widths: DataFrame,
    shy: float = K.SHY_M,
    quantiles: Sequence[float] = K.DRIFT_QUANTILES,
    g: int | None = None,
) -> DataFrame:
    """Whether the centre of mass moves sideways with depth: (mesh_id, peak_0.., shift_ratio, drift).

    ``widths`` gives mesh_id, w_nom (null reads as 1 m). ``g``, if known, bounds a mesh's cells.
    """
    names = [f"t{k}" for k in range(len(quantiles))]
    found = exact_quantiles(cells, "depth_mm", quantiles, largest=g and g * g).where(F.col("n") >= K.DRIFT_MIN_CELLS)
    limits = settle(found.select("mesh_id", *[F.col("q")[k].alias(n) for k, n in enumerate(names)]), "drift")
    masked = attach(cells, limits, spread=["i", "j"])
    peaks = []
    for k, n in enumerate(names):
        deep = F.col("depth_mm") >= F.col(n)
        weight = F.sum(F.when(deep, F.col("depth_mm")))
        centre = F.try_divide(F.sum(F.when(deep, F.col("x") * F.col("depth_mm"))), weight)
        peaks.append(F.when(F.count_if(deep) >= K.DRIFT_MIN_MASKED, centre).alias(f"peak_{k}"))
    found = masked.groupBy("mesh_id").agg(*peaks)
    all_peaks = F.array_compact(F.array(*[f"peak_{k}" for k in range(len(quantiles))]))
    w_eff = F.coalesce("w_nom", F.lit(1.0)) - 2 * shy
    joined = widths.select("mesh_id", "w_nom").join(found, "mesh_id", "left").withColumn("_w", w_eff)
    shift = F.when(
        F.size(all_peaks) >= 2,
        F.when(F.col("_w") > 0, F.try_divide(F.array_max(all_peaks) - F.array_min(all_peaks), F.col("_w"))).otherwise(F.lit(0.0)),
    )
    return joined.withColumn("shift_ratio", shift).select(
        "mesh_id", *[f"peak_{k}" for k in range(len(quantiles))], "shift_ratio",
        F.coalesce(F.col("shift_ratio") > K.DRIFT_SHIFT, F.lit(False)).alias("drift"),
    )
