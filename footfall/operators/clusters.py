"""Steps told apart by the moments of their wear: weighted moments, K-means, and who stands out.

Rows stay distributed; the driver holds the centres of one round (``k`` rows) and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.operators.keyed import attach, settle
from footfall.session import materialize

MOMENTS = ("mean", "spread", "skewness", "kurtosis")


def profile_moments(rows: DataFrame, keys: Sequence[str], x: str, weight: str) -> DataFrame:
    """Per key: number of places, mean, spread (standard deviation), skewness and kurtosis of ``x`` weighted by ``weight``.

    Null or non-positive weights count nothing. Without spread, skewness and kurtosis are null; without weight, all are.
    """
    keys = list(keys)
    w = F.when(F.col(weight) > 0, F.col(weight).cast("double"))
    used = rows.select(*keys, F.when(w.isNotNull(), F.col(x).cast("double")).alias("_x"), F.when(F.col(x).isNotNull(), w).alias("_w"))
    base = used.groupBy(*keys).agg(F.count("_w").alias("n"), F.count(F.lit(1)).alias("_n"), (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mean"))
    base = settle(base, "moments").with_hot("_n", keys)
    away = attach(used, base.of(base.df.select(*keys, "mean")), keys, spread=["_x", "_w"]).withColumn("_d", F.col("_x") - F.col("mean"))
    d = F.col("_d")
    central = away.groupBy(*keys).agg(*[(F.sum(F.col("_w") * p) / F.sum("_w")).alias(f"_m{k}") for k, p in ((2, d * d), (3, d * d * d), (4, d * d * d * d))])
    m2 = F.when(F.col("_m2") > 0, F.col("_m2"))
    return base.df.join(central, keys).select(
        *keys, "n", "mean", F.sqrt("_m2").alias("spread"), (F.col("_m3") / (m2 * F.sqrt(m2))).alias("skewness"), (F.col("_m4") / (m2 * m2)).alias("kurtosis"))


def standardised(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``_z_<feature>``: distance from the mean of all complete rows in standard deviations (0 if there is none)."""
    complete = rows.dropna(subset=list(features))
    figures = complete.agg(*[F.avg(c).alias(f"_mean_{c}") for c in features], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in features])
    out = rows.crossJoin(F.broadcast(figures))  # one row
    z = {f"_z_{c}": F.when(F.col(f"_sd_{c}") > 0, (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}")).when(F.col(c).isNotNull(), 0.0) for c in features}
    return out.withColumns(z).drop(*[f"_{p}_{c}" for p in ("mean", "sd") for c in features])


def _squared(z: Sequence[str], centre: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for c, v in zip(z, centre, strict=True):
        out = out + (F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v))
    return out


def _nearest(rows: DataFrame, z: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """Adds ``cluster`` (the first of equally near ones) and ``_d2``."""
    d = F.array(*[_squared(z, c) for c in centres])
    return rows.withColumn("_all", d).withColumns({"_d2": F.array_min("_all"), "cluster": (F.array_position("_all", F.array_min("_all")) - 1).cast("int")}).drop("_all")


def starts(rows: DataFrame, key: str, z: Sequence[str], k: int) -> list[list[float]]:
    """Centres to begin with: the row nearest to the origin, then always the row farthest from all chosen; the smallest key of equals."""
    first = rows.orderBy(_squared(z, [0.0] * len(z)), key).limit(1).select(*z).collect()
    chosen = [list(r) for r in first]
    while chosen and len(chosen) < k:
        chosen += [list(r) for r in _nearest(rows, z, chosen).orderBy(F.desc("_d2"), key).limit(1).select(*z).collect()]
    return chosen


def k_means(rows: DataFrame, key: str, features: Sequence[str], k: int, rounds: int) -> tuple[DataFrame, list[list[float]]]:
    """``rows`` with ``cluster`` and ``distance`` (standardised) after ``rounds`` rounds; and the centres.

    A cluster left without rows takes the row that is farthest from its own centre (the next one for the next
    such cluster). Rows with a null feature belong to no cluster.
    """
    z = [f"_z_{c}" for c in features]
    table = materialize(standardised(rows, features), "cluster-rows")
    whole = table.dropna(subset=z)
    centres = starts(whole, key, z, k)
    for _ in range(rounds if centres else 0):
        near = _nearest(whole, z, centres)
        found = {r.cluster: [r[c] for c in z] for r in near.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in z]).collect()}  # k rows
        empty = [i for i in range(len(centres)) if i not in found]
        if empty:
            far = near.orderBy(F.desc("_d2"), key).limit(len(empty)).select(*z).collect()
            found |= {i: list(r) for i, r in zip(empty, far)}
        centres = [found.get(i, centres[i]) for i in range(len(centres))]
    if not centres:
        return table.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")}).drop(*z), centres
    out = _nearest(table, z, centres)
    known = F.col("_d2").isNotNull()
    return out.withColumns({"cluster": F.when(known, F.col("cluster")), "distance": F.when(known, F.sqrt("_d2"))}).drop("_d2", *z), centres


def outsiders(rows: DataFrame, key: str, features: Sequence[str], k: int = 4, rounds: int = 8, minor: float = 0.1) -> DataFrame:
    """``k_means`` rows with ``share`` of their cluster and ``verdict``.

    MAIN for the largest cluster (the smallest number of equals), REPLACED for clusters with less than ``minor``
    of all rows, VARIANT for others, UNKNOWN for rows that belong to none.
    """
    found = materialize(k_means(rows, key, features, k, rounds)[0], "clusters")
    sizes = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"), F.max(F.struct("_n", (-F.col("cluster")).alias("_c"))).alias("_top"))
    sizes = sizes.crossJoin(F.broadcast(total)).select("cluster", (F.col("_n") / F.col("_t")).alias("share"), (F.col("cluster") == -F.col("_top._c")).alias("_main"))
    out = found.join(F.broadcast(sizes), "cluster", "left")  # k rows
    verdict = F.when(F.col("cluster").isNull(), "UNKNOWN").when(F.col("_main"), "MAIN").when(F.col("share") < minor, "REPLACED").otherwise("VARIANT")
    return out.withColumn("verdict", verdict).drop("_main")
