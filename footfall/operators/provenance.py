"""Where a stone comes from: readings against the confidence ellipse of reference readings.

The ellipse of a key rests on means and covariances, which are partial sums; readings are judged
row by row, by forward substitution through the factors of the covariance matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.operators.keyed import KeyTable, attach, settle

# 95th percentile of the chi-square distribution with 1 to 6 degrees of freedom
CHI_SQUARE_95 = (3.841458820694124, 5.991464547107979, 7.814727903251179, 9.487729036781154, 11.070497693516351, 12.591587243743977)
RANK = 1e-9  # a direction with less than this part of its feature's variance left is no direction of its own


def ellipse(readings: DataFrame, keys: Sequence[str], features: Sequence[str]) -> KeyTable:
    """Per key: n, means (m_i) and the factors of the covariance matrix: d_i and l_i_k (k < i), with their ``rank``.

    Readings with a null feature are left out. d_i is null where feature i is constant or a combination of those
    before it. Keys of a single reading have no covariance and are left out.
    """
    keys, p = list(keys), len(features)
    if not 1 <= p <= len(CHI_SQUARE_95):
        raise ValueError(f"1 to {len(CHI_SQUARE_95)} features, not {p}")
    whole = readings.dropna(subset=list(features))
    sums = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)],
        *[F.covar_samp(features[i], features[k]).alias(f"c_{i}_{k}") for i in range(p) for k in range(i + 1)])
    out = sums.where("n > 1")
    for i in range(p):
        for k in range(i):
            inner = F.col(f"c_{i}_{k}")
            for m in range(k):
                inner = inner - F.col(f"l_{i}_{m}") * F.coalesce(f"d_{m}", F.lit(0.0)) * F.col(f"l_{k}_{m}")
            out = out.withColumn(f"l_{i}_{k}", F.when(F.col(f"d_{k}").isNotNull(), inner / F.col(f"d_{k}")).otherwise(0.0))
        left = F.col(f"c_{i}_{i}")
        for k in range(i):
            left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}") * F.coalesce(f"d_{k}", F.lit(0.0))
        out = out.withColumn(f"d_{i}", F.when((F.col(f"c_{i}_{i}") > 0) & (left > RANK * F.col(f"c_{i}_{i}")), left))
    rank = sum((F.col(f"d_{i}").isNotNull().cast("int") for i in range(p)), F.lit(0))
    factors = [f"m_{i}" for i in range(p)] + [f"c_{i}_{i}" for i in range(p)] + [f"d_{i}" for i in range(p)] + [f"l_{i}_{k}" for i in range(p) for k in range(i)]
    return settle(out.select(*keys, "n", rank.alias("rank"), *factors), "ellipse")


def _distance(features: Sequence[Column]) -> Column:
    """Squared Mahalanobis distance; infinite off the plane on which all reference readings lie."""
    left: list[Column] = []
    total = F.lit(0.0)
    for i, x in enumerate(features):
        r = x - F.col(f"m_{i}")
        for k in range(i):
            r = r - F.col(f"l_{i}_{k}") * left[k]
        left.append(r)
        slack = F.sqrt(RANK * F.col(f"c_{i}_{i}")) + RANK * F.abs(F.col(f"m_{i}"))
        total = total + F.when(F.col(f"d_{i}").isNotNull(), r * r / F.col(f"d_{i}")).when(F.abs(r) > slack, float("inf")).otherwise(0.0)
    return total


def _limit() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CHI_SQUARE_95]), F.greatest(F.col("rank"), F.lit(1)))


def judge_readings(readings: DataFrame, shape: KeyTable, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``readings`` with ``distance2`` (squared, in covariances) and ``outside`` the 95 % ellipse of their key.

    Both are null for readings with a null feature and where the key has no more reference readings than features.
    """
    own = shape.of(shape.df.withColumnRenamed("n", "_n"))
    rows = attach(readings, own, keys, "left", spread=list(features))
    known = F.when(F.col("_n") > len(features), _distance([F.col(c).cast("double") for c in features]))
    out = rows.withColumn("distance2", known)
    return out.withColumn("outside", F.col("distance2") > _limit()).select(*readings.columns, "distance2", "outside")


def provenance(reference: DataFrame, suspects: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per key of ``suspects``: readings of both kinds, suspects outside, and a verdict on their mean.

    (keys, n_reference, n_suspects, n_outside, distance2 of the suspects' mean, verdict): OTHER SOURCE if the mean
    lies outside the reference ellipse, else SAME SOURCE POSSIBLE; UNKNOWN without enough readings.
    """
    keys = list(keys)
    shape = ellipse(reference, keys, features)
    judged = judge_readings(suspects.dropna(subset=list(features)).select(*keys, *features), shape, keys, features)
    found = settle(judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_suspects"), F.count_if("outside").alias("n_outside"), *[F.avg(c).alias(c) for c in features]), "suspects")
    centre = judge_readings(found.df, shape, keys, features)
    verdict = F.when(F.col("outside"), "OTHER SOURCE").when(F.col("outside").isNull(), "UNKNOWN").otherwise("SAME SOURCE POSSIBLE")
    return centre.join(shape.df.select(*keys, F.col("n").alias("n_reference")), keys, "left").select(
        *keys, F.coalesce("n_reference", F.lit(0)).alias("n_reference"), "n_suspects", "n_outside", "distance2", verdict.alias("verdict"))
