"""Seeded Monte Carlo propagation, distribution summaries and sensitivity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from footfall.functions import constants as K
from footfall.functions.text import fill, fixed, sci
from footfall.operators.clamped import nosing_by_plane, nosing_ratio, volume_by_plane
from footfall.operators.keyed import KeyTable, attach
from footfall.operators.quantiles import exact_quantiles, spearman_squared
from footfall.session import materialize

HYPOTHESES = "array<struct<scale:double,prob:double,label:string>>"
DRAWS = (
    "mesh_id string, s int, scale double, hypothesis string, b long, k_spec double, grf double, slip double, "
    "threshold double, slope double"
)


def _hypotheses(rows: Sequence[tuple[float, float, str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(s).alias("scale"), F.lit(p).alias("prob"), F.lit(t).alias("label")) for s, p, t in rows
    ])


def scale_prior(rows: DataFrame, width: str = "width_raw", scale: str = "user_scale") -> DataFrame:
    """Adds ``user_provided`` and ``hypotheses`` (scale, prob, label) from raw mesh width."""
    w = F.col(width)
    inferred = (
        F.when(w > K.SCALE_WIDE_ABOVE, _hypotheses(K.SCALE_WIDE))
        .when(w > K.SCALE_MIDDLE_ABOVE, _hypotheses(K.SCALE_MIDDLE))
        .otherwise(_hypotheses(K.SCALE_NARROW))
    )
    given = F.col(scale).isNotNull()
    return rows.withColumns({
        "user_provided": given, "hypotheses": F.when(given, _hypotheses(K.SCALE_DEFAULT)).otherwise(inferred),
    })


def hypothesis_labels() -> Column:
    return F.when(F.col("user_provided"), F.array(F.lit("user"))).otherwise(
        F.transform("hypotheses", lambda h: h["label"])
    )


def _draw_one(user_scale, hypotheses, n_planes: int, median: float, log_std: float, n: int, seed: int) -> dict:
    """One seeded sequence: scale, plane, material per sample, then threshold and slope."""
    rng = np.random.default_rng(seed)
    log_median, log_slip = np.log(median), np.log(K.MICROSLIP_M)
    if user_scale is None:
        share = np.array([h[1] for h in hypotheses])
        share = share / share.sum()
    out = {c: [] for c in ("scale", "hypothesis", "b", "k_spec", "grf", "slip")}
    for _ in range(n):
        base, label = user_scale, "user"
        if user_scale is None:
            base, _, label = hypotheses[rng.choice(len(share), p=share)]
        out["scale"].append(float(base * rng.lognormal(0, K.SCALE_CV)))
        out["hypothesis"].append(label)
        out["b"].append(int(rng.integers(n_planes)))
        out["k_spec"].append(rng.lognormal(log_median, log_std))
        out["grf"].append(min(max(rng.normal(K.GRF_DESCENT, K.GRF_STD), K.GRF_LOW), K.GRF_HIGH))
        out["slip"].append(rng.lognormal(log_slip, K.MICROSLIP_LOG_STD))
    return out | {"s": np.arange(n), "threshold": rng.normal(1.0, 0.1), "slope": rng.uniform(4.0, 6.0)}


def monte_carlo_draws(config: DataFrame, n: int = K.MC_SAMPLES, seed: int = K.MC_SEED) -> DataFrame:
    """config(mesh_id, user_scale, hypotheses, n_planes, k_spec_median, log_std) -> n draws per mesh.

    Every mesh restarts the generator, so meshes with equal settings share one sequence.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            for mesh_id, scale, hyps, planes, median, std in batch.itertuples(index=False):
                scale = None if scale is None or np.isnan(scale) else float(scale)
                hyps = tuple((h["scale"], h["prob"], h["label"]) for h in hyps)
                setting = (scale, hyps, int(planes), float(median), float(std))
                if setting not in known:
                    if len(known) > 64:
                        known.clear()
                    known[setting] = pd.DataFrame(_draw_one(*setting, n, seed))
                yield known[setting].assign(mesh_id=mesh_id)

    cols = config.select("mesh_id", "user_scale", "hypotheses", "n_planes", "k_spec_median", "log_std")
    return cols.mapInPandas(draw, DRAWS)


def monte_carlo_samples(
    draws: DataFrame, plane_samples: DataFrame, tread: DataFrame, points: DataFrame, frame_table: KeyTable,
    compat: bool = True,
) -> DataFrame:
    """One row per mesh and draw with volume, depths, nosing ratio, traffic and P(ascent).

    ``compat`` scales the vertices by the drawn factor again for the nosing ratio.
    """
    draws = materialize(draws, "draws")
    used = draws.select("mesh_id", "b").distinct().join(plane_samples, ["mesh_id", "b"])
    planes = materialize(used.select(
        "mesh_id", F.col("b").cast("long").alias("pid"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("pc").alias("c"),
        F.lit(1.0).alias("s"),
    ), "used")
    volumes = volume_by_plane(tread, planes, frame_table).withColumnRenamed("pid", "b")
    if compat:
        per_sample = draws.select("mesh_id", F.col("s").alias("sid"), F.col("b").alias("pid"), "scale").join(
            planes.drop("s"), ["mesh_id", "pid"]
        )
        settings = per_sample.select(
            "mesh_id", F.col("sid").cast("long").alias("pid"), (F.col("a") * F.col("scale")).alias("a"),
            (F.col("b") * F.col("scale")).alias("b"), "c", F.col("scale").alias("s"),
        )
        nosing = nosing_by_plane(points, settings, frame_table).withColumnRenamed("pid", "s")
        key = "s"
    else:
        nosing = nosing_by_plane(points, planes, frame_table).withColumnRenamed("pid", "b")
        key = "b"
    ratios = nosing.select("mesh_id", key, nosing_ratio(F.col("front"), F.col("centre"), compat).alias("nosing_ratio"))
    joined = draws.join(volumes, ["mesh_id", "b"]).join(ratios, ["mesh_id", key])
    load = K.BODY_WEIGHT_N * F.col("grf")
    usable = (F.col("k_spec") > 0) & (F.col("slip") > 0) & (load > 0)
    return joined.withColumns({
        "traffic": F.when(
            usable, F.col("volume") / (F.col("k_spec") * K.MM3_PER_NM_TO_M2_PER_N * load * F.col("slip"))
        ).otherwise(F.lit(0.0)),
        "prob_ascent": prob_ascent(F.col("nosing_ratio"), F.col("threshold"), F.col("slope")),
    })


def prob_ascent(ratio: Column, threshold: Column, slope: Column) -> Column:
    return 1.0 / (1.0 + F.exp(slope * (ratio - threshold)))


QUANTILES = (0.5, 0.25, 0.75, 0.025, 0.975)


def exact_distribution(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Distribution struct ``dist`` and count ``n`` per key, over sample sets of any size; one NaN makes the quantiles NaN."""
    keys = list(keys)
    q = exact_quantiles(rows, value, QUANTILES, keys)
    basic = rows.groupBy(*keys).agg(
        F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.max(F.isnan(value)).alias("_spoiled")
    )
    spoiled = F.transform("q", lambda x: F.when(F.col("_spoiled"), F.lit(float("nan"))).otherwise(x))
    return basic.join(q, keys).select(*keys, "n", distribution_of(F.col("_m"), F.col("_s"), spoiled).alias("dist"))


def distributions(samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One distribution struct per column and mesh."""
    long = samples.select("mesh_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns
    ])))
    return exact_distribution(long, "v", ["mesh_id", "metric"]).groupBy("mesh_id").agg(*[
        F.first(F.when(F.col("metric") == c, F.col("dist")), ignorenulls=True).alias(c) for c in columns
    ])


def scaled_distribution(dist: str, divisor: float) -> Column:
    """The distribution of the samples over a positive constant."""
    d = F.col(dist)

    def pair(name: str) -> Column:
        return F.struct((d[name]["lo"] / divisor).alias("lo"), (d[name]["hi"] / divisor).alias("hi"))

    return F.struct(
        *[(d[k] / divisor).alias(k) for k in ("mean", "median", "std")], pair("ci_50").alias("ci_50"), pair("ci_95").alias("ci_95")
    )


def distribution_of(mean: Column, std: Column, q: Column) -> Column:
    """Summary struct from the mean, std and the quantiles (.5, .25, .75, .025, .975)."""
    def pair(i: int, j: int) -> Column:
        return F.struct(q[i].alias("lo"), q[j].alias("hi"))

    return F.struct(
        mean.alias("mean"), q[0].alias("median"), std.alias("std"), pair(1, 2).alias("ci_50"), pair(3, 4).alias("ci_95")
    )


SOURCE_COLS = {"k_spec": "k_spec", "scale": "scale", "plane": "volume", "grf": "grf", "slip": "slip"}


def correlations(samples: DataFrame) -> DataFrame:
    """Squared rank correlation of traffic with each source, one column per source; ranks need no transform of the values."""
    found = spearman_squared(samples, list(SOURCE_COLS.values()), "traffic", ["mesh_id"])
    return found.groupBy("mesh_id").agg(*[
        F.coalesce(F.nanvl(F.max(F.when(F.col("column") == c, F.col("rho2"))), F.lit(0.0)), F.lit(0.0)).alias(s) for s, c in SOURCE_COLS.items()
    ])


def sensitivity(samples: DataFrame) -> DataFrame:
    """Share of rank variance of traffic by source: (mesh_id, k_spec, scale, plane, grf, slip)."""
    return normalize_shares(correlations(samples))


def normalize_shares(correlations: DataFrame) -> DataFrame:
    """Squared rank correlations per source -> shares summing to 1.

    Volume stands for the plane: its share is reduced and never below a floor.
    """
    r = correlations.withColumn("plane", F.greatest(F.lit(K.PLANE_SHARE_FLOOR), F.col("plane") * K.PLANE_SHARE_FACTOR))
    total = F.col("k_spec") + F.col("scale") + F.col("grf") + F.col("slip") + F.col("plane")
    total = F.when(total < 1e-10, F.lit(1.0)).otherwise(total)
    return r.select("mesh_id", *[(F.col(c) / total).alias(c) for c in K.SENSITIVITY_SOURCES])


def share_map(shares: DataFrame) -> DataFrame:
    labels = [F.lit(c) for c in K.SENSITIVITY_SOURCES]
    return shares.select(
        "mesh_id", F.map_from_arrays(F.array(*labels), F.array(*K.SENSITIVITY_SOURCES)).alias("sensitivity"),
        dominant_source().alias("traffic_dominated_by"),
    )


def dominant_source() -> Column:
    values = F.array(*K.SENSITIVITY_SOURCES)
    names = F.array(*[F.lit(c) for c in K.SENSITIVITY_SOURCES])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def hypothesis_shares(samples: DataFrame) -> DataFrame:
    """Draw frequency of each scale hypothesis: (mesh_id, hypothesis, share)."""
    counted = samples.groupBy("mesh_id", "hypothesis").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("mesh_id"))  # at most a few labels per mesh
    return counted.select("mesh_id", "hypothesis", (F.col("n") / whole).alias("share"))


def scale_ambiguous(mean: Column, std: Column, likely: Column) -> Column:
    """``likely``: hypotheses drawn in more than a tenth of the samples."""
    spread = F.when(mean > 0, F.try_divide(std, mean)).otherwise(F.lit(0.0))
    return (spread > 0.5) | (likely > 1)


def axis_ambiguous(median_ratio: Column, median_flipped: Column) -> Column:
    return (median_ratio < K.AXIS_FLIP_AT) != (median_flipped < K.AXIS_FLIP_AT)


def _above_half(col: Column) -> Column:
    return (col > 0.5) & ~F.isnan(col)


def direction_class(lo: Column, hi: Column) -> Column:
    return F.when(_above_half(lo), "ASCENT").when(hi < 0.5, "DESCENT").otherwise("AMBIGUOUS")


def direction_label(median: Column, lo: Column, hi: Column) -> Column:
    def pct(c: Column) -> Column:
        return fixed(c * 100, 0)

    return (
        F.when(_above_half(lo), fill("ASCENT ({0}% [{1}-{2}%])", pct(median), pct(lo), pct(hi)))
        .when(hi < 0.5, fill("DESCENT ({0}% [{1}-{2}%])", pct(1 - median), pct(1 - hi), pct(1 - lo)))
        .otherwise(fill("AMBIGUOUS (P_ascent={0}% [{1}-{2}%])", pct(median), pct(lo), pct(hi)))
    )


def format_with_ci(dist: str, digits: int = 2, scientific: bool = False) -> Column:
    show = sci if scientific else fixed
    return fill("{0} [{1} - {2}]", *[show(F.col(f"{dist}.{p}"), digits) for p in ("median", "ci_95.lo", "ci_95.hi")])


def format_compact(dist: str, digits: int = 2) -> Column:
    return fill("{0} [{1}-{2}]", *[fixed(F.col(f"{dist}.{p}"), digits) for p in ("median", "ci_50.lo", "ci_50.hi")])


METRICS = ("volume", "max_depth", "mean_depth", "prob_ascent", "nosing_ratio", "total_steps")


def summarize(samples: DataFrame, widths: DataFrame, quality: DataFrame, n: int, seed: int) -> DataFrame:
    """Complete result row per mesh. ``widths``: mesh_id, width; ``quality``: mesh_id, weak_fit."""
    samples = materialize(samples.withColumns({
        "total_steps": F.col("traffic"), "flipped": 1 / (F.col("nosing_ratio") + 1e-10)
    }), "samples")
    base = distributions(samples, [*METRICS, "flipped", "scale"]).withColumns({
        f"daily_{y}y": scaled_distribution("total_steps", float(y * K.DAYS_PER_YEAR)) for y in K.HORIZONS_YEARS
    })
    posterior = hypothesis_shares(samples).groupBy("mesh_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("hypothesis", "share")))).alias("scale_hypothesis_posterior"),
        F.count_if(F.col("share") > 0.1).alias("_likely"),
    )
    shares = share_map(sensitivity(samples))
    joined = base.join(posterior, "mesh_id").join(shares, "mesh_id").join(widths, "mesh_id").join(
        quality.select("mesh_id", F.col("weak_fit").alias("weak_plane_fit")), "mesh_id"
    )
    p = F.col("prob_ascent")
    return joined.withColumns({
        "scale_ambiguous": scale_ambiguous(
            F.col("scale.mean") * F.col("width"), F.col("scale.std") * F.col("width"), F.col("_likely")
        ),
        "axis_ambiguous": axis_ambiguous(F.col("nosing_ratio.median"), F.col("flipped.median")),
        "classification": direction_label(p["median"], p["ci_95"]["lo"], p["ci_95"]["hi"]),
        "simple_classification": direction_class(p["ci_95"]["lo"], p["ci_95"]["hi"]),
        "n_samples": F.lit(n), "seed": F.lit(seed),
    }).drop("flipped", "scale", "_likely", "width")
