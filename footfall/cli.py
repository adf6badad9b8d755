"""Command line: ``spark-submit footfall/cli.py surfaces/*.obj --material marble -o out``."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))  # started as a file, from anywhere

from pyspark.errors import AnalysisException  # noqa: E402
from pyspark.sql import DataFrame, functions as F  # noqa: E402

from footfall.functions import constants as K  # noqa: E402
from footfall.plans import pipeline as PL  # noqa: E402
from footfall.session import release_scratch, session, ship  # noqa: E402
from footfall.sinks import charts, report  # noqa: E402
from footfall.sources.obj import read_obj, scale_to_width  # noqa: E402
from footfall.operators.traffic import likely_units  # noqa: E402


def arguments(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Analyse wear of scanned surfaces")
    parser.add_argument("obj_file", help="OBJ file, folder or pattern")
    parser.add_argument("--material", default="granite", choices=[m[0] for m in K.MATERIALS])
    parser.add_argument("--width", type=float, help="surface width in metres")
    parser.add_argument("--scale", type=float, default=1.0)
    parser.add_argument("--measured-width-m", type=float)
    parser.add_argument("--output", "-o")
    parser.add_argument("--use-legacy-wear-volume", action="store_true")
    parser.add_argument("--ransac-iters", type=int, default=K.RANSAC_ITERS)
    parser.add_argument("--ransac-thresh-mm", type=float, default=K.RANSAC_THRESH_MM)
    parser.add_argument("--seg-angle-deg", type=float, default=K.TREAD_ANGLE_DEG)
    parser.add_argument("--roi-quantiles", type=float, nargs=2, default=list(K.ROI_QUANTILES))
    parser.add_argument("--uncertainty", action="store_true")
    parser.add_argument("--n-samples", type=int, default=K.MC_SAMPLES)
    parser.add_argument("--uncertainty-seed", type=int, default=K.MC_SEED)
    parser.add_argument("--corrected", action="store_true", help="leave out known oddities of the published model")
    return parser.parse_args(argv)


def main(argv=None) -> int:
    args = arguments(argv)
    spark = session()
    try:
        return run(spark, args)
    finally:
        release_scratch(spark)


def run(spark, args: argparse.Namespace) -> int:
    ship(spark)
    config = PL.Config(
        material=args.material, nominal_width=args.width, scale=args.scale,
        use_legacy_wear_volume=args.use_legacy_wear_volume, ransac_iters=args.ransac_iters,
        ransac_thresh_mm=args.ransac_thresh_mm, seg_angle_deg=args.seg_angle_deg,
        roi_quantiles=tuple(args.roi_quantiles), compat=not args.corrected,
    )
    try:
        mesh = read_obj(spark, args.obj_file, 1.0 if args.measured_width_m else args.scale)
    except AnalysisException as missing:
        print(f"Error: {missing}", file=sys.stderr)
        return 1
    surface = PL.load(mesh, config)
    if args.measured_width_m:
        mesh, factors = scale_to_width(mesh, surface.frame, args.measured_width_m)
        put(factors, args.output, "scales")
        surface = PL.load(mesh, config, factors)
    put_units(surface, args.output)
    uncertain = None
    if args.uncertainty:
        uncertain = PL.propagate(surface, args.n_samples, args.uncertainty_seed)
        put(report.uncertainty_lines(uncertain), args.output, "uncertainty_lines")
        if args.output:
            report.write_documents(report.uncertainty_document(uncertain), f"{args.output}/uncertainty")
    if uncertain is None or args.output:
        wear = PL.analyze_wear(surface)
        results = PL.estimate_traffic(wear, surface.config)
        put(report.report(results), args.output, "report")
        if args.output:
            report.write_documents(report.short_report(results), f"{args.output}/short_report")
            charts.write_charts(charts.all_charts(wear, results, config.grid, uncertain), f"{args.output}/charts")
    return 0


def put(rows: DataFrame, output: str | None, name: str) -> None:
    """Write all rows under the output folder; without one, print all of them, a partition at a time."""
    if output:
        rows.write.mode("overwrite").json(f"{output}/{name}")
        return
    for row in rows.toLocalIterator():
        print(row["text"] if "text" in rows.columns else "  ".join(f"{k}={v}" for k, v in row.asDict().items()))


def put_units(surface: PL.Surface, output: str | None) -> None:
    """Unit heuristic on the raw width, given when roles were set explicitly."""
    if surface.config.axes is None:
        return
    rows = surface.frame.df.select("mesh_id", (F.col("w_max") - F.col("w_min")).alias("width_raw"), F.lit(surface.config.scale).alias("scale"))
    put(likely_units(rows), output, "units")


if __name__ == "__main__":
    sys.exit(main())
