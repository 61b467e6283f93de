"""Command line: convert scene files or report on them."""

from __future__ import annotations

import argparse
import glob
import json
import sys

from .convert import Options, convert, info, output_path
from .sources import FORMATS, detect


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfield", description=__doc__)
    p.add_argument("--input", "-i", required=True)
    p.add_argument("--output", "-o")
    p.add_argument("--target_format", "--format", "-f", choices=FORMATS)
    p.add_argument("--info", "-I", action="store_true")
    p.add_argument("--debug", "-d", action="store_true")
    p.add_argument("--about", action="store_true")
    p.add_argument("--force", action="store_true")
    for flag in ("rgb", "auto_bbox", "extra_elements", "crop_sh", "keep_multicluster"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--bbox", type=float, nargs=6)
    for flag, kind in (("density_voxel_size", float), ("density_threshold", float), ("density_sensitivity", float), ("sor_k", int), ("sor_sigma", float), ("sor_intensity", float), ("sh_level", int)):
        p.add_argument(f"--{flag}", type=kind)
    p.add_argument("--min_opacity", type=int, default=0)
    p.add_argument("--compression_level", type=int, default=0)
    p.add_argument("--bucket_size", type=int, default=256)
    p.add_argument("--block_size", type=float, default=5.0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.about:
        print("lumenfield: splat scenes as Spark DataFrames")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lumenfield").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if a.info:
            for path in sorted(glob.glob(a.input)) or [a.input]:
                print(json.dumps(info(spark, path), default=str))
            return 0
        options = Options(**{k: v for k, v in vars(a).items() if k in Options.__dataclass_fields__})
        options.check()
        target = a.target_format or detect(a.input)
        path = output_path(a.input, target, a.output)
        if not options.changes and not a.force and target == "3dgs" and detect(a.input) == "3dgs":
            print("nothing to do; --force writes anyway", file=sys.stderr)
            return 1
        report = convert(spark, a.input, path, target, options, force=a.force)
        print(json.dumps({"written": path, **report}))
        return 0
    except Exception as e:
        if a.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
