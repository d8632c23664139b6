"""python -m cairn.cli decimate | scalebars | views"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.operators.annotations import scalebar_lengths
from cairn.operators.grids import raster
from cairn.operators.orient import orient
from cairn.session import qualified
from cairn.sources.ply import PlySource
from cairn.sources.text import read_annotations

MOST_POINTS = 50_000_000


def cloud_name(path: str) -> str:
    """The file name without its ending and any decimation suffix."""
    return re.sub(r"_dec.*$", "", re.sub(r"\.ply$", "", re.split(r"[\\/]+", path)[-1]))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairn", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    d = commands.add_parser("decimate", help="exactly k points of a PLY file, in seeded order")
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("k", type=int)
    s = commands.add_parser("scalebars", help="measured scale bars of an annotation file")
    s.add_argument("annotations")
    s.add_argument("output")
    v = commands.add_parser("views", help="raster tables of a cloud from above and two sides")
    v.add_argument("source")
    v.add_argument("output")
    v.add_argument("--full", action="store_true")
    v.add_argument("--auto-orient", action="store_true")
    v.add_argument("--resolution", type=float, default=0.01)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    spark.dataSource.register(PlySource)
    if args.command == "scalebars":
        scalebar_lengths(read_annotations(spark, args.annotations)).write.mode("overwrite").option("header", True).csv(args.output)
        return 0
    source = qualified(spark, args.source)
    if args.command == "decimate":
        # partitions of the source, and so the parts, are in the order of the file
        spark.read.format("ply").option("raw", "true").option("sample", args.k).load(source).write.format("ply").option("like", source).mode("overwrite").save(qualified(spark, args.target))
        return 0
    reader = spark.read.format("ply").option("extras", "true")
    cloud = (reader if args.full else reader.option("sample", MOST_POINTS)).load(source)
    cloud = orient(cloud) if args.auto_orient else cloud
    values = tuple(c for c in ("r", "g", "b") if c in cloud.columns)
    for name, (a, b) in {"top": ("x", "y"), "front": ("x", "z"), "side": ("y", "z")}.items():
        view = cloud.select(F.col(a).alias("x"), F.col(b).alias("y"), *values)
        raster(view, args.resolution, values).write.mode("overwrite").parquet(f"{args.output}/{cloud_name(args.source)}_{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
