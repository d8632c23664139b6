"""Annotation and camera files: CSV, JSON and XML readers and writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators.cameras import POSE, Calibration

#: Places of the columns in a file without a header.
DEFAULT_ORDER = {"id": 0, "orig_x": 1, "orig_y": 2, "orig_z": 3, "label": 4}


def resolve(header: list[str] | None) -> tuple[dict[str, int], list[int]]:
    """Column places and the places of other columns; x, y, z stand for orig_x, orig_y, orig_z."""
    if header is None:
        return dict(DEFAULT_ORDER), []
    names = [h.strip().strip('"') for h in header]
    places = {("orig_" + n if n in "xyz" else n): i for i, n in enumerate(names)}
    missing = [n for n in DEFAULT_ORDER if n not in places]
    if missing:
        raise ValueError(f"missing annotation columns: {missing}")
    known = {*DEFAULT_ORDER, "label_conf", "world_x", "world_y", "world_z"}
    return {n: i for n, i in places.items() if n in known}, [i for n, i in places.items() if n not in known]


def _ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one file with their order; annotation files are small and read in one piece."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r", ""), "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "")


def annotations_from_rows(lines: DataFrame, header: list[str] | None, orig_coords_only: bool = False) -> DataFrame:
    """Lines (pos, line) split at plain commas into the annotation schema."""
    return annotations_from_cells(lines.select("pos", F.split("line", ",").alias("cells")), header, orig_coords_only)


def annotations_from_cells(rows: DataFrame, header: list[str] | None, orig_coords_only: bool = False) -> DataFrame:
    """Rows (pos, cells), as of a worksheet, into the annotation schema; cells are text and may hold commas.

    Null cells, and those beyond the end of a short row, are null.
    """
    places, rest = resolve(header)
    at = lambda n: F.get("cells", F.lit(places[n])) if n in places else F.lit(None).cast("string")
    number = lambda n: at(n).try_cast("double")
    world = [F.lit(None).cast("double") if orig_coords_only else number(f"world_{a}") for a in "xyz"]
    return rows.select(F.trim(at("id")).alias("id"), F.col("pos").cast("long").alias("pos"), *(number(f"orig_{a}").alias(f"orig_{a}") for a in "xyz"), *(F.coalesce(w, number(f"orig_{a}")).alias(a) for a, w in zip("xyz", world, strict=True)), F.trim(at("label")).alias("label"), number("label_conf").alias("label_conf"), F.array(*(F.get("cells", F.lit(i)) for i in rest)).cast("array<string>").alias("other"))


def worksheet_annotations(spark: SparkSession, rows: Iterable[Iterable], header: bool = True, orig_coords_only: bool = False) -> DataFrame:
    """Annotations of any iterable of rows of cells, the first one a header unless told otherwise; empty rows are left out."""
    held = [[None if c is None else str(c) for c in row] for row in rows]
    held = [row for row in held if any(c is not None and c.strip() for c in row)]
    names = [c or "" for c in held.pop(0)] if header and held else None
    if header and names is None:
        raise ValueError("a worksheet with a header has at least one row")
    return annotations_from_cells(spark.createDataFrame(list(enumerate(held)), "pos long, cells array<string>"), names, orig_coords_only)


def read_annotations(spark: SparkSession, path: str, header: bool = True, orig_coords_only: bool = False) -> DataFrame:
    """Annotations of a CSV file, in file order."""
    lines = _ordered_lines(spark, path)
    if not header:
        return annotations_from_rows(lines, None, orig_coords_only)
    first = lines.orderBy("pos").first()
    return annotations_from_rows(lines.where(F.col("pos") > first.pos), first.line.split(","), orig_coords_only)


def add_meta_data(annotations: DataFrame, meta: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """annotations with a meta_data map of the other columns, and the metadata rows without annotation."""
    names = [c for c in meta.columns if c != key]
    rows = meta.select(F.col(key).alias("meta_id"), F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("string") for c in names))).alias("meta_data"))
    joined = annotations.join(rows, F.col("id") == F.col("meta_id"), "left").drop("meta_id")
    return joined, rows.join(annotations, F.col("meta_id") == F.col("id"), "left_anti")


def flatten_maps(annotations: DataFrame, *maps: str) -> DataFrame:
    """Map columns as one column a key, in sorted order; the keys are the schema, so they are few."""
    out = annotations
    for m in maps:
        keys = sorted(r[0] for r in annotations.select(F.explode(F.map_keys(m))).distinct().collect())
        out = out.select("*", *(F.col(m)[k].alias(k) for k in keys)).drop(m)
    return out


def save_annotations(annotations: DataFrame, path: str) -> None:
    """CSV with NA for what is absent."""
    maps = [c for c, t in annotations.dtypes if t.startswith("map")]
    rows = flatten_maps(annotations, *maps)
    rows.select(*(F.col(c).cast("string") for c in rows.columns)).write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a JSON object keyed by id; entries without a centre are skipped."""
    rows = spark.read.option("multiLine", True).schema("cameras map<string, struct<transform: string, center: array<double>, path: string>>").json(path)
    rows = rows.select(F.explode("cameras").alias("cam_id", "c")).where("c.center is not null")
    numbers = F.split(F.regexp_replace("c.transform", r"[\[\]\s]", ""), ",")
    rows = rows.select("cam_id", *(F.col("c.center")[i].alias(n) for i, n in enumerate(("cx", "cy", "cz"))), *(F.get(numbers, F.lit(i)).cast("double").alias(n) for i, n in enumerate(POSE)), F.col("c.path").alias("path"))
    rows = rows.withColumn("filename", F.element_at(F.split("path", r"[\\/]+"), -1))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("cam_id")).cast("long"))  # a row a camera


def read_calibration(spark: SparkSession, path: str) -> Calibration:
    """The first adjusted frame calibration of an XML file."""
    rows = spark.read.format("xml").option("rowTag", "calibration").load(path)
    one = rows.where((F.col("_type") == "frame") & (F.col("_class") == "adjusted")).first()
    if one is None:
        raise ValueError("no adjusted frame calibration")
    get = lambda n: float(one[n]) if n in rows.columns and one[n] is not None else 0.0
    width, height = int(one["resolution"]["_width"]), int(one["resolution"]["_height"])
    f = get("f")
    return Calibration(f + get("b1"), f, width / 2 + get("cx"), height / 2 + get("cy"), width, height, get("k1"), get("k2"), get("k3"), get("p1"), get("p2"))


ATTRIBUTES = "cam_id string, path string, datetime string, camdist double, depth double, depth_pred double, depth_res double"


def load_camera_attributes(cameras: DataFrame, path: str) -> tuple[DataFrame, int]:
    """cameras updated by cam_id, and how many rows of the file name no camera."""
    rows = cameras.sparkSession.read.option("header", True).option("nullValue", "").schema(ATTRIBUTES).csv(path)
    unknown = rows.join(cameras, "cam_id", "left_anti").count()
    new = rows.select("cam_id", *(F.col(c).alias(f"new_{c}") for c in rows.columns if c != "cam_id"))
    joined = cameras.join(new, "cam_id", "left")
    for c in rows.columns[1:]:
        old = F.col(c) if c in cameras.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(f"new_{c}", old)).drop(f"new_{c}")
    return joined, unknown


def save_camera_attributes(cameras: DataFrame, path: str) -> None:
    """The seven attribute columns as CSV."""
    names = [x.split()[0] for x in ATTRIBUTES.split(", ")]
    have = [F.col(c) if c in cameras.columns else F.lit(None).cast("string").alias(c) for c in names]
    cameras.select(*have).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
