"""Deterministic survey tables over the test tables, as column expressions both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PX = "((o_orderkey*7919) % 10007)/1e3"
_PY = "((o_orderkey*4729) % 5009)/1e3"
POINTS = [
    "o_orderkey AS point_id", f"{_PX} AS x", f"{_PY} AS y", f"3e-1*({_PX}) + 1e-1*({_PY}) + ((o_orderkey*31) % 97)/1e3 AS z",
    "(o_custkey%256)/255e0 AS r", "(o_orderkey%256)/255e0 AS g", "((o_orderkey*7)%256)/255e0 AS b",
    "(((o_orderkey*31)%41)-20)/1e2 AS nx", "(((o_orderkey*17)%41)-20)/1e2 AS ny", "1e0 AS nz",
]
_AX = "((c_custkey*613)%997)/1e2"
_AY = "((c_custkey*389)%491)/1e2"
ANNOTATIONS = ["concat('ann_', lpad(cast(c_custkey as string), 6, '0')) AS id", "c_custkey AS pos", f"{_AX} AS x", f"{_AY} AS y", f"3e-1*({_AX}) + 1e-1*({_AY}) + 5e-2 AS z", "c_mktsegment AS label"]
CAMERAS = ["concat('cam_', lpad(cast(s_suppkey as string), 4, '0')) AS cam_id", "s_suppkey AS pos", "(s_suppkey%20)*5e-1 AS cx", "(s_suppkey%5)*1e0 AS cy", "6e0 AS cz"]
FRAMES = ["cast(row_number() over (order by ts, event_id) - 1 as bigint) AS frame_number", "value AS brightness"]
TARGETS = ["concat('target ', cast(p_partkey as string)) AS label", "p_partkey AS pos", "((p_partkey*613)%997)/1e2 AS x", "((p_partkey*389)%491)/1e2 AS y", "((p_partkey*31)%97)/1e2 AS z"]
TABLES = {"fx_points": ("orders", POINTS, ""), "fx_annotations": ("customer", ANNOTATIONS, ""), "fx_cameras": ("supplier", CAMERAS, ""), "fx_frames": ("events", FRAMES, ""), "fx_targets": ("part", TARGETS, "")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table."""
    table, columns, where = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return (rows.where(where) if where else rows).selectExpr(*columns)


def sql(body: str, *names: str) -> str:
    """DuckDB SQL whose fixtures are defined ahead of the body."""
    ctes = []
    for n in names:
        table, columns, where = TABLES[n]
        columns = [c.replace("as string", "as varchar") for c in columns]
        ctes.append(f"{n} AS (SELECT {', '.join(columns)} FROM {table}{' WHERE ' + where if where else ''})")
    body = body.strip()
    more = ", " + body[5:] if body.startswith("WITH ") else "\n" + body
    return "WITH RECURSIVE " + ",\n".join(ctes) + more
