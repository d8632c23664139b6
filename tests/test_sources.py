import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.sources import text
from cairn.sources.ply import PlySource


def cloud(path, n=1000, order="<", fields=(("x", "f4"), ("y", "f4"), ("z", "f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("nx", "f4"), ("ny", "f4"), ("nz", "f4"), ("quality", "u2"))):
    rng = np.random.default_rng(n)
    rows = np.zeros(n, [(k, order + t) for k, t in fields])
    for k, t in fields:
        rows[k] = rng.integers(0, 200, n) if t[0] == "u" else rng.random(n)
    names = {"f4": "float", "f8": "double", "u1": "uchar", "u2": "ushort"}
    head = ["ply", f"format binary_{'little' if order == '<' else 'big'}_endian 1.0", "comment made here", f"element vertex {n}", *(f"property {names[t]} {k}" for k, t in fields), "end_header", ""]
    path.write_bytes("\n".join(head).encode() + rows.tobytes())
    return rows


@pytest.fixture
def ply(spark):
    spark.dataSource.register(PlySource)
    return spark.read.format("ply")


@pytest.mark.parametrize("order", ["<", ">"])
def test_read_both_byte_orders(ply, tmp_path, order):
    rows = cloud(tmp_path / "a.ply", 1000, order)
    got = ply.option("records", "300").option("extras", "true").load(str(tmp_path / "a.ply")).orderBy("point_id").toPandas()
    assert list(got.columns) == ["point_id", "x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "quality"]
    assert (got["point_id"] == range(1000)).all() and np.allclose(got["z"], rows["z"]) and np.allclose(got["r"], rows["red"] / 255) and (got["quality"] == rows["quality"]).all()


def test_xyz_only_and_empty(ply, tmp_path):
    cloud(tmp_path / "b.ply", 0, fields=(("x", "f4"), ("y", "f4"), ("z", "f4")))
    got = ply.load(str(tmp_path / "b.ply"))
    assert got.columns == ["point_id", "x", "y", "z"] and got.count() == 0


@pytest.mark.parametrize("head", ["ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n", "ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\n", "ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty list uchar int x\nend_header\n"])
def test_bad_files(ply, tmp_path, head):
    (tmp_path / "c.ply").write_text(head)
    with pytest.raises(Exception, match="binary|ends before|list"):
        ply.load(str(tmp_path / "c.ply")).count()


def test_round_trip(ply, tmp_path):
    cloud(tmp_path / "a.ply", 5000)
    first = ply.option("extras", "true").load(str(tmp_path / "a.ply"))
    first.repartition(3).orderBy("point_id").write.format("ply").mode("overwrite").save(str(tmp_path / "d.ply"))
    again = first.sparkSession.read.format("ply").option("extras", "true").load(str(tmp_path / "d.ply"))
    a, b = (d.orderBy("point_id").toPandas() for d in (first, again))
    assert len(list(tmp_path.iterdir())) == 2
    for c in a.columns:
        assert np.allclose(a[c], b[c]), c


@pytest.mark.parametrize("k", [0, 7, 200, 900])
def test_decimate_writes_exactly_k(ply, tmp_path, k):
    cloud(tmp_path / "a.ply", 500)
    assert cli.main(["decimate", str(tmp_path / "a.ply"), str(tmp_path / "e.ply"), str(k)]) == 0
    got = ply.load(str(tmp_path / "e.ply"))
    assert got.count() == min(k, 500)


@pytest.mark.parametrize("order", ["<", ">"])
def test_decimate_keeps_records_byte_for_byte(spark, ply, tmp_path, order):
    fields = (("x", "f4"), ("y", "f4"), ("z", "f8"), ("red", "u1"), ("green", "u1"), ("blue", "u1"), ("id", "u4"), ("kind", "i1"), ("quality", "u2"))
    names = {"f4": "float", "f8": "double", "u1": "uchar", "u2": "uint16", "u4": "uint", "i1": "int8"}
    rows = np.zeros(300, [(k, order + t) for k, t in fields])
    rng = np.random.default_rng(1)
    for k, t in fields:
        rows[k] = rng.random(300) if t[0] == "f" else rng.integers(0, 100, 300)
    rows["id"] = 4_000_000_000 + np.arange(300)
    head = [f"property {names[t]} {k}" for k, t in fields]
    (tmp_path / "a.ply").write_bytes("\n".join(["ply", f"format binary_{'little' if order == '<' else 'big'}_endian 1.0", "element vertex 300", *head, "end_header", ""]).encode() + rows.tobytes())
    assert cli.main(["decimate", str(tmp_path / "a.ply"), str(tmp_path / "b.ply"), "40"]) == 0
    text, _, body = (tmp_path / "b.ply").read_bytes().partition(b"end_header\n")
    assert [x for x in text.decode().split("\n") if x.startswith("property")] == head and b"element vertex 40" in text
    kept = np.frombuffer(body, rows.dtype)
    assert kept.tobytes() == rows[kept["id"] - 4_000_000_000].tobytes() and len(kept) == 40 and (np.diff(kept["id"].astype(np.int64)) > 0).all()
    got = ply.option("extras", "true").load(str(tmp_path / "a.ply")).write.format("ply").mode("overwrite")
    got.save(str(tmp_path / "c.ply"))
    assert spark.read.format("ply").option("extras", "true").load(str(tmp_path / "c.ply")).count() == 300


def exif(order, taken, made):
    """A JPEG head with an EXIF block."""
    import struct

    entries, blobs = [], b""
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    n = (made is not None) + (taken is not None)
    at = 8 + 2 + 12 * n + 4
    if made is not None:
        raw = made.encode() + b"\0"
        entries.append(struct.pack(order + "HHII", 306, 2, len(raw), at))
        blobs += raw
    if taken is not None:
        entries.append(struct.pack(order + "HHII", 34665, 4, 1, at + len(blobs)))
        raw = taken.encode() + b"\0"
        blobs += struct.pack(order + "H", 1) + struct.pack(order + "HHII", 36867, 2, len(raw), at + len(blobs) + 18) + struct.pack(order + "I", 0) + raw
    tiff += struct.pack(order + "H", n) + b"".join(entries) + struct.pack(order + "I", 0) + blobs
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_picture_dates(spark, tmp_path):
    from cairn.sources import images

    files = {"a.jpg": exif("<", "2024:01:02 03:04:05", "2023:01:01 00:00:00"), "b.jpg": exif(">", None, "2023:01:01 00:00:00"), "c.jpg": exif("<", None, None), "d.jpg": b"none", "e.jpg": exif(">", "2024:01:02 03:04:05", None)[:60]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: r.datetime_raw for r in images.datetimes(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.jpg": "2024:01:02 03:04:05", "b.jpg": "2023:01:01 00:00:00", "c.jpg": None, "d.jpg": None, "e.jpg": None}
    assert str(images.datetimes(spark, f"file://{tmp_path}/a.jpg").first().taken) == "2024-01-02 03:04:05"


def test_views_and_scalebars(spark, ply, tmp_path):
    cloud(tmp_path / "reef_dec7.ply", 500)
    cli.main(["views", str(tmp_path / "reef_dec7.ply"), str(tmp_path / "out"), "--auto-orient", "--resolution", "0.1"])
    assert spark.read.parquet(f"{tmp_path}/out/reef_top").count() > 0
    (tmp_path / "t.csv").write_text("id,x,y,z,label\n1,0,0,0,target 3\n2,0,0,1,target 4\n")
    cli.main(["scalebars", str(tmp_path / "t.csv"), str(tmp_path / "bars")])
    assert spark.read.option("header", True).csv(f"{tmp_path}/bars").first().factor == "0.5"


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"id","x","y","z","label","label_conf","world_x","world_y","world_z","depth"\nb,1,2,3,coral,0.5,4,5,6,12\na,1,2,3,rock,,,,,\n')
    got = text.read_annotations(spark, f"{tmp_path}/a.csv").orderBy("pos").collect()
    assert [(r.id, r.orig_x, r.x, r.label, r.label_conf, r.other[0]) for r in got] == [("b", 1.0, 4.0, "coral", 0.5, "12"), ("a", 1.0, 1.0, "rock", None, "")]
    assert text.read_annotations(spark, f"{tmp_path}/a.csv", orig_coords_only=True).orderBy("pos").first().x == 1.0
    (tmp_path / "b.csv").write_text("p,1,2,3,coral\n")
    assert text.read_annotations(spark, f"{tmp_path}/b.csv", header=False).first().z == 3.0
    with pytest.raises(ValueError, match="label"):
        text.resolve(["id", "x", "y", "z"])
    meta = spark.createDataFrame([("b", 7, "q"), ("zz", 8, "r")], "id string, depth int, kind string")
    joined, missed = text.add_meta_data(text.read_annotations(spark, f"{tmp_path}/a.csv").drop("other"), meta)
    assert [r.meta_id for r in missed.collect()] == ["zz"]
    text.save_annotations(joined, f"{tmp_path}/out")
    saved = {r["id"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/out").collect()}
    assert saved["b"]["depth"] == "7" and saved["a"]["kind"] == "NA"


def test_cameras(spark, tmp_path):
    eye = "[[1,0,0,5],[0,1,0,6],[0,0,1,7],[0,0,0,1]]"
    (tmp_path / "c.json").write_text('{"cameras": {"k1": {"transform": %s, "center": [5, 6, 7], "path": "a/b\\\\c.jpg"}, "k2": {"transform": %s, "center": null, "path": "x"}}}' % (eye, eye))
    got = text.read_cameras(spark, f"{tmp_path}/c.json").collect()
    assert [(r.cam_id, r.cx, r.m03, r.m23, r.filename) for r in got] == [("k1", 5.0, 5.0, 7.0, "c.jpg")]
    (tmp_path / "c.xml").write_text('<d><calibration type="frame" class="initial"><f>1</f></calibration><calibration type="frame" class="adjusted"><resolution width="40" height="30"/><f>10</f><cx>1</cx><cy>-1</cy><b1>2</b1><k1>0.5</k1></calibration></d>')
    c = text.read_calibration(spark, f"{tmp_path}/c.xml")
    assert (c.fx, c.fy, c.cx, c.cy, c.k1, c.width) == (12.0, 10.0, 21.0, 14.0, 0.5, 40)
    (tmp_path / "at").mkdir()
    (tmp_path / "at" / "a.csv").write_text("cam_id,path,datetime,camdist,depth,depth_pred,depth_res\nk1,,2020,1.5,,,\nk9,p,,,,,\n")
    updated, unknown = text.load_camera_attributes(text.read_cameras(spark, f"{tmp_path}/c.json"), f"{tmp_path}/at")
    row = updated.first()
    assert unknown == 1 and row.camdist == 1.5 and row.path == "a/b\\c.jpg" and row.depth is None
    text.save_camera_attributes(updated, f"{tmp_path}/saved")
    assert spark.read.option("header", True).csv(f"{tmp_path}/saved").select(F.col("cam_id")).first()[0] == "k1"


def test_annotations_of_a_worksheet(spark):
    from cairn.sources.text import worksheet_annotations

    sheet = [["id", "x", "y", "z", "label", "note"], ["a1", 1, "2.5", 3, "coral, hard", "n"], [], [None, " "], ["a2", "0", "0", "bad", " sand "]]
    got = worksheet_annotations(spark, sheet).orderBy("pos").collect()
    assert [(r.id, r.x, r.y, r.z, r.label, list(r.other)) for r in got] == [("a1", 1.0, 2.5, 3.0, "coral, hard", ["n"]), ("a2", 0.0, 0.0, None, "sand", [None])]
    assert worksheet_annotations(spark, [["b", 1, 2, 3, "c"]], header=False).first().label == "c"
    for bad in ([], [["id", "x", "y"]]):
        with pytest.raises(ValueError):
            worksheet_annotations(spark, bad)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_seeded_places_are_an_order(n):
    from cairn.sources.ply import seeded_places

    assert sorted(seeded_places(np.arange(n), n, 1).tolist()) == list(range(n))
    if n > 60:
        assert (seeded_places(np.arange(n), n, 1) != seeded_places(np.arange(n), n, 2)).any()
        chosen = np.flatnonzero(seeded_places(np.arange(n), n, 3) < n // 2)
        assert 0.3 * n < chosen.mean() < 0.7 * n


def test_a_sample_is_the_same_however_the_file_is_cut(ply, tmp_path):
    cloud(tmp_path / "a.ply", 500)
    got = [sorted(r.point_id for r in ply.option("sample", "123").option("records", size).load(str(tmp_path / "a.ply")).collect()) for size in ("40", "1000")]
    assert len(got[0]) == 123 and got[0] == got[1]
