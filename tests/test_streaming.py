import datetime

from cairn.streaming import points as sp


def test_cell_counts_over_a_file_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(seconds=i), i / 10, i / 20, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, sp.SCHEMA)
    for k in range(2):
        df.where(f"point_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = sp.cell_counts(sp.read_points(spark, f"{tmp_path}/in"), 1.0).writeStream.outputMode("complete").format("memory").queryName("cells").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.i, r.j): r.n for r in spark.sql("SELECT * FROM cells").collect()}
    assert sum(got.values()) == 40 and got[(0, 0)] == 10


def test_windows_count_a_point_once(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i % 30, t0 + datetime.timedelta(seconds=i % 30 * 10), 0.0, 0.0, 1.0) for i in range(60)] + [(999, t0 + datetime.timedelta(hours=1), 0.0, 0.0, 1.0)]
    spark.createDataFrame(rows, sp.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = sp.windowed(sp.read_points(spark, f"{tmp_path}/in")).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.n for r in spark.sql("SELECT * FROM windows").collect()) == 30
