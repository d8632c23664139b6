import pytest

from cairn import session


def test_without_a_shared_folder_the_error_says_what_to_set(spark, monkeypatch):
    monkeypatch.setattr(session, "SHARED", "spark.cairn.unset")
    with pytest.raises(ValueError, match="when the session is built"):
        session.shared_dir(spark)


def test_paths_get_the_scheme_of_the_default_file_system(spark, tmp_path):
    assert session.qualified(spark, str(tmp_path)).startswith("file:/")
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.reef.link./in", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://reef/")
    try:
        assert session.qualified(spark, "/in/a") == "viewfs://reef/in/a"
    finally:
        conf.set("fs.defaultFS", before)


def test_batches_are_small_while_a_table_is_cut(spark):
    before = spark.conf.get(session.BATCH)
    with session.small_batches(spark):
        assert spark.conf.get(session.BATCH) == str(session.BATCH_BYTES)
    assert spark.conf.get(session.BATCH) == before
