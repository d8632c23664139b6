"""Session helper and the shared scratch area that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
#: Most bytes that a Python task gets in one Arrow batch while a table is cut.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def local_session(cores: int | str = 8, app: str = "cairn") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    build = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if not SparkConf().get(SHARED, None):
        build = build.config(SHARED, "file://" + tempfile.mkdtemp(prefix="cairn-"))
    return build.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    The setting is read only once a session is up, so a session without one is told
    how to get one; local_session sets a folder of its own.
    """
    found = spark.conf.get(SHARED, None)
    if not found:
        raise ValueError(f"set {SHARED} to a folder that the driver and all executors share when the session is built, as in --conf {SHARED}=hdfs:///tmp/cairn")
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority that Hadoop gives it, for libraries that have other defaults."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    return re.sub(r"^file:/(?!/)", "file:///", found)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's file systems close."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand Python at most BATCH_BYTES at once, or a row that alone is larger."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def parts(spark: SparkSession) -> int:
    """Tasks that work is dealt over which a few input files would leave in one."""
    return 4 * spark.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores: a small file is one task otherwise, whatever each of its rows is joined with."""
    return df.repartition(parts(df.sparkSession))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Ends the lineage: what follows reads a table that outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
