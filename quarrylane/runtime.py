"""Session-level helpers: lineage cuts and tables written once in the shared folder."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is set (tests), deleted at the end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: the join is never a broadcast through the driver.

    Spark's estimate does not count what an explode, a join or a Python function adds, so a side that it
    takes for small enough can be many times larger.
    """
    return df.hint("merge")


def write_once(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read from there, so that each use reads only its columns.

    by: a column of few values whose rows go to folders of their own, so that a filter on it reads only
    these. What a session has written is deleted at the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    writer = df.write.option("compression", "lz4")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is then left to the cluster's own cleaning
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
