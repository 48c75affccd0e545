"""Replies and states that must not be asked for twice are kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files up to which a kept table may be broadcast. The planner takes a table for as large as its files, and
#: files of texts that repeat are a hundredth of their rows, which the driver would hold.
SMALL_BYTES = 16 << 10


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once and read back: a lost executor costs no second call, and the plan begins anew.

    Tables of more than ``SMALL_BYTES`` are joined by merging, unless another table is told to be broadcast to them.
    """
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    found = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if _bytes(rows.sparkSession, path) > SMALL_BYTES:
        found = found.hint("merge")
    found.kept_path = path
    return found


def _bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def discard(*frames: DataFrame) -> None:
    """Delete what ``kept`` wrote for frames that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.kept_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
