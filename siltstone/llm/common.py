"""What the operators share: tables, the shared folder, and the Arrow batches that Python stages get."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Documents can be long, so a batch is kept small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer parts than there are cores, as from one small file, are dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; a smaller setting of the caller stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary
    folder; on a cluster a missing setting is an error, since local folders are not shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub(r'[^a-z0-9]+', '-', name)}-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    found = spark.read.schema(df.schema).format(fmt).load(path)
    found.written_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote for frames that nothing reads any more."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.written_path)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a session: executors need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="siltstone-code-")) / "siltstone.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def _released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Workers live on between tasks; what a task has freed goes back to the system when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(_released(fn), schema)


def crc_fold(column: str, folds: int):
    """The fold of a row: crc32 of an id's decimal text."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


def gathered(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their column ``text`` has ``size`` bytes."""
    held, bytes_held = [], 0
    for batch in batches:
        held.append(batch)
        bytes_held += batch.column(text).nbytes
        if bytes_held >= size:
            yield pa.concat_batches(held)
            held, bytes_held = [], 0
    if held:
        yield pa.concat_batches(held)
