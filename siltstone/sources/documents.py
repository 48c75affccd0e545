"""Documents in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text`` of a table; only these two columns are read."""
    return spark.read.format(fmt).load(path).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, each a document, named by a hash of its path."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select(F.xxhash64("path").alias("doc_id"), F.col("value").alias("text"), "path")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores if they come in fewer parts, as from one small file; large inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    results.write.format(fmt).mode(mode).save(path)
