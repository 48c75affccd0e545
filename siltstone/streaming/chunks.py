"""Documents as a stream: chunks as they come, and counts by time for late ones.

Chunking keeps no state, so a stream of documents is chunked by the same plan as a table. Chunks of a
document that comes twice within the watermark are dropped once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.chunking import MAX_CHARS, chunk


def stream_chunks(documents: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Chunks of a streaming ``documents (doc_id, text)``."""
    return chunk(documents, max_chars)


def first_versions(documents: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """One row for each document and text that comes within ``late``."""
    marked = documents.withColumn("version", F.xxhash64("doc_id", "text")).withWatermark(time, late)
    return marked.dropDuplicatesWithinWatermark(["doc_id", "version"]).drop("version")


def chunk_counts(documents: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour", max_chars: int = MAX_CHARS) -> DataFrame:
    """``start, end, documents, characters`` by window of time; windows close when the watermark passes."""
    counted = documents.withColumn("characters", F.length("text")).withWatermark(time, late)
    return counted.groupBy(F.window(time, window)).agg(F.count("*").alias("documents"), F.sum("characters").alias("characters")).select("window.start", "window.end", "documents", "characters")
