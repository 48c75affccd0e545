"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import oracles
from siltstone.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siltstone.llm import bpe

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import decontam

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.match(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort("matches.items")
    return found.select(
        "doc_id",
        "matches.n_words",
        decontam.hit_words().alias("n_hit"),
        F.size("matches.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches.items") >= 2).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines, whether it stays, and a digest of the text that is left (of '' for null)."""
    from siltstone.llm import line_dedup

    found = line_dedup.remove_runs(table(spark, sf_dir, "documents"))
    left = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.length(left).cast("long").alias("n_chars"), "removed_lines", "kept", F.sha2(left, 256).alias("text_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import ann

    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siltstone.llm import token_store

    stored = token_store.store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.digests(stored)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import license

    found = license.scan(table(spark, sf_dir, "documents"))
    start = lambda x: x["start"]
    labels = lambda *runs: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(r)["label"] for r in runs)))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", start)).alias("first_word"),
        F.array_max(F.transform("base", start)).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "accepted").alias("labels"),
        F.when(F.exists("accepted", lambda x: x["whole"]), 1.0).when(F.size("accepted") > 0, 0.75).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm import secrets

    found, _, _ = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(rule.kind) for rule in secrets.BASE),
        F.sha2(secrets.rendered(base), 256).alias("base_sha256"),
        secrets.rendered(F.col("findings")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_main_text": op3_main_text,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest": op7_nearest,
    "op8_token_store": op8_token_store,
    "op9_licenses": op9_licenses,
    "op10_secrets": op10_secrets,
}
ORACLE_SQL: dict[str, str] = oracles.every()
