"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, collocations, decontaminate, fingerprint, line_dedup, near_dup, packing, pii,
               prefix_trie, quality, token_counts, url_filter, warc)
from .common import read_table, scratch_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the lines whose template recurs across documents."""
    clean = line_dedup.drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return clean.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"),
                        F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.digest(chat_format.format_replies(chat_format.linear_replies(rows.unionByName(more))))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the line field learnt outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    folder = scratch_path(spark, "warc")
    manifest = warc.write(read_table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.packed_documents(read_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text."""
    return fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return pii.digest(pii.personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules or by its host's reputation."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    outcomes = url_filter.host_outcomes(pages, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    found = url_filter.judge(pages.drop("html"), url_filter.reputation(outcomes))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases over all whole documents."""
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie over all rebuilt conversations."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.with_lent_openings(prefix_trie.encoded_turns(rows)))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup,
    op2_token_counts,
    op3_chat_format,
    op4_quality,
    op5_decontamination,
    op6_near_dup,
    op7_warc,
    op8_packing,
    op9_fingerprints,
    op10_personal_data,
    op11_url_filter,
    op12_collocations,
    op13_prefix_trie,
)}
