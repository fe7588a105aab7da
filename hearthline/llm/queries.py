"""The dealt operators as named queries, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import chat, cover_tree, divergence, labeller, merkle, mixing, packing, quality_rules, simhash, site_quality, substring, toxicity, vantage
from hearthline.llm.common import column_set, table, unsigned_hex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the package that ships them knows it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", unsigned_hex(F.col("f0")).alias("fingerprint"), "component_id")


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document, words removed as repeats, and the digest of the rest."""
    cut = substring.remove_repeats(column_set(table(spark, folder, "documents"), "doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mixture takes of every document, with its source's target."""
    docs = column_set(table(spark, folder, "documents"), "doc_id", "text", "source")
    return mixing.mixture(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


ORACLE_SQL["op6_mixing"] = mixing.ORACLE


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return packing.packed(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op1_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest integer products for every hundredth vector."""
    return cover_tree.top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@query
def op9_vantage_point(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty near neighbours of every twentieth vector."""
    return vantage.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query
def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    rows = column_set(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    # Control strings inside texts, which no table need hold.
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


ORACLE_SQL["op5_chat_formatting"] = chat.ORACLE


@query
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = labeller.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = column_set(table(spark, folder, "documents"), "doc_id", "text")
    found = toxicity.scored(docs, table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of ``corpus_pipeline``, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query
def op7_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; its source stands for the host, its language for the path."""
    docs = column_set(table(spark, folder, "documents"), "doc_id", "text", "source", "lang")
    return site_quality.scored(docs, table(spark, folder, "labels"), F.col("source"), F.col("lang"))


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the sources of each language, and the terms each source overuses."""
    return divergence.audit(column_set(table(spark, folder, "documents"), "text", "lang", "source"))


@query
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, and whether it is kept."""
    docs = column_set(table(spark, folder, "documents"), "doc_id", "text", "lang")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules.judged(docs, carried=["doc_id"]).select("doc_id", *counts, "base_failed", "kept")


ORACLE_SQL["op12_quality_rules"] = quality_rules.ORACLE


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root its checked row leads to."""
    leaves = merkle.document_leaves(table(spark, folder, "documents"))
    found = merkle.manifest(leaves).withColumnsRenamed({"id": "doc_id", "proof": "proof_sha256"})
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL["op13_merkle_manifest"] = merkle.ORACLE
ORACLE_SQL["op11_source_divergence"] = divergence.ORACLE
ORACLE_SQL["op1_cover_tree"] = cover_tree.ORACLE
ORACLE_SQL["op10_substring_dedup"] = substring.ORACLE
