"""From raw documents to packed training sequences in five stages.

Each stage reads all that its predecessor kept. ``run`` writes every stage to the shared
checkpoint folder and reads it back, so an executor lost later costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import mixing, packing, shingle_join, simhash, substring, toxicity
from hearthline.llm.common import column_set, table
from hearthline.llm.components import connected_components
from hearthline.llm.queries import tokenizer_path
from hearthline.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near duplicates share 0.8 of their five-word shingles, or have SimHash fingerprints of them two bits apart at most.
SHINGLE = 5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels table, does not reject."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    A group is joined by any chain of pairs of which SimHash or the set join finds each.
    """
    classes = staged(shingle_join.near_duplicates(docs, SHINGLE), "classes")
    # The classes' mark stands for the id: SimHash sees every text, whatever ids repeat or lack.
    texts = column_set(docs, "text").select(F.xxhash64("text").alias("mark"), "text")
    prints = simhash.near_duplicates(texts, "mark", shingle=SHINGLE, distinct=True)
    return shingle_join.keep_one(docs, united(classes, prints)).select(*docs.columns)


def united(classes: DataFrame, prints: DataFrame) -> DataFrame:
    """The classes (id, mark, root), joined where marks share a component of prints (mark, component_id)."""
    both = classes.select("mark", "root").distinct().join(prints.select("mark", "component_id").distinct(), "mark")
    ends = both.groupBy("component_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    links = both.join(ends.select("component_id", "a"), "component_id").select("a", F.col("root").alias("b"))
    moved = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return classes.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that occur elsewhere too."""
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its training sequence and place there."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

# Fitting a classifier, fingerprints and tokenizing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
