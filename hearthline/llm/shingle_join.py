"""Near duplicates by the exact Jaccard similarity of word shingles: a prefix-filter set join.

Shingles have one order for all documents. Of two sets with a similarity of 0.8 or more the
first ones in that order, a fifth of the set and one more, share a shingle, so keying
documents by this prefix misses no pair; each candidate is then compared set by set. The
order is by weight and hash. Weights only decide how many candidates there are: shingles
that crowd the prefixes are counted and put last, the most frequent at the very end.

Documents are joined by their set of shingles, so copies never become pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.buckets import complete_links
from hearthline.llm.common import chunked, column_set, texts_of
from hearthline.llm.components import connected_components
from hearthline.llm.simhash import shingle_hashes
from hearthline.session import staged

# A similarity of 0.8: 9 * shared >= 4 * (one size + other size), in whole numbers.
BUCKET = 8
COUNTS = 3
HEAVY = 200_000

Order = tuple[np.ndarray, np.ndarray]


def _sets(batch: pa.RecordBatch, shingle: int) -> tuple[list[np.ndarray], pa.Array]:
    """Sorted shingle hashes of each text, and a key of each set."""
    sets = [np.sort(np.array(shingle_hashes(t, shingle, True), np.uint64)) for t in texts_of(batch, "_text")]
    return sets, pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def prefix(hashes: np.ndarray, order: Order) -> np.ndarray:
    """The shingles of a set of which any set with a similarity of 0.8 shares one, in order; hashes are sorted."""
    heavy, weights = order
    count = len(hashes) + (-4 * len(hashes)) // 5 + 1 if len(hashes) else 0
    if not len(heavy):
        return hashes[:count]
    at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
    weight = np.where(heavy[at] == hashes, weights[at], 0)
    return hashes[np.argsort(weight, kind="stable")[:count]]


def _prefixes(texts: DataFrame, shingle: int, order: Order) -> DataFrame:
    """(key, node, size, rest) for each prefix shingle; rest: shingles that follow in the order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            sets, nodes = _sets(batch, shingle)
            own = [prefix(s, order) for s in sets]
            counts = np.array([len(x) for x in own])
            sizes = np.repeat(np.array([len(s) for s in sets], np.int32), counts)
            first = np.repeat(np.cumsum(counts) - counts, counts)
            rest = sizes - 1 - (np.arange(len(sizes)) - first)
            keys = np.concatenate([*own, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
            columns = [pa.array(keys), pa.array(np.repeat(nodes.to_numpy(), counts)), pa.array(sizes), pa.array(rest.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "size", "rest"])

    return texts.mapInArrow(run, "key long, node long, size int, rest int")


def _shared(texts: DataFrame, shingle: int, order: Order) -> DataFrame:
    """Prefix shingles of two sets at least, with the number of rows that hold them."""
    counted = _prefixes(texts, shingle, order).groupBy("key")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    return staged(counted.where("low < high").select("key", "n"), "shared")


def _with_sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            sets, nodes = _sets(batch, shingle)
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([nodes, lists], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


def similar(a: Column, b: Column) -> Column:
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def _fits(x: Column, y: Column) -> Column:
    """Whether a pair may be similar if this key is the first that it shares; at that key, the bound holds."""
    return 9 * (1 + F.least(x["rest"], y["rest"])) >= 4 * (x["size"] + y["size"])


def links(texts: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of sets with a similarity of 0.8 or more; texts: (_text)."""
    order: Order = (np.empty(0, np.uint64), np.empty(0, np.int8))
    for _ in range(COUNTS - 1):
        shared = _shared(texts, shingle, order)
        crowding = shared.where(F.col("n") > BUCKET).orderBy(F.desc("n"), "key").limit(HEAVY).toPandas()
        keys = crowding["key"].to_numpy(np.int64).view(np.uint64)
        new = ~np.isin(keys, order[0])
        if not new.any():
            break
        heavy = np.concatenate([order[0], keys[new]])
        weights = np.concatenate([order[1], np.log2(crowding["n"].to_numpy(np.float64)[new]).astype(np.int8)])
        at = np.argsort(heavy)
        order = heavy[at], weights[at]
    else:
        shared = _shared(texts, shingle, order)
    keyed = staged(_prefixes(texts, shingle, order).join(shared.select("key"), "key").distinct(), "keyed")
    held = keyed.select("node").distinct()
    sets = staged(_with_sets(texts, shingle).join(held, "node", "left_semi").dropDuplicates(["node"]), "sets")
    side = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_set"))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").where(similar(F.col("a_set"), F.col("b_set"))).select("a", "b")

    return complete_links(keyed.select("key", F.struct("node", "size", "rest").alias("member")), verified, BUCKET, _fits)


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`"))


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, root) per row of docs; rows have one root if a chain of pairs with a similarity of 0.8 or more joins them.

    Similarity is that of the sets of word shingles, in ASCII lower case. Fewer words than a
    shingle make one shingle; texts without words (null ones too) are all alike. The mark
    is a hash of the text and tells rows with one id apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            nodes = _sets(batch, shingle)[1]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_mark"), nodes], ["_id", "_mark", "node"])

    source = column_set(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("_id"), _mark(text_col).alias("_mark"), F.col(f"`{text_col}`").alias("_text"))
    rows = staged(source.mapInArrow(run, "_id long, _mark long, node long"), "rows")
    roots = connected_components(links(source.select("_text"), shingle))
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.select(F.col("_id").alias(id_col), F.col("_mark").alias("mark"), "root")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the one with the smallest id, of several such the one with the smallest mark.

    Rows of one id and different texts are told apart, so only rows of one class replace
    each other. Rows that agree in id and text are one. Rows without an id all stay.
    """
    named = classes.where(F.col(id_col).isNotNull())
    least = F.min(F.struct(F.col(id_col).alias("_id"), F.col("mark").alias("_mark")))
    kept = named.groupBy("root").agg(least.alias("least")).select("least.*")
    # All columns of docs in one, so that none clashes with the two that are joined on.
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns])
    marked = docs.select(whole.alias("_doc"), F.col(f"`{id_col}`").alias("_id"), _mark(text_col).alias("_mark"))
    one = marked.join(kept, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"])
    return one.select("_doc.*").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
