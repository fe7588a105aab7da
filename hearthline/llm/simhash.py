"""SimHash near-duplicate detection.

Fingerprint: bit b is 1 if it is set in over half of the hashes of a document's word
shingles. Two ways of finding close fingerprints:

* ``exact_links`` (64 bits, two differing bits): four blocks of 16 bits; two differing
  bits leave two blocks alone, so close pairs share one of six block pairs. Buckets of up
  to ``BUCKET`` fingerprints are compared in pairs. Members of larger ones are keyed by
  every point within one bit of them: fingerprints that share such a point are at most two
  bits apart, and any two that close do share one. So a bucket of any size costs 65 rows a
  member, and no link is lost.
* ``wide_links`` (several 64-bit words): at a shingle similarity of 0.8 some 15 % of all
  bits differ, where no partition into blocks of useful width is certain to leave one
  alone. ``TABLES`` blocks of ``KEY_BITS`` bits, drawn from the wide fingerprint, make
  sharing one likely; distances are then verified. Buckets above ``WIDE_BUCKET`` lose no
  pair that could join two components (``buckets``).

Documents are joined by fingerprint, so copies never become pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.buckets import complete_links
from hearthline.llm.common import chunked, column_set, texts_of
from hearthline.llm.components import connected_components
from hearthline.session import staged

SEED = 42
BUCKET = 16
WIDE_BUCKET = 8
DISTANCE = 2
BLOCKS = 4
TABLES = 96
KEY_BITS = 24
ROWS = 1 << 14


def shingle_hashes(text: bytes, size: int, distinct: bool) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    shingles: Iterable[bytes] = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    if distinct:
        shingles = set(shingles)
    digest = xxhash.xxh64_intdigest
    return [digest(x, SEED) for x in shingles]


def _widened(hashes: np.ndarray, word: int) -> np.ndarray:
    """Word 0 is the hash itself; the others are mixed from it."""
    if not word:
        return hashes
    x = (hashes + np.uint64(word)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def majorities(hashes: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Per document, its fingerprint as ``words`` unsigned words; counts: hashes per document."""
    sums = np.zeros((len(counts), 64 * words), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for start in range(0, len(hashes), ROWS):
        part, own = hashes[start : start + ROWS], owner[start : start + ROWS]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        for word in range(words):
            bits = np.unpackbits(_widened(part, word).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[own[first], 64 * word : 64 * word + 64] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8")


def _print_columns(words: int) -> list[str]:
    return [f"f{i}" for i in range(words)]


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, distinct: bool = False
) -> DataFrame:
    """(id, f0, f1, ...) per row: the fingerprint's 64-bit words, as signed longs.

    Fewer words than a shingle make one shingle; none (null and empty texts too) make zero.
    """
    names = _print_columns(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            lists = [shingle_hashes(t, shingle, distinct) for t in texts_of(batch, "_text")]
            counts = np.array([len(x) for x in lists])
            flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
            prints = majorities(flat, counts, words).view("<i8")
            columns = [pa.array(np.ascontiguousarray(prints[:, i])) for i in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["_id", *names])

    source = column_set(docs, id_col, text_col).toDF("_id", "_text").withColumn("_id", F.col("_id").cast("long"))
    return source.mapInArrow(run, "_id long, " + ", ".join(f"{n} long" for n in names))


def _pairs_within(keyed: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """From (key, node): the pairs (a, b) of small buckets, and the rows of larger ones."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    lists = (
        keyed.join(sizes.where(F.col("n").between(2, bucket)), "key")
        .groupBy("key")
        .agg(F.collect_list("node").alias("nodes"))
    )
    pairs = lists.select("nodes", F.explode("nodes").alias("a")).select("a", F.explode("nodes").alias("b")).where("a < b")
    return pairs, keyed.join(sizes.where(F.col("n") > bucket), "key").select("key", "node")


def _block_keys() -> Column:
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("node", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    return F.array(
        *[
            F.shiftleft(block[i], width).bitwiseOR(block[j]).bitwiseOR(F.lit(number << 2 * width))
            for number, (i, j) in enumerate(combinations(range(BLOCKS), 2))
        ]
    )


def exact_links(nodes: DataFrame) -> DataFrame:
    """All of (a, b) needed to join fingerprints with at most two differing bits; nodes: (node)."""
    keyed = nodes.select("node", F.explode(_block_keys()).alias("key"))
    pairs, crowded = _pairs_within(keyed, BUCKET)
    close = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    flips = [F.col("node").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)]
    points = crowded.select("node").distinct().select("node", F.explode(F.array(F.col("node"), *flips)).alias("point"))
    points = staged(points, "points")
    first = points.groupBy("point").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = points.join(first, "point").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    return close.unionByName(stars)


def wide_links(nodes: DataFrame, words: int, distance: int) -> DataFrame:
    """Links (a, b) between wide fingerprints that share a block and differ in ``distance`` bits at most."""
    names = _print_columns(words)
    rng = np.random.default_rng(SEED)
    chosen = np.concatenate([rng.permutation(64 * words)[:KEY_BITS] for _ in range(TABLES)])

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(KEY_BITS)).astype(np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                prints = np.stack([batch.column(n).to_numpy() for n in names], axis=1).astype("<i8")
                bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
                key = bits[:, chosen].reshape(len(prints), TABLES, KEY_BITS).astype(np.int64) @ weights
                key += np.arange(TABLES) << KEY_BITS
                node = np.repeat(batch.column("node").to_numpy(), TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key.ravel().astype(np.int32))], ["node", "key"])

    keyed = nodes.select("node", *names).mapInArrow(keys, "node long, key int")
    keyed = staged(keyed, "keys")
    side = lambda end: nodes.select(F.col("node").alias(end), F.struct(*names).alias(f"{end}_print"))
    apart = sum((F.bit_count(F.col(f"a_print.{n}").bitwiseXOR(F.col(f"b_print.{n}"))) for n in names), F.lit(0))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= distance).select("a", "b")

    return complete_links(keyed.select("key", F.struct("node").alias("member")), verified, WIDE_BUCKET)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    words: int = 1,
    distance: int = DISTANCE,
    distinct: bool = False,
) -> DataFrame:
    """(id, f0, ..., component_id) per row of docs; the component is the smallest id reachable over links.

    With ``words`` = 1 the distance must be 2 and the links are complete. Repeated rows keep
    one row each and share a component. A null id takes no part in choosing the smallest; a
    component with null ids only is null. An empty table gives none.
    """
    if words == 1 and distance != DISTANCE:
        raise ValueError("64-bit fingerprints link at two differing bits")
    names = _print_columns(words)
    node = F.col("f0") if words == 1 else F.xxhash64(*names)
    prints = staged(fingerprints(docs, id_col, text_col, shingle, words, distinct).withColumn("node", node), "prints")
    nodes = prints.groupBy("node").agg(F.min("_id").alias("least"), *([F.first(n).alias(n) for n in names] if words > 1 else []))
    nodes = staged(nodes, "nodes")
    links = exact_links(nodes.select("node")) if words == 1 else wide_links(nodes, words, distance)
    roots = connected_components(links)
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("node", "component_id")
    return prints.join(classes, "node").select(F.col("_id").alias(id_col), *names, "component_id")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each component: the one whose id it is.

    An id names one document, so of rows with the same id one stays. Rows without an id
    cannot be told apart and all stay.
    """
    kept = classes.where(F.col("component_id") == F.col(id_col)).select(id_col).distinct()
    named = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
