"""How far the sources of a language differ, by exact term shares.

A translation table lower-cases A-Z and turns every other ASCII byte into a blank in one pass,
``bytes.split`` gives the terms and one ``Counter`` per document their frequencies. Tasks sum
these to (language, source, term) counts before anything is shuffled, so a frequent term
costs a row per task and source. One exchange by (language, term) then gives both the counts per
source and the number of the language's documents that hold the term.

Shares are integers, ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``. Distances between
sources are summed over blocks of terms, each a small dense matrix in numpy that starts from
the share of a count of zero; blocks shrink as sources grow, and so many sources that their
pairs would not fit come in tiles. The result has a row per ordered pair of sources, that is
what it lists; no pairs are made per term or per document.

Null text, language and source are read as ''. Documents without terms still form groups; a
language without kept terms gives pairs at distance 0. Each row counts as a document, repeated
rows too. Further columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import chunked, texts_of
from hearthline.session import staged

MIN_DOCUMENTS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50

# How much a task holds: counts before it passes them on, cells of a block (at least, at most), rows
# of a tile. A block gives a row per pair of sources, so it has a term per source where that fits.
HELD_COUNTS = 1_000_000
BLOCK_CELLS = (1 << 15, 1 << 20)
TILE = 512
OUTPUT_ROWS = 1 << 16

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_BLANKS = bytes(b for b in range(0x80) if b not in _UPPER and b not in _LOWER)
TRANSLATION = bytes.maketrans(_UPPER + _BLANKS, _LOWER + b" " * len(_BLANKS))

COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and bytes of other characters, A-Z lower-cased."""
    return text.translate(TRANSLATION).split()


def _summed(tables: list[pa.Table]) -> pa.Table:
    together = pa.concat_tables(tables)
    sums = together.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["group", "term", "n", "docs"])


def count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTED`` from (lang, source, text); a key may come more than once."""
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def release() -> Iterator[pa.RecordBatch]:
        counts = _summed(held)
        names = list(groups)
        langs, sources = (pa.array([name[i] for name in names], pa.string()) for i in (0, 1))
        out = pa.table(
            {
                "lang": langs.take(counts["group"].combine_chunks()),
                "source": sources.take(counts["group"].combine_chunks()),
                "term": counts["term"].cast(pa.string()),
                "n": counts["n"],
                "docs": counts["docs"],
            }
        )
        yield from out.to_batches(max_chunksize=OUTPUT_ROWS)
        held.clear()
        groups.clear()

    for batch in chunked(batches, "text"):
        found: list[bytes] = []
        counts: list[int] = []
        widths, codes = [], []
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for text, key in zip(texts_of(batch, "text"), keys):
            frequencies = Counter(terms(text))
            found += frequencies
            counts += frequencies.values()
            widths.append(len(frequencies))
            codes.append(groups.setdefault(key, len(groups)))
        columns = {
            "group": pa.array(np.repeat(np.array(codes, np.int32), widths)),
            "term": pa.array(found, pa.binary()),
            "n": pa.array(counts, pa.int64()),
            "docs": pa.array(np.ones(len(found), np.int64)),
        }
        held.append(_summed([pa.table(columns)]))
        if sum(t.num_rows for t in held) > HELD_COUNTS:
            held[:] = [_summed(held)]
            if held[0].num_rows > HELD_COUNTS // 2:
                yield from release()
    if held:
        yield from release()


def share(count: Column, total: Column, vocabulary: Column) -> Column:
    """The integer share of a term; sums and products are exact decimals."""
    over = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + vocabulary.cast("decimal(20,0)") * PRIOR
    return F.call_function("div", over, under) + 1


def _distances(key: tuple, rows: pa.Table) -> pa.Table:
    """Summed differences between the sources of one tile and all later ones, over one block."""
    term = rows["term"].combine_chunks()
    zero = np.asarray(term.is_null())
    source = rows["source"].combine_chunks()
    shares = rows["p"].to_numpy()
    names = source.filter(pa.array(zero))
    names = names.take(pa.compute.sort_indices(names))
    matrix = np.zeros((len(names), 0), np.int64)
    at = np.asarray(pa.compute.index_in(source, names))
    if not zero.all():
        terms_in = term.filter(pa.array(~zero)).dictionary_encode()
        base = np.empty(len(names), np.int64)
        base[at[zero]] = shares[zero]
        matrix = np.repeat(base[:, None], len(terms_in.dictionary), axis=1)
        matrix[at[~zero], np.asarray(terms_in.indices)] = shares[~zero]
    first = key[2].as_py() * TILE
    left, right, values = [], [], []
    for i in range(first, min(first + TILE, len(names) - 1)):
        values.append(np.abs(matrix[i + 1 :] - matrix[i]).sum(axis=1))
        left.append(np.full(len(names) - 1 - i, i))
        right.append(np.arange(i + 1, len(names)))
    if not values:
        return pa.schema([("lang", pa.string()), ("left", pa.string()), ("right", pa.string()), ("value", pa.int64())]).empty_table()
    index = [pa.array(np.concatenate(side)) for side in (left, right)]
    return pa.table(
        {
            "lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(index[0])),
            "left": names.take(index[0]),
            "right": names.take(index[1]),
            "value": pa.array(np.concatenate(values)),
        }
    )


def kept_cells(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, source, n): how often a kept term occurs in a source, where it does."""
    counted = docs.mapInArrow(count_terms, COUNTED)
    sums = (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    in_language = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = sums.withColumn("in_language", in_language).where(F.col("in_language") >= min_documents)
    return kept.select("lang", "term", "source", "n")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) from documents with text, lang and source.

    Part ``pair`` ranks the other sources of the language by distance, part ``term`` the
    terms that the source uses more than its language, the first ``top`` of them.
    """
    blank = F.lit("")
    docs = docs.select(*[F.coalesce(F.col(f"`{c}`"), blank).alias(c) for c in ("lang", "source", "text")])
    cells = staged(kept_cells(docs, min_documents), "cells")
    whole = staged(cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "terms")
    per_language = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    per_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    sources = named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    zero = F.lit(0).cast("long")
    sizes = (
        named.join(per_source, ["lang", "source"], "left")
        .join(sources, "lang")
        .join(per_language, "lang", "left")
        .select(
            "lang",
            "source",
            "sources",
            *[F.coalesce(c, zero).alias(c) for c in ("total", "vocabulary", "lang_total")],
        )
    )
    least, most = (F.lit(n).cast("double") for n in BLOCK_CELLS)
    cells_of_block = F.least(most, F.greatest(least, F.pow(F.col("sources"), 2)))
    wanted = F.ceil(F.col("vocabulary") * F.col("sources") / cells_of_block)
    tiles = F.ceil(F.col("sources") / F.lit(TILE))
    sizes = staged(
        sizes.withColumn("blocks", F.greatest(F.lit(1).cast("long"), wanted)).withColumn("tiles", tiles), "sizes"
    )

    own = share(F.col("n"), F.col("total"), F.col("vocabulary"))
    valued = cells.join(sizes, ["lang", "source"]).withColumn("p", own)

    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    base = F.when(F.col("vocabulary") > 0, share(zero, F.col("total"), F.col("vocabulary"))).otherwise(zero)
    starts = sizes.select(
        "lang", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "tiles", "source",
        F.lit(None).cast("string").alias("term"), base.alias("p"),
    )
    rows = valued.select("lang", block.alias("block"), "tiles", "source", "term", "p").unionByName(starts)
    tiled = rows.select(
        "lang", "block", F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("tile"), "source", "term", "p"
    )
    partial = tiled.groupBy("lang", "block", "tile").applyInArrow(
        _distances, "lang string, left string, right string, value long"
    )
    summed = partial.groupBy("lang", "left", "right").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("left", "right"), F.struct(F.col("right").alias("left"), F.col("left").alias("right"))))
    both = summed.select("lang", "value", sides.alias("side"))
    pairs = both.select(
        "lang", F.col("side.left").alias("source"), F.lit("pair").alias("part"), F.col("side.right").alias("item"), "value"
    )

    common = share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    over = valued.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - common).where("value > 0")
    more = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), pairs AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT p.lang, p.source, k.term, k.n AS lang_n, count(w.term) AS n
  FROM pairs p JOIN kept k ON p.lang = k.lang
  LEFT JOIN words w ON w.lang = p.lang AND w.source = p.source AND w.term = k.term
  GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n) AS total FROM dense GROUP BY lang, source
), shares AS (
  SELECT d.lang, d.source, d.term, d.n,
         1 + (1000000000::HUGEINT * (d.n + 5)) // (t.total + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (d.lang_n + 5)) // (l.total + 5 * l.v) AS q
  FROM dense d JOIN totals t ON d.lang = t.lang AND d.source = t.source JOIN langs l ON d.lang = l.lang
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
  FROM pairs a JOIN pairs b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
