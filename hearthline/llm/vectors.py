"""Search over vectors: groups of data shards meet groups of queries, one task for each pair of groups.

Data are spread by hash over shards of about ``SHARD`` vectors, and shards and queries are
dealt to groups. A task first reads its queries, about ``HELD`` components, and then its
shards, about ``MET`` components, one after the other, each indexed as it comes and dropped
again. It keeps the best few of each query over all of its shards. So every vector is sent
once for each group of queries, every query once for each group of shards, and neither a
row nor a task grows with the table. The bests are merged by a window over one query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import blocks_for, column_set

SHARD = 4096
QUERY_BLOCK = 2048
HELD = 1 << 24
MET = 1 << 25
RETURNED = 100_000


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vector: Column) -> Column:
    """Not null, and of finite components only; an empty vector has none and is left out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


class Best:
    """The k best of each query so far: the highest scores, ties to the smaller id; equal ids with equal scores are one."""

    def __init__(self, queries: int, k: int, none: float) -> None:
        self.k, self.none = k, none
        self.scores = np.full((queries, k), none)
        self.found = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates: the query's row, the id and the score of each."""
        touched, place = np.unique(rows, return_inverse=True)
        place = np.concatenate((np.repeat(np.arange(len(touched)), self.k), place))
        names = np.concatenate((self.found[touched].ravel(), ids))
        values = np.concatenate((self.scores[touched].ravel(), scores))
        order = np.lexsort((names, -values, place))
        place, names, values = place[order], names[order], values[order]
        new = np.ones(len(order), bool)
        new[1:] = (place[1:] != place[:-1]) | (names[1:] != names[:-1]) | (values[1:] != values[:-1])
        place, names, values = place[new], names[new], values[new]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        kept = rank < self.k
        at, rank = touched[place[kept]], rank[kept]
        self.scores[touched], self.found[touched] = self.none, np.iinfo(np.int64).max
        self.scores[at, rank], self.found[at, rank] = values[kept], names[kept]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query's row, the id and the score of all that were found."""
        row, place = np.nonzero(self.scores > self.none)
        return row, self.found[row, place], self.scores[row, place]


def _once(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows without those that repeat the one before."""
    again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    again = again[(vectors[again] == vectors[again - 1]).all(axis=1)]
    return (np.delete(ids, again), np.delete(vectors, again, axis=0)) if len(again) else (ids, vectors)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shard, width, ids, vectors) of rows sorted by shard, width, id and vector; repeated rows once."""
    key, ids, vectors = (0, 0), [], []

    def whole() -> tuple[int, int, np.ndarray, np.ndarray]:
        found = _once(np.concatenate(ids), np.concatenate(vectors, dtype=np.float64))
        ids.clear()  # the rows as they came go before the next are read
        vectors.clear()
        return *key, *found

    for batch in batches:
        shard, width = batch.column("shard").to_numpy(), batch.column("width").to_numpy()
        starts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(width) != 0)) + 1
        for start, stop in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            if start == stop:
                continue
            if ids and key != (shard[start], width[start]):
                yield whole()
            key = int(shard[start]), int(width[start])
            part = batch.slice(start, stop - start)
            ids.append(part.column("id").to_numpy())
            vectors.append(part.column("vector").flatten().to_numpy().reshape(len(part), -1))
    if ids:
        yield whole()


def search(
    vectors: DataFrame, queries: Column, k: int, begin: Callable[[np.ndarray, np.ndarray], tuple],
    score_type: str, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score), the k best per query.

    ``begin`` gets the ids and vectors of a group of queries, which it may overwrite, and
    gives two functions: one takes the ids and vectors of a shard, the other gives
    ``Best.results`` over the shards so far. Vectors of different lengths are searched apart from each other.
    """
    plain = column_set(vectors, id_col, vector_col).toDF("id", "vector")
    sent = "array<float>" if plain.schema["vector"].dataType.simpleString() == "array<float>" else "array<double>"
    plain = plain.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    plain = plain.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("width", F.size("vector"))
    components = F.col("width").cast("long")
    counts = [F.count(F.lit(1)).alias("rows"), F.sum(components).alias("met"), F.sum(F.when(queries, components)).alias("asked")]
    size = plain.agg(*counts).first()
    shards, sides = blocks_for(size["rows"], SHARD), blocks_for(size["asked"] or 0, HELD)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = min(shards, max(blocks_for(size["met"] or 0, MET), blocks_for(2 * cores, sides)))

    def targets(count: int, task: Callable[[Column], Column], shard: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(numbers, lambda x: F.struct(task(x).cast("int").alias("task"), shard.alias("shard")))

    # Rows without a shard, -1, are queries and come first in their task.
    marked = plain.withColumn("own", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))
    marked = marked.withColumn("side", F.pmod(F.xxhash64("vector", "id"), F.lit(sides)))
    as_data = targets(sides, lambda x: F.col("own") % groups * sides + x, F.col("own"))
    as_query = F.when(queries, targets(groups, lambda x: x * sides + F.col("side"), F.lit(-1)))
    goes = F.explode(F.concat(as_data, F.coalesce(as_query, F.array().cast("array<struct<task:int,shard:int>>"))))
    dealt = marked.select(goes.alias("to"), "width", "id", F.col("vector").cast(sent).alias("vector"))
    dealt = dealt.select("to.task", "to.shard", "width", "id", "vector").repartitionById(groups * sides, "task")
    dealt = dealt.sortWithinPartitions("shard", "width", "id", "vector").select("shard", "width", "id", "vector")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple] = {}
        for shard, width, ids, own in _runs(batches):
            if shard < 0:
                asked[width] = ids, *begin(ids, own)
            elif width in asked:
                asked[width][1](ids, own)
        for query_ids, _, results in asked.values():
            row, ids, scores = results()
            for at in range(0, len(row), RETURNED):
                part = slice(at, at + RETURNED)
                columns = [pa.array(c[part]) for c in (query_ids[row], ids, scores)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(each, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.repartition("query_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query_blocks(count: int) -> list[np.ndarray]:
    """Rows of a group of queries in blocks of ``QUERY_BLOCK``."""
    return [np.arange(at, min(at + QUERY_BLOCK, count)) for at in range(0, count, QUERY_BLOCK)]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
