"""Packing documents into training sequences with a grouping genetic algorithm.

Documents become token ids, an end id, and pieces of at most one sequence. Pieces that fill
a sequence are done. The others are spread by hash over blocks of about ``BLOCK`` pieces,
and each block is packed by ``ISLANDS`` islands. An island keeps a population of packings.
Crossover injects whole well-filled bins of one parent into another, drops the bins that
hold one of their pieces as well, and puts the displaced pieces back best-fit; mutation
empties the least-filled bins. After each epoch every island sends its best packing to the
next one of its block. Every island breeds; one whose packing has as few bins as its token
count allows stops after that generation. Blocks are the unit of work and recovery, of the same size for any input, so a
block wastes less than one sequence and the whole a small share.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import blocks_for, chunked, column_set, texts_of
from hearthline.session import staged

SEQUENCE = 2048
END_ID = 0
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 6
KNOWN_BYTES = 48 << 20
CHUNK_BYTES = 4 << 20
PUNCTUATION = ".,;:!?|"


class WordTokenizer:
    """Ids of whole texts, looked up word by word.

    The tokenizer drops white space and never joins characters across it, so a text's ids
    are those of its words in turn; ASCII case is dropped first, as the tokenizer drops it. Arrow
    splits a batch and numbers its distinct words, words not known are encoded together, parted by a
    special token, and numpy copies each word's ids to its places. Texts that hold a special
    token's string are encoded whole, as such a string is taken out before words are.

    Known words are one Arrow array and one array of ids. When they outgrow ``KNOWN_BYTES``, those
    that were met least often go; they are encoded again if they come again.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        special = self.model.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in special.values()]
        self.part, token = next(iter(special.items()))
        self.between = token.content
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat = np.empty(0, "<u4")
        self.ends = np.zeros(1, np.int64)
        self.met = np.empty(0, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """Ids of single words, many in one call."""
        found: list[np.ndarray] = []
        for start in range(0, len(words), 4096):
            some = words[start : start + 4096]
            ids = self._encode(self.between.join(some) + self.between)
            ends = np.flatnonzero(ids == self.part)
            own = np.split(ids, np.ravel(np.column_stack((ends, ends + 1))))[: 2 * len(some) : 2]
            assert len(ends) == len(some)
            found += own
        return found

    def _learn(self, new: list[str]) -> None:
        """Words that end in punctuation follow from the part before, as letters and signs are never joined."""
        ended = {}
        for word in new:
            core = word.rstrip(PUNCTUATION)
            if core and len(core) < len(word) and core[-1].isalpha():
                ended[word] = (core, word[len(core) :])
        parts = list(set(new).difference(ended).union(*ended.values()))
        ids = dict(zip(parts, self._encoded(parts), strict=True))
        ids.update({word: np.concatenate((ids[core], ids[tail])) for word, (core, tail) in ended.items()})
        own = [ids[w] for w in new]
        self.words = pa.concat_arrays([self.words, pa.array(new, pa.string())])
        self.flat = np.concatenate([self.flat, *own])
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(x) for x in own], dtype=np.int64)))
        self.met = np.concatenate((self.met, np.zeros(len(new), np.int64)))

    def _make_room(self) -> None:
        """Keep the half of the known words that was met most often."""
        if self.words.nbytes + self.flat.nbytes + 16 * len(self.met) <= KNOWN_BYTES:
            return
        keep = np.sort(np.argsort(-self.met, kind="stable")[: len(self.met) // 2])
        sizes = np.diff(self.ends)[keep]
        self.flat = self.flat[_spans(self.ends[:-1][keep], sizes)]
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        self.words, self.met = self.words.take(pa.array(keep)), self.met[keep]

    def _word_ids(self, texts: list[bytes]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
        found = lists.flatten().dictionary_encode()
        self._make_room()
        at = pc.index_in(found.dictionary, value_set=self.words)
        new = np.asarray(at.is_null())
        at = np.array(at.fill_null(0))
        if new.any():
            at[new] = len(self.words) + np.arange(new.sum())
            self._learn(found.dictionary.filter(pa.array(new)).to_pylist())
        places = at[np.asarray(found.indices)]
        self.met += np.bincount(places, minlength=len(self.met))
        sizes = np.diff(self.ends)[places]
        ids = self.flat[_spans(self.ends[:-1][places], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        lower = [t.lower() for t in texts]
        whole = {i for s in self.special for i, t in enumerate(lower) if s in t}
        by_word = self._word_ids([b"" if i in whole else t for i, t in enumerate(texts)])
        return [self._encode(t.decode()).tobytes() if i in whole else by_word[i] for i, t in enumerate(texts)]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after the other."""
    if not len(sizes):
        return np.empty(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(_row, id, piece, start, length, ids_crc32) for every piece; with ``ids`` as little-endian words if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, model, end = TaskContext.get().partitionId() << 33, tokenizer(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in chunked(batches, "_text", CHUNK_BYTES):
            out: dict[str, list] = {n: [] for n in ("at", "piece", "start", "length", "ids_crc32", "ids")}
            for at, ids in enumerate(model.ids(texts_of(batch, "_text"))):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                    own = ids[start : start + 4 * SEQUENCE]
                    for name, value in zip(out, (at, piece, start // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                        out[name].append(value)
            size = len(out["at"])
            columns = [pa.array(np.arange(row, row + size)), batch.column("_id").take(pa.array(out["at"], pa.int64()))]
            columns += [pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32"))]
            row += size
            names = ["_row", "_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    source = column_set(docs, id_col, text_col).toDF("_id", "_text").withColumn("_id", F.col("_id").cast("long"))
    kinds = "_row long, _id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return source.mapInArrow(run, kinds)


class Bins:
    """Open sequences by free room; the tightest that fits is found by bit arithmetic."""

    def __init__(self, bins: Iterable[list[int]], lengths: list[int]) -> None:
        self.lengths, self.bins, self.rooms, self.mask = lengths, [], [[] for _ in range(SEQUENCE + 1)], 0
        for items in bins:
            self._keep(items, SEQUENCE - sum(lengths[i] for i in items))

    def _keep(self, items: list[int], room: int) -> None:
        self.rooms[room].append(len(self.bins))
        self.mask |= 1 << room
        self.bins.append(items)

    def place(self, item: int) -> None:
        length = self.lengths[item]
        fitting = self.mask >> length
        if not fitting:
            self._keep([item], SEQUENCE - length)
            return
        room = length + (fitting & -fitting).bit_length() - 1
        at = self.rooms[room].pop()
        if not self.rooms[room]:
            self.mask ^= 1 << room
        self.bins[at].append(item)
        self.rooms[room - length].append(at)
        self.mask |= 1 << room - length


def best_fit(items: Iterable[int], lengths: list[int], bins: Iterable[list[int]] = ()) -> list[list[int]]:
    """Items, longest first, into the fullest bin with room, else a new one."""
    open_bins = Bins(bins, lengths)
    for item in sorted(items, key=lambda i: -lengths[i]):
        open_bins.place(item)
    return open_bins.bins


def _fill(items: list[int], lengths: list[int]) -> int:
    return sum(lengths[i] for i in items)


def fitness(bins: list[list[int]], lengths: list[int]) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly, which leaves room that can be used."""
    return -len(bins), sum(_fill(b, lengths) ** 2 for b in bins)


def crossover(one: list[list[int]], other: list[list[int]], lengths: list[int], rng: random.Random) -> list[list[int]]:
    """``one`` with a few well-filled bins of ``other``."""
    count = max(1, len(other) // rng.choice((4, 8, 16)))
    fullest = sorted(other, key=lambda b: -_fill(b, lengths))[: 2 * count]
    injected = rng.sample(fullest, min(count, len(fullest)))
    inside = {i for b in injected for i in b}
    kept, displaced = [], []
    for items in one:
        if inside.isdisjoint(items):
            kept.append(list(items))
        else:
            displaced += [i for i in items if i not in inside]
    return best_fit(displaced, lengths, [*(list(b) for b in injected), *kept])


def mutated(bins: list[list[int]], lengths: list[int], rng: random.Random) -> list[list[int]]:
    """Without some of the least-filled bins, whose pieces are put back."""
    order = sorted(bins, key=lambda b: _fill(b, lengths))
    gone = rng.randint(2, max(2, len(order) // 20))
    full = order[gone:]
    if full:
        gone_too = rng.sample(full, min(len(full), gone))
        chosen = {id(b) for b in gone_too}
        full = [b for b in full if id(b) not in chosen]
    else:
        gone_too = []
    return best_fit([i for b in [*order[:gone], *gone_too] for i in b], lengths, [list(b) for b in full])


def evolve(lengths: list[int], seeds: list[list[list[int]]], seed: int, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing after some generations that start from the seeds."""
    rng = random.Random(seed)
    least = -(-sum(lengths) // SEQUENCE)
    population = [*seeds, best_fit(range(len(lengths)), lengths)] if not seeds else list(seeds)
    while len(population) < POPULATION:
        population.append(mutated(rng.choice(population), lengths, rng))
    for number in range(generations):
        population.sort(key=lambda b: fitness(b, lengths), reverse=True)
        if number and len(population[0]) <= least:
            break
        parents = population[: POPULATION // 2]
        children = [crossover(*rng.sample(parents, 2), lengths, rng) for _ in range(POPULATION - len(parents) - 1)]
        population = [*parents, *children, mutated(population[0], lengths, rng)]
    return max(population, key=lambda b: fitness(b, lengths))


def _listed(assignment: Iterable[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for item, number in enumerate(assignment):
        bins.setdefault(int(number), []).append(item)
    return list(bins.values())


def _assigned(bins: list[list[int]], size: int) -> np.ndarray:
    out = np.empty(size, np.int32)
    for number, items in enumerate(bins):
        out[items] = number
    return out


def _epoch(number: int):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = []
            for row in frame.itertuples(index=False):
                lengths = [int(x) for x in row.lengths]
                seeds = [_listed(x) for x in (row.elite, row.guest) if x is not None]
                best.append(_assigned(evolve(lengths, seeds, row.block * 1009 + row.island * 31 + number), len(lengths)))
            frame = frame.assign(elite=best, bins=[int(b.max()) + 1 for b in best])
            yield frame[["block", "island", "rows", "lengths", "elite", "bins"]]

    return run


def _offsets(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            order = np.argsort(row.elite, kind="stable")
            lengths, numbers = np.asarray(row.lengths)[order].astype(np.int64), np.asarray(row.elite)[order].astype(np.int64)
            ends = np.cumsum(lengths)
            first = np.flatnonzero(np.diff(numbers, prepend=-1))
            base = np.repeat((ends - lengths)[first], np.diff(np.append(first, len(numbers))))
            yield pd.DataFrame({"_row": np.asarray(row.rows)[order], "sequence_id": (row.block << 20) + numbers, "offset": ends - lengths - base})


def place(lengths: DataFrame) -> DataFrame:
    """(_row, sequence_id, offset) from (_row, length), which is read more than once; lengths up to ``SEQUENCE``."""
    full = lengths.where(F.col("length") >= SEQUENCE).select("_row", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = lengths.where(F.col("length") < SEQUENCE)
    count = blocks_for(rest.count(), BLOCK)
    spark = lengths.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # The order makes the packing the same however the rows arrive.
    gathered = rest.groupBy(F.pmod(F.xxhash64("_row"), F.lit(count)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("length"), "_row")), asc=False).alias("own")
    )
    state = gathered.select(
        "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.col("own._row").alias("rows"), F.col("own.length").alias("lengths"),
        F.lit(None).cast("array<int>").alias("elite"), F.lit(None).cast("array<int>").alias("guest"),
    ).repartition(parts, "block", "island")
    kinds = "block long, island int, rows array<long>, lengths array<int>, elite array<int>, bins int"
    for number in range(EPOCHS):
        if number:
            sent = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
            state = state.join(sent, ["block", "island"])
        state = staged(state.mapInPandas(_epoch(number), kinds), "islands")
    best = state.groupBy("block").agg(
        F.min_by(F.struct("rows", "lengths", "elite"), F.struct("bins", "island")).alias("best")
    ).select("block", "best.*")
    return full.unionByName(best.mapInPandas(_offsets, "_row long, sequence_id long, offset long"))


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    Null and empty texts are one end id. A repeated row is packed as often as it occurs.
    """
    cut = staged(pieces(docs, tokenizer_path, id_col, text_col, keep_ids), "pieces")
    return cut.join(place(cut.select("_row", "length")), "_row").drop("_row").withColumnRenamed("_id", id_col)
