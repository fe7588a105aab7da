"""Exact removal of repeated passages: seed and extend.

1. Seeds. Words are hashed, and each window of ``WINDOW`` words is represented by its
   winnowed anchor: the ``GRAM``-gram with the smallest hash among those inside. The choice
   depends on the window's words alone, so equal windows have equal anchors at equal
   offsets. About 7 % of all positions are anchors.
2. Join. Anchors that occur once are done. The others are grouped with the extension they
   answer for: all words of all windows that chose them.
3. Extend. Occurrences whose whole extension agrees with another's are repeats throughout;
   any number of copies costs one row each. Where an extension occurs once, the passage
   ends inside it, and the windows of that occurrence and of one representative of each
   other extension are compared one by one.
4. The windows found are merged into maximal stretches and cut from their documents.

No pair of occurrences is ever formed, and anchors, extensions and windows are counted by
aggregates that combine on the map side; the joins that follow can be split when skewed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import chunked, columns_besides, texts_of
from hearthline.session import staged

WINDOW = 35
GRAM = 8
PIECE = 1 << 20

_rng = np.random.default_rng(35)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_STEP, n)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _power(_BACK, len(self.sums))[starts]
        return _mixed(raw + (ends - starts).astype(np.uint64))


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, one blank after each; start and end of each word; words per text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = _SPACE[data]
    before = np.concatenate(([True], blank[:-1]))
    starts, ends = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.diff(np.searchsorted(starts, edges))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for at in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // PIECE)) + 1):
        if len(at):
            low = starts[at[0]]
            rolling = Rolling(_BYTE[data[low : ends[at[-1]]]])
            out[at] = rolling.of(starts[at] - low, ends[at] - low)
    return out


def anchor_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: document, start within it, length, anchor and extension hash."""
    grams_in = WINDOW - GRAM + 1
    total = len(words)
    if total < WINDOW:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    rolling = Rolling(words)
    at = np.arange(total - GRAM + 1)
    grams = rolling.of(at, at + GRAM)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    starts = np.flatnonzero(owner[: total - WINDOW + 1] == owner[WINDOW - 1 :])
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    anchor = starts + np.lib.stride_tricks.sliding_window_view(grams, grams_in).argmin(axis=1)[starts]
    head = np.flatnonzero(np.diff(anchor, prepend=-1))
    low, lengths = starts[head], np.diff(np.append(head, len(starts)))
    span = rolling.of(low, low + lengths - 1 + WINDOW)
    place = ((anchor[head] - low) << 8 | lengths).astype(np.uint64)
    return owner[low], low - first[owner[low]], lengths, grams[anchor[head]], _mixed(span ^ _mixed(place))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        data, starts, ends, counts = word_bounds(texts_of(batch, "_text"))
        doc, low, lengths, anchor, extension = anchor_runs(word_hashes(data, starts, ends), counts)
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [_signed(anchor), _signed(extension), batch.column("_id").take(rows), batch.column("_mark").take(rows), pa.array(low << 8 | lengths)],
            ["anchor", "extension", "_id", "_mark", "place"],
        )


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of the runs asked for."""
    for batch in chunked(batches, "_text"):
        data, starts, ends, counts = word_bounds(texts_of(batch, "_text"))
        rolling = Rolling(word_hashes(data, starts, ends))
        runs = batch.column("runs")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(runs.offsets)))
        flat = runs.flatten()
        places, anchors = flat.field("place").to_numpy(), flat.field("anchor").to_numpy()
        low, lengths = places >> 8, places & 255
        doc, anchors, low = (np.repeat(x, lengths) for x in (doc, anchors, low))
        start = low + np.arange(len(low)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = start + (np.cumsum(counts) - counts)[doc]
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors), _signed(rolling.of(place, place + WINDOW)), batch.column("_id").take(rows), batch.column("_mark").take(rows), pa.array(start << 8 | 1)],
            ["anchor", "window", "_id", "_mark", "place"],
        )


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[bytes, int]:
    """The text without the words of the windows at these places, and their number."""
    change = np.zeros(len(starts) + 1, np.int64)
    low, lengths = places >> 8, places & 255
    np.add.at(change, low, 1)
    np.add.at(change, low + lengths - 1 + WINDOW, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.diff(gone.astype(np.int8), prepend=1, append=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1) - 1
    return b" ".join(text[starts[i] : ends[j]] for i, j in zip(first, last, strict=True)), int(gone.sum())


def _cut_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunked(batches, "_text"):
        texts = texts_of(batch, "_text")
        _, starts, ends, counts = word_bounds(texts)
        first = np.cumsum(counts) - counts
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        removed = [0] * len(texts)
        for i, places in enumerate(batch.column("places")):
            if places.is_valid:
                own = slice(first[i], first[i] + counts[i])
                texts[i], removed[i] = cut(texts[i], starts[own] - edges[i], ends[own] - edges[i], places.values.to_numpy())
        valid = batch.column("_text").is_valid().to_pylist()
        columns = {name: batch.column(name) for name in batch.schema.names if name not in ("_text", "places")}
        columns["_text"] = pa.array([t.decode() if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
        columns |= {"_n_words": pa.array(counts), "_n_removed": pa.array(removed, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def _key(id_col: str, text_col: str) -> dict[str, Column]:
    """An id may be null or repeated; rows that agree in both columns get the same cuts."""
    named = F.col(f"`{id_col}`").cast("long")
    return {
        "_id": F.coalesce(named, F.lit(0).cast("long")),
        "_mark": F.xxhash64(F.col(f"`{text_col}`"), named.isNull()),
        "_text": F.col(f"`{text_col}`"),
    }


def repeated_places(keyed: DataFrame) -> DataFrame:
    """(_id, _mark, places) of all documents with repeated windows; place: start * 256 + number of windows."""
    source = keyed.select("_id", "_mark", "_text")
    seeds = source.mapInArrow(_seeds, "anchor long, extension long, _id long, _mark long, place long")
    again = staged(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    hits = staged(seeds.join(again, "anchor"), "hits")
    extensions = staged(
        hits.groupBy("anchor", "extension").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_mark", "place")).alias("at")
        ),
        "extensions",
    )
    whole = hits.join(extensions.where("n > 1").select("anchor", "extension"), ["anchor", "extension"])
    mixed = extensions.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    runs = (
        extensions.join(mixed, "anchor")
        .groupBy(F.col("at._id").alias("_id"), F.col("at._mark").alias("_mark"))
        .agg(F.collect_list(F.struct("anchor", "at.place")).alias("runs"))
    )
    windows = source.join(runs, ["_id", "_mark"]).mapInArrow(
        _windows, "anchor long, window long, _id long, _mark long, place long"
    )
    equal = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window")
    found = windows.join(equal, ["anchor", "window"])
    places = whole.select("_id", "_mark", "place").unionByName(found.select("_id", "_mark", "place"))
    return places.groupBy("_id", "_mark").agg(F.collect_set("place").alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, their text without repeated words, with ``n_words`` (before) and ``n_removed``.

    A word goes if a window of 35 words that covers it also starts elsewhere, in this
    document or another. Columns of docs named like the two counts give way to them. A repeated row repeats all its windows. Texts that lose nothing
    stay as they are, byte for byte; from others the pieces that remain are joined by a
    blank. Null stays null, with no words; texts below 35 words never change.
    """
    others = [n for n in docs.columns if n != text_col]
    numbered = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(others)], *[c.alias(n) for n, c in _key(id_col, text_col).items()])
    joined = numbered.join(repeated_places(numbered), ["_id", "_mark"], "left").drop("_id", "_mark")
    kinds = ", ".join(f"c{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(others))
    done = joined.mapInArrow(_cut_all, f"{kinds}, _text string, _n_words long, _n_removed long")
    named = {n: F.col(f"c{i}") for i, n in enumerate(others)} | {text_col: F.col("_text")}
    return done.select(
        *[named[n].alias(n) for n in columns_besides(docs, "n_words", "n_removed")], F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed")
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT id, unnest(range(1, len(w) - 33)) AS i,
         unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS window_key
  FROM docs WHERE len(w) >= 35
), repeated AS (
  SELECT id, i FROM windows WHERE window_key IN (SELECT window_key FROM windows GROUP BY 1 HAVING count(*) > 1)
), gone AS (
  SELECT id, list(place) AS places FROM (SELECT DISTINCT id, unnest(range(i, i + 35)) AS place FROM repeated) GROUP BY id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(places, []), i)), ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (id)
"""
