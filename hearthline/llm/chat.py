"""Chat formatting by columnar byte assembly, and reading it back.

A turn becomes ``### role: text</turn>`` and a line feed. Inside texts a backslash goes before
every backslash, every place where ``###`` starts and every ``</turn>``; in roles before
colons too. Taking each backslash out and its next character as it is undoes that.

Rows are spread by conversation and sorted in their partition. For a batch of turns, numpy
computes where escapes go, the length of every segment, their cumulative offsets, and for
each byte of role and text its place; headers and contents are copied into one buffer,
which becomes the Arrow column. A conversation larger than ``PART_BYTES`` comes in several
parts, so memory is bounded whatever its size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import chunked, column_set

OPEN, BETWEEN, CLOSE = b"### ", b": ", b"</turn>\n"
MARKS = (b"\\", b"###", b"</turn>")
PART_BYTES = 4 << 20
ROLE_OF_LOSS = "assistant"

_TURN = re.compile(rb"### ((?:[^\\:]+|\\.)*+): ((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the offsets of its values."""
    plain = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escapes(data: np.ndarray, offsets: np.ndarray, marks: Iterable[bytes]) -> np.ndarray:
    """Whether a backslash goes before each byte."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    hit = np.zeros(len(data), bool)
    for mark in marks:
        if len(data) >= len(mark):
            size = len(data) - len(mark) + 1
            here = left[:size] >= len(mark)
            for i, byte in enumerate(mark):
                here &= data[i : i + size] == byte
            hit[:size] |= here
    return hit


class _Column:
    """A column with the lengths of its escaped values and the places of its bytes in them."""

    def __init__(self, column: pa.Array, marks: Iterable[bytes]) -> None:
        self.data, offsets = _bytes(column)
        self.hit = _escapes(self.data, offsets, marks)
        before = np.concatenate(([0], np.cumsum(self.hit)))
        self.lengths = np.diff(offsets) + np.diff(before[offsets])
        own = np.repeat(np.arange(len(column)), np.diff(offsets))
        self.owner = own
        self.place = np.arange(len(self.data)) - offsets[own] + before[1:] - before[offsets[own]]

    def scatter(self, out: np.ndarray, starts: np.ndarray) -> None:
        at = starts[self.owner] + self.place
        out[at] = self.data
        out[at[self.hit] - 1] = ord("\\")


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns; the offset of each; start and length of each text in it."""
    role, text = _Column(roles, (*MARKS, b":")), _Column(texts, MARKS)
    lengths = len(OPEN) + role.lengths + len(BETWEEN) + text.lengths + len(CLOSE)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    out = np.empty(offsets[-1], np.uint8)
    role_at = offsets[:-1] + len(OPEN)
    text_at = role_at + role.lengths + len(BETWEEN)
    for fixed, at in ((OPEN, offsets[:-1]), (BETWEEN, role_at + role.lengths), (CLOSE, text_at + text.lengths)):
        out[at[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    role.scatter(out, role_at)
    text.scatter(out, text_at)
    return out, offsets, text_at, text.lengths


def _changes(ids: pa.Array) -> np.ndarray:
    """Places where a new conversation starts."""
    numbers, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
    differs = (numbers[1:] != numbers[:-1]) | (valid[1:] != valid[:-1])
    return np.concatenate(([0], np.flatnonzero(differs) + 1))


def _formatted(batch: pa.RecordBatch, first_part: int) -> pa.RecordBatch:
    out, offsets, starts, lengths = assemble(batch.column("role"), batch.column("text"))
    heads = _changes(batch.column("_id"))
    ends = np.append(heads[1:], batch.num_rows)
    cuts = np.append(offsets[heads], offsets[-1])
    text = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    learnt = np.array([r == ROLE_OF_LOSS for r in batch.column("role").to_pylist()], bool)
    within = np.repeat(offsets[heads], ends - heads)
    counts = np.concatenate(([0], np.cumsum(learnt)))
    lists = pa.array(np.append(counts[heads], counts[-1]).astype(np.int32))
    spans = [pa.ListArray.from_arrays(lists, pa.array(x[learnt])) for x in (starts - within, lengths)]
    parts = np.zeros(len(heads), np.int32)
    parts[0] = first_part
    return pa.RecordBatch.from_arrays(
        [batch.column("_id").take(pa.array(heads)), pa.array(parts), text, *spans, pa.array(ends - heads)],
        ["_id", "part", "formatted", "loss_starts", "loss_lengths", "turns"],
    )


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None
    part, going = 0, None
    for batch in chunked(batches, "text", PART_BYTES):
        if held is not None:
            batch = pa.concat_batches([held, batch])
        elif part and batch.column("_id")[0].as_py() != going.as_py():
            part = 0
        last = int(_changes(batch.column("_id"))[-1])
        if last:
            yield _formatted(batch.slice(0, last), part)
            part = 0
        held = batch.slice(last)
        if held.column("text").nbytes > PART_BYTES:
            yield _formatted(held, part)
            # The last conversation goes on in a further part, if more of it comes.
            part, going, held = part + 1, held.column("_id")[-1], None
    if held is not None and held.num_rows:
        yield _formatted(held, part)


def format_chats(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, part, formatted, loss_starts, loss_lengths, turns), parts in order within a partition.

    Needs columns turn, role and text. Turns are ordered by turn, then role and text, nulls
    first; repeated rows are repeated turns. Null roles and texts are empty; rows without
    an id form a conversation. The spans of the loss mask are bytes of ``formatted``.
    """
    rows = column_set(conversations, id_col, "turn", "role", "text").toDF("_id", "turn", "role", "text")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("_id", F.col("_id").cast("long")).repartition(parts, "_id").sortWithinPartitions("_id", "turn", "role", "text")
    kinds = "_id long, part int, formatted string, loss_starts array<long>, loss_lengths array<long>, turns long"
    return ordered.select("_id", "role", "text").mapInArrow(_format, kinds).withColumnRenamed("_id", id_col)


def plain(escaped: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", escaped) if b"\\" in escaped else escaped


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at byte {at}")
        turns.append((plain(found[1]), plain(found[2])))
        at = found.end()
    return turns


class _Digest:
    """What is read back from one conversation, part by part."""

    def __init__(self) -> None:
        self.turns, self.turn_hash = 0, hashlib.sha256()
        self.loss_chars, self.loss_hash, self.chars = 0, hashlib.sha256(), 0

    def add(self, formatted: bytes, starts: list[int], lengths: list[int]) -> None:
        for role, text in read_turns(formatted):
            self.turns += 1
            self.turn_hash.update(role + b"\n" + text + b"\n")
        for start, length in zip(starts, lengths, strict=True):
            text = plain(formatted[start : start + length])
            self.loss_chars += len(text.decode())
            self.loss_hash.update(text)
        self.chars += len(formatted.decode())


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    held: tuple[int | None, _Digest] | None = None

    def listed(done: list[tuple[int | None, _Digest]]) -> pa.RecordBatch:
        rows = [(i, d.turns, d.turn_hash.hexdigest(), d.loss_chars, d.loss_hash.hexdigest(), d.chars) for i, d in done]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    for batch in batches:
        done = []
        ids, parts = batch.column("_id").to_pylist(), batch.column("part").to_pylist()
        starts, lengths = batch.column("loss_starts").to_pylist(), batch.column("loss_lengths").to_pylist()
        for at, formatted in enumerate(batch.column("formatted").cast(pa.large_binary()).to_pylist()):
            if held is None or not parts[at]:
                if held is not None:
                    done.append(held)
                held = (ids[at], _Digest())
            held[1].add(formatted, starts[at], lengths[at])
        if done:
            yield listed(done)
    if held is not None:
        yield listed([held])


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation from the output of ``format_chats``, in the same partitions."""
    kinds = "_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    source = formatted.select(F.col(id_col).alias("_id"), "part", "formatted", "loss_starts", "loss_lengths")
    return source.mapInArrow(_read, kinds).withColumnRenamed("_id", id_col)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 4 + length(role) + 2 + length(text) + 8
    + length(role || text) - length(replace(role || text, '\', ''))
    + length(role) - length(replace(role, ':', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)), 0)
    + len(regexp_extract_all(text, '</turn>')) + len(regexp_extract_all(role, '</turn>')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
