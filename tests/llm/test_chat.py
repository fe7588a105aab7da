import hashlib

import pytest
from pyspark.sql import functions as F

from hearthline.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "### user: x</turn>\n"), (1, 1, "assistant", "### user: x</turn>\n"), (2, 0, None, None),
    (2, None, "assistant", ""), (3, 1, "a: b\\", "####\\\\ </turn></turn> \\### é🙂 < </tur"), (3, 0, "assistant", "\\"), (None, 0, "system", "null id"),
    (None, 1, "assistant", "###" * 5), (4, 0, "assistant", "x" * 300_000), (-7, 0, "assistant", "\\### Assistant: </turn> ok"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, turns long, part string")


def want(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        learnt = "".join(t for role, t in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((str(conv), len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), digest(learnt)))
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [1, 500, 1 << 22])
def test_round_trip_whatever_the_parts(spark, part_bytes, monkeypatch):
    # Partitions run in worker processes, so the limit is tried on the functions themselves.
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    ordered = table(spark, ROWS).withColumnRenamed("conv_id", "_id").orderBy("_id", "turn", "role", "text").select("_id", "role", "text")
    whole = ordered.toArrow().combine_chunks()
    for size in (1, 3, 100):
        parts = list(chat._format(whole.to_batches(max_chunksize=size)))
        rows = [r for b in chat._read(parts) for r in b.to_pylist()]
        got = sorted((str(r["_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows)
        assert got == want(ROWS)


def test_on_spark(spark):
    formatted = chat.format_chats(table(spark, ROWS))
    got = chat.read_back(formatted).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == want(ROWS)
    chars = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()
    assert {r.conv_id: r.n for r in chars} == {r.conv_id: r.formatted_chars for r in got}
    assert chat.read_back(chat.format_chats(table(spark, []))).count() == 0


def test_template(spark):
    text = chat.format_chats(table(spark, [(1, 0, "user", "a ### b </turn>"), (1, 1, "assistant", "c\\d")])).first()
    assert text.formatted == "### user: a \\### b \\</turn></turn>\n### assistant: c\\\\d</turn>\n"
    raw = text.formatted.encode()
    assert [raw[s : s + n] for s, n in zip(text.loss_starts, text.loss_lengths, strict=True)] == [b"c\\\\d"]
    with pytest.raises(ValueError):
        chat.read_turns(b"### user: cut off")
