import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from hearthline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    """The audit from (lang, source, text) by dictionaries over every kept term."""
    rows = [tuple(v or "" for v in row) for row in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(FOLD))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        counts[lang,].update(found)
    out = []

    def shares(key, kept):
        total = sum(counts[key][t] for t in kept)
        return {t: 1 + 10**9 * (counts[key][t] + 5) // (total + 5 * len(kept)) for t in kept}

    for lang in {row[0] for row in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = {s for g, s in {row[:2] for row in rows} if g == lang}
        q = shares((lang,), kept)
        p = {s: shares((lang, s), kept) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, ranked, limit in (("pair", pairs, None), ("term", over, top)):
                ranked.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[:limit])]
    return sorted(out)


def found(docs, **options):
    columns = ("lang", "source", "part", "item", "value", "rank")
    return sorted(tuple(r[c] for c in columns) for r in divergence.audit(docs, **options).collect())


def rows_of(prose):
    texts = [prose(30 + i % 40, i % 23) for i in range(120)] + ["Été ÉTÉ été l'été 12x3 <ß>\x7fKA", "", None, "  \n"]
    langs, sources = ["en", "de", None, ""], ["a", "b", None, "é", "zz"]
    return [(langs[i % 7 % 4], sources[i % 11 % 5], t) for i, t in enumerate(texts * 2)] + [("fr", "only", "a b"), ("xx", "a", None), ("xx", "b", "")]


def test_against_dictionaries(spark, prose):
    rows = rows_of(prose)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for least, top in ((3, 5), (30, 50), (1, 2), (1000, 50)):
        assert found(docs, min_documents=least, top=top) == brute(rows, least, top)


def test_many_blocks_and_tiles(spark, prose, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", (40, 400))
    rows = rows_of(prose)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(docs, min_documents=3) == brute(rows, 3, 50)
    names = [("en", f"s{i:04}", f"ab cd{i % 3}") for i in range(divergence.TILE + 40)]
    many = spark.createDataFrame(names, "lang string, source string, text string")
    assert found(many, min_documents=3) == brute(names, 3, 50)


def test_counts_passed_on_early_add_up(prose, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_COUNTS", 50)
    texts = [prose(60, i % 5) for i in range(40)]
    table = pa.table({"lang": ["en"] * 40, "source": ["ab"[i % 2] for i in range(40)], "text": texts})
    n, docs = Counter(), Counter()
    parts = 0
    for batch in divergence.count_terms(table.to_batches(max_chunksize=7)):
        parts += 1
        for r in batch.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert parts > 1
    assert n == Counter((s, t) for s, x in zip("ab" * 20, texts) for t in TERM.findall(x))
    assert docs == Counter((s, t) for s, x in zip("ab" * 20, texts) for t in set(TERM.findall(x)))


def test_odd_rows_and_clashing_columns(documents, odd_rows):
    docs = documents(odd_rows)
    clashing = docs.select("*", *[F.lit(7).alias(c) for c in ("term", "n", "docs", "block", "tile", "p", "value", "rank", "part", "item")])
    want = brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()], 2, 50)
    assert found(clashing, min_documents=2) == want
    assert found(documents([]), min_documents=2) == []
