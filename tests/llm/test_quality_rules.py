import re
from collections import Counter, defaultdict
from math import log2

import pytest
from pyspark.sql import functions as F

from hearthline.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def char_class(c):
    if "A" <= c <= "Z":
        return 0
    return 1 if c in "0123456789" else 2 if c in ".,;:?!'\"()-" else 3 if c in "#*$%&|<>" else 4 if c in " \t\n\x0b\x0c\r" else 6


def class_counts(text):
    counts = Counter(map(char_class, text))
    counts[5] = len(text.encode()) - len(text)
    return counts


def measured(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def divergence(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += (a * log2(2 * a / (a + b)) if a else 0) + (b * log2(2 * b / (a + b)) if b else 0)
    return total / 2


def brute(rows):
    """Counts, verdict and squared distances of (lang, text) rows, one text at a time."""
    words, classes = defaultdict(Counter), defaultdict(Counter)
    for lang, text in rows:
        found = WORD.findall(text or "")
        if len(found) >= 50:
            words[lang].update(found)
            classes[lang].update(class_counts(text))
    out = []
    for lang, text in rows:
        row = measured(text)
        n, own = row["n_words"], Counter(WORD.findall(text or ""))
        row["base_failed"] = n < 50 or 100 * row["n_repeat_words"] > 50 * n
        total = sum(words[lang].values())
        row["class"] = row["word"] = None
        if not row["base_failed"] and total >= 2000 and row["word_chars"] >= 200:
            common = sorted((-k, w.encode(), w) for w, k in words[lang].items() if len(w) <= 4)[:16]
            names = [w for _, _, w in common]
            y = [words[lang][w] / total for w in names]
            x = [own[w] / n for w in names]
            row["word"] = divergence(x + [1 - sum(own[w] for w in names) / n], y + [1 - sum(words[lang][w] for w in names) / total])
            chars = class_counts(text)
            every = sum(classes[lang].values())
            row["class"] = divergence([chars[k] / len(text.encode()) for k in range(7)], [classes[lang][k] / every for k in range(7)])
        strays = row["class"] is not None and (row["class"] > 0.03 + 3 / n or row["word"] > 0.03 + 4.5 / n)
        row["kept"] = not row["base_failed"] and not strays
        out.append(row)
    return out


def check(rows, found):
    want = brute(rows)
    assert len(found) == len(want)
    for row, r in zip(want, sorted(found, key=lambda r: r["k"])):
        assert {n: r[n] for n in (*rules.COUNTS, "base_failed", "kept")} == {n: row[n] for n in (*rules.COUNTS, "base_failed", "kept")}
        for name in ("class", "word"):
            if row[name] is None:
                assert r[f"{name}_distance"] is None
            else:
                assert r[f"{name}_distance"] ** 2 == pytest.approx(row[name], abs=1e-12)


@pytest.fixture(scope="module")
def mixed(prose):
    rows = [(("en", "de", None)[i % 3], prose(60 + 7 * (i % 50), i).replace(" ", " the ", 9).capitalize() + ".") for i in range(150)]
    loud = [("en", prose(120, 900 + i).upper().replace(" ", "!!! ")) for i in range(3)]
    signs = [("de", prose(200, 950 + i).replace(" ", "## ")) for i in range(3)]
    lines = [("en", "\n".join([prose(9, 5), "", prose(8, 6), prose(9, 5), "  ", prose(9, 5), prose(40, 7)])), ("en", "a b c a b c a b c " * 20)]
    tiny = [("zz", prose(80, 3)), ("en", "one two"), ("en", None), (None, ""), ("en", " \t\n\r"), ("de", "ß é " * 40), ("en", "a " * 60)]
    return rows + loud + signs + lines + tiny + [("en", prose(20_000, 11))]


def test_against_one_text_at_a_time(spark, mixed):
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(mixed)], "k int, lang string, text string")
    found = rules.judged(docs).collect()
    check(mixed, found)
    verdict = {r["k"]: r for r in found}
    assert all(verdict[i]["kept"] for i in range(150))
    assert not any(verdict[i]["kept"] or verdict[i]["base_failed"] for i in range(150, 156))


def test_words_that_repeat_windows(spark):
    texts = ["a b c", "a b c a b c", "x x x x", "a a a", "a b a b a b", "p q r s p q r t p q", "a\tb\nc  d", "a b c d a b c d e a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("lang", F.lit("en"))
    found = {r["k"]: r["n_repeat_words"] for r in rules.judged(docs).collect()}
    assert found == {i: measured(t)["n_repeat_words"] for i, t in enumerate(texts)}
    assert found[0] == 0 and found[1] == 6 and found[2] == 4 and found[3] == 0


def test_odd_rows_and_clashing_columns(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for name in ("n_words", "kept", "word_distance", "_words", "common", "_lang", "total", "_of"):
        docs = docs.withColumn(name, F.lit(5))
    docs = docs.withColumn("k", F.monotonically_increasing_id())
    found = rules.judged(docs)
    assert sorted(found.columns) == sorted(set(docs.columns) | set(rules.RESULTS))
    rows = docs.orderBy("k").collect()
    check([(r["lang"], r["text"]) for r in rows], found.collect())
    passed = rules.kept(docs)
    assert passed.columns == docs.columns
    assert passed.count() == found.where("kept").count()
    assert rules.judged(documents([])).count() == 0
    assert rules.kept(documents([])).count() == 0


def test_no_python_in_the_plan(documents, odd_rows):
    plan = rules.judged(documents(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
