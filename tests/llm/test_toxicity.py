import random
import zlib

import numpy as np
import pytest

from hearthline.llm import toxicity


def test_isotonic_rises_and_fits():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    x, p = toxicity.isotonic(m, y)
    assert (np.diff(p) > 0).all() and (np.diff(x) > 0).all()
    assert abs(np.interp(m, x, p).mean() - y.mean()) < 0.03


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.boosted(x[:1500], y[:1500])
    assert ((trees.margins(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    assert np.allclose(toxicity.boosted(x[:5], np.zeros(5)).scores(x), toxicity.boosted(x[:5], np.zeros(5)).scores(x)[0])


def test_features_of_odd_texts():
    lexicon = toxicity.Lexicon({"idiot": (9.0, 5.0)}, {"idi": (9.0, 5.0)})
    x = toxicity.features([b"", b"you IDIOT!!! 1d1ot", b"x" * 1_000_000, "é y a b c d".encode()], lexicon)
    assert np.isfinite(x).all() and x.shape == (4, len(toxicity.NAMES))
    at = toxicity.NAMES.index
    assert x[1, at("word_count")] == 1 and x[1, at("masked_hits")] == 1 and x[1, at("nearest")] == 1 and x[1, at("shouted")] > 0
    assert x[3, at("spaced")] == 1


@pytest.fixture(scope="module")
def rows(prose):
    rng, out = random.Random(2), []
    for i in range(700):
        words = prose(60, i).split()
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(60), rng.choice(("gromp", "snarl", "veldik", "veldash")))
        out.append((i, " ".join(words), "s", int(toxic)))
    return out


def test_held_out_accuracy_and_odd_rows(spark, documents, rows):
    docs = documents([r[:3] for r in rows] + [(5000, None, None), (5001, "", None), (None, "gromp snarl", None), (1, rows[1][1], "s")])
    labels = [(i, 1, t) for i, _, _, t in rows] + [(0, 1, 0), (1, 1, None), (9999, 0, 1), (None, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.scored(docs, labels).collect()
    assert len(found) == 704
    truth = {i: t for i, _, _, t in rows}
    held = [r for r in found if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in found if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) >= 0.97 * len([r for r in held if r.doc_id in truth])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.predicted == 0 for r in found if r.doc_id in (5000, 5001))
    # Labels of held-out rows are never learnt: turning them all around changes no score.
    turned = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id as string)), 4) = 2, 1 - toxic, toxic) AS toxic")
    again = {(r.doc_id, r.text): r.score for r in toxicity.scored(docs, turned).collect()}
    assert all(abs(again[(r.doc_id, r.text)] - r.score) < 1e-12 for r in found)


def test_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.scored(documents([(1, "a", "s"), (2, None, "s")]), none).collect()} == {0}
    assert toxicity.scored(documents([]), none).count() == 0
