"""Tables whose columns bear the names that an operator gives its results or uses inside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import cover_tree, mixing, shingle_join, substring, toxicity, vantage


@pytest.fixture
def named(documents, prose):
    def build(*names):
        docs = documents([(i, prose(30 + i, i), "ab"[i % 2]) for i in range(20)] + [(None, None, None)]).drop("size")
        return docs.select("*", *[F.lit(777).alias(n) for n in names])

    return build


def test_mixing_leaves_columns_as_they_are(named):
    docs = named("size", "source_size", "target", "copies", "_source", "_doc", "_copy")
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    assert all(r[n] == 777 for r in rows.collect() for n in ("size", "source_size", "target", "copies", "_source", "_doc", "_copy"))
    found = mixing.mixture(docs)
    assert len(set(found.columns)) == len(found.columns) == len(docs.columns)
    assert {r["size"] for r in found.where("doc_id = 3").collect()} == {33} and found.count() == 21


def test_toxicity_results_take_the_place_of_columns(spark, named):
    docs = named("predicted", "score", "held_out", "fold", "x")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.scored(docs, none)
    assert sorted(found.columns) == sorted(docs.columns)
    assert found.where("predicted = 0").count() == 21


def test_repeats_and_near_duplicates(named):
    docs = named("n_words", "n_removed", "_mark", "root", "_doc")
    cut = substring.remove_repeats(docs)
    assert sorted(cut.columns) == sorted(docs.columns) and cut.where("n_words = 777").count() == 0
    kept = shingle_join.keep_one(docs, shingle_join.near_duplicates(docs))
    assert kept.columns == docs.columns and kept.count() == 21


def test_zero_vectors_take_no_part(spark):
    rows = [(1, [0.0, 0.0]), (20, [1.0, 0.5]), (21, [-1.0, 0.5]), (40, [0.0, 0.0]), (22, None), (23, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vantage.nearest(table, F.col("id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [(20, 1, 21)]


def test_large_products_are_exact_or_an_error(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.integers(-(2**19), 2**19, 8)]) for i in range(150)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.top_k(table, F.col("id") % 50 == 0, k=4).collect()}
    whole = {i: [int(1024 * x) for x in v] for i, v in data}
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
        assert [found[q, k] for k in range(1, 5)] == [(i, -s) for s, i in best]
    huge = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range of a long"):
        cover_tree.top_k(huge, F.col("id") == 0).collect()
