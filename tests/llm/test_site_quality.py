import random

import pytest
from pyspark.sql import functions as F

from hearthline.llm import site_quality


@pytest.fixture(scope="module")
def rows(prose):
    """Good prose and, more often on some sources, shouted or repeated junk."""
    rng, out = random.Random(6), []
    for i in range(900):
        source = "abcdef"[i % 6] if i % 3 else "hot"
        bad = rng.random() < (0.5 if source == "b" else 0.1)
        text = prose(60, i)
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else " ".join(w for w in text.split()[:20] for _ in range(5))
        out.append((i, text, source, int(not bad)))
    return out


def scored(docs, labels):
    return site_quality.scored(docs, labels, F.col("source"), F.col("lang"))


def test_held_out_accuracy_and_odd_rows(spark, documents, rows):
    odd = [(5000, None, None), (5001, "", "new"), (None, rows[1][1], "a"), (1, rows[1][1], rows[1][2])]
    docs = documents([r[:3] for r in rows] + odd)
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows] + [(0, None, 1), (None, 1, 1), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    found = scored(docs, labels).collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: q for i, _, _, q in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and sum(r.keep == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 < r.score < 1 and 0 < r.path_share < 1 and r.keep == (r.score >= 0.5) for r in found)
    shares = {r.host: r.host_share for r in found}
    assert shares["b"] == min(shares.values()) and shares["b"] < 0.75 < shares["hot"]
    assert abs(shares["new"] - sum(truth.values()) / len(truth)) < 0.1  # a sparse host stands near the overall share
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda r: (str(r.doc_id), str(r.host), round(r.score, 9))
    assert sorted(map(key, scored(docs, turned).collect())) == sorted(map(key, found))


def test_strength_follows_differences():
    assert site_quality.strength(1000, 0.0, 9, 900.0, 0.5) == site_quality.STRENGTH[1]
    weak = site_quality.strength(1000, 60.0, 9, 900.0, 0.5)
    assert site_quality.STRENGTH[0] <= weak < site_quality.strength(1000, 10.0, 9, 900.0, 0.5)
    assert site_quality.strength(0, 0.0, 0, 0.0, 0.5) == site_quality.STRENGTH[1]


def test_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(scored(documents([(1, "a", "s"), (2, None, None)]), none).collect()) == 2
    assert scored(documents([]), none).count() == 0


def test_sites_of_urls(spark):
    urls = spark.createDataFrame([("https://www.A.org/en/1?x",), ("http://b.net",), (None,), ("not a url",)], "url string")
    found = urls.select(site_quality.host_of(F.col("url")).alias("h"), site_quality.path_of(F.col("url")).alias("p")).collect()
    assert [(r.h, r.p) for r in found][:3] == [("a.org", "en"), ("b.net", ""), (None, "")]
