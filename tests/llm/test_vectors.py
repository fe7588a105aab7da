import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import cover_tree, vantage, vectors


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "w") for i, v in rows], "vec_id long, embedding array<float>, id int, vector string")


def brute(rows, every, k, score, usable):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if usable(v) and i is not None]
    rows = list({(i, v.tobytes()): (i, v) for i, v in rows}.values())
    out = []
    for q, a in rows:
        if q % every == 0:
            best = sorted((-score(a, b), i) for i, b in rows if i != q and len(a) == len(b))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def finite(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def integer(a, b):
    return int(np.floor(1024 * a) @ np.floor(1024 * b))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    out = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(900)]
    out += [(900, None), (1000, [None] * 16), (1100, [float("nan")] * 16), (1200, [float("inf")] * 16), (1300, []), (None, out[5][1])]
    out += [(1400, [0.0] * 16), (1401, [0.0] * 16), (1500, out[0][1]), (1500, out[0][1]), (1502, out[0][1]), (1600, [1.0, 2.0]), (1601, [0.5, 2.0])]
    return out


def test_cover_tree_search_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 200)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    found = cover_tree.top_k(table(spark, rows), F.col("id") % 100 == 0, k=10).collect()
    want = brute(rows, 100, 10, integer, finite)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == want
    assert cover_tree.top_k(table(spark, []), F.col("id") % 100 == 0).count() == 0


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(3)
    points = np.vstack([c + 0.01 * rng.normal(size=(300, 8)) for c in 10 * rng.normal(size=(10, 8))])
    tree = cover_tree.build(points)
    waiting, leaves = [tree], []
    while waiting:
        node = waiting.pop()
        assert np.sqrt(((points[node.items] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        waiting += node.children
        leaves += [] if node.children else [node.items]
    assert sorted(np.concatenate(leaves)) == list(range(3000))
    compared = []

    class Counted(cover_tree.Search):
        def compare(self, asked, node):
            compared.append(len(asked.items) * len(node.items))
            super().compare(asked, node)

    queries = np.floor(points[::100])
    Counted(np.arange(3000), np.floor(points), np.arange(0, 3000, 100), queries, 5).visit(cover_tree.build(queries, leaf=4), cover_tree.build(np.floor(points)))
    assert sum(compared) < 0.7 * 30 * 3000


def test_vantage_search_exact_with_factor_one_and_near_with_more(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 300)
    nonzero = [(i, v) for i, v in rows if finite(v) and any(v)]
    want = brute(nonzero, 20, 20, lambda a, b: float(a @ b), finite)
    asked = F.col("id") % 20 == 0
    source = table(spark, rows).where(F.exists("embedding", lambda x: x != 0))
    exact = vantage.nearest(source, asked, factor=1.0).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(exact, key=lambda r: (r.query_id, r["rank"]))] == [w[:2] for w in want]
    by = {(r.query_id, r["rank"]): r for r in exact}
    assert all(abs(by[w[:2]].score - w[3]) < 1e-9 for w in want)
    near = {(r.query_id, r.vec_id) for r in vantage.nearest(source, asked).collect()}
    assert len(near & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)
    assert vantage.nearest(table(spark, []), asked).count() == 0


def sent(df):
    """Bytes that the exchanges of a table's plan got when it ran."""
    waiting, total = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        elif "QueryStage" in name:
            waiting.append(node.plan())
        else:
            total += node.metrics().apply("dataSize").value() if name == "Exchange" else 0
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.mark.parametrize("search", [cover_tree.top_k, lambda *a: vantage.nearest(*a, factor=1.0)])
def test_what_a_search_sends_does_not_grow_with_blocks_of_queries(spark, monkeypatch, search):
    rng = np.random.default_rng(4)
    source = table(spark, list(enumerate(rng.normal(size=(6000, 16)).tolist())))
    monkeypatch.setattr(vectors, "SHARD", 1000)
    found = {}
    for block in (600, 30):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        df = search(source, F.col("id") % 10 == 0, 10)
        rows = df.collect()
        found[block] = sent(df), sorted((r.query_id, r["rank"], r.vec_id) for r in rows)
    assert found[30][1] == found[600][1] and len(found[30][1]) == 6000
    assert 6000 * 64 < found[30][0] < 1.2 * found[600][0]


def test_groups_of_queries_and_shards_change_no_result(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "HELD", 300)
    monkeypatch.setattr(vectors, "RETURNED", 7)
    asked = F.col("id") % 20 == 0
    found = cover_tree.top_k(table(spark, rows), asked).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute(rows, 20, 10, integer, finite)
    nonzero = [(i, v) for i, v in rows if finite(v) and any(v)]
    exact = vantage.nearest(table(spark, nonzero), asked, factor=1.0).collect()
    want = brute(nonzero, 20, 20, lambda a, b: float(a @ b), finite)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in exact) == [w[:3] for w in want]


@pytest.mark.parametrize("size", [1.0, 1e5, 3e8])
def test_ties_and_common_vectors_from_shard_to_shard(size):
    # Vectors that many ids share, at products that single precision cannot tell apart, and beyond doubles.
    rng = np.random.default_rng(6)
    data = np.floor(size * rng.integers(-3, 4, size=(700, 4)))
    data[200:500] = data[3]
    data[500:600] = data[4] + 1
    ids = rng.permutation(700)
    job = cover_tree.Search(ids[:0], data[:0], ids[::7], data[::7], 5)
    asked = cover_tree.build(data[::7], leaf=8)
    for part in np.array_split(np.argsort(ids) if size > 1 else np.arange(700), 4):
        job.turn_to(ids[part], data[part])
        job.visit(asked, cover_tree.build(data[part], leaf=16))
    row, found, scores = job.best.results()
    whole = [[int(x) for x in v] for v in data]
    for at in range(0, 700, 7):
        products = ((-sum(x * y for x, y in zip(whole[at], v, strict=True)), i) for i, v in zip(ids, whole, strict=True) if i != ids[at])
        best = sorted(products)[:5]
        mine = row == at // 7
        assert [(-s, i) for s, i in zip(scores[mine].tolist(), found[mine].tolist(), strict=True)] == [(s, int(i)) for s, i in best]


def test_best_counts_equal_ids_and_scores_once():
    best = vectors.Best(2, 3, -np.inf)
    best.add(np.array([1, 1, 1, 0]), np.array([7, 7, 5, 9]), np.array([2.0, 2.0, 2.0, 1.0]))
    best.add(np.array([1, 1]), np.array([7, 8]), np.array([2.0, 1.0]))
    best.add(np.array([1]), np.array([7]), np.array([1.5]))
    row, found, scores = best.results()
    assert list(zip(row.tolist(), found.tolist(), scores.tolist(), strict=True)) == [(0, 9, 1.0), (1, 5, 2.0), (1, 7, 2.0), (1, 7, 1.5)]
