import re

from hearthline.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        share = sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] > limit * sizes[s] * share]
        if not above:
            return out | {s: rest * weight[s] / share for s in free}
        for s in above:
            out[s] = limit * sizes[s]
            free.discard(s)
    return out


def test_targets_with_caps(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 500, "é": 3, "z": 0, None: 70}, {"a": 5}, {"a": 0, "b": 0}, {f"s{i:03}": i * i % 97 for i in range(60)}):
        rows = spark.createDataFrame(list(sizes.items()), "_source string, source_size long")
        found = {r["_source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        want = brute_targets(sizes)
        assert found.keys() == want.keys()
        assert all(abs(found[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows).drop("size")
    found = mixing.mixture(docs).collect()
    assert len(found) == len(odd_rows)
    assert sorted(r["size"] for r in found) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in odd_rows)
    assert all(0 <= r["copies"] <= 3 for r in found)
    assert [r["copies"] for r in found if r["doc_id"] == 4][0] == [r["copies"] for r in found if r["doc_id"] == 4][1]
    again = mixing.mixture(docs).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mixture(documents([]).drop("size")).count() == 0


def test_documents_are_emitted_as_often_as_taken(documents, prose):
    docs = documents([(i, prose(20, i), "abc"[i % 3]) for i in range(600)])
    chosen = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs.drop("size")).collect()}
    rows = mixing.mixed(docs.drop("size"))
    assert rows.columns == docs.drop("size").columns
    counts = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in chosen.items() if n}
    for source, want in (("a", 600 * 20 * 5 / 8), ("b", 600 * 20 * 2 / 8), ("c", 600 * 20 / 8)):
        taken = sum(20 * chosen[i] for i in range(600) if "abc"[i % 3] == source)
        assert abs(taken / want - 1) < 0.15
