import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearthline.llm import components, simhash


def brute_print(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_odd_rows_against_brute_force(spark, documents, odd_rows):
    found = simhash.near_duplicates(documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    prints = [brute_print(t) for _, t, _ in odd_rows]
    classes = brute_classes(prints)
    least = {}
    for c, (i, _, _) in zip(classes, odd_rows, strict=True):
        least[c] = min(x for x in (least.get(c), i) if x is not None) if i is not None or least.get(c) is not None else None
    want = sorted((str(i), p, least[c]) for (i, _, _), p, c in zip(odd_rows, prints, classes, strict=True))
    assert sorted((str(r.doc_id), r.f0 & (1 << 64) - 1, r.component_id) for r in found) == want


def test_links_are_complete_in_small_and_crowded_buckets(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    for _ in range(60):  # many within two bits of one point: crowded buckets
        a, b = rng.sample(range(64), 2)
        prints.add(centre ^ 1 << a ^ 1 << b)
    for p in list(prints)[:30]:
        prints.add(p ^ 1 << rng.randrange(64))
    prints.add(1 << 63)
    prints.add(0)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.exact_links(spark.createDataFrame([(p,) for p in signed], "node long")).collect()
    for r in links:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    found = [roots.get(p, p) for p in signed]
    want = brute_classes([p & (1 << 64) - 1 for p in signed])
    assert len(set(zip(found, want, strict=True))) == len(set(found)) == len(set(want))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 500), (601, 600), (600, 601)]
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 400)}, 601: 600}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wide_prints_find_near_copies_and_leave_others(spark, documents, prose):
    rows, rng = [], random.Random(8)
    for i in range(150):
        words = prose(200, 1000 + i).split()
        rows.append((2 * i, " ".join(words), "a"))
        for at in rng.sample(range(10, 190), 2):
            words[at] = "changed"
        rows.append((2 * i + 1, " ".join(words), "a"))
    docs = documents(rows)
    classes = simhash.near_duplicates(docs, shingle=5, words=8, distance=84, distinct=True)
    found = {r.doc_id: r.component_id for r in classes.collect()}
    together = sum(found[2 * i] == found[2 * i + 1] for i in range(150))
    assert together >= 143
    assert len(set(found.values())) == 300 - together
    assert simhash.keep_one(docs, classes).count() == 300 - together


def test_keep_one_keeps_rows_without_id(spark, documents):
    docs = documents([(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (None, "q", "s")])
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"]


def test_empty_table(spark, documents):
    found = simhash.near_duplicates(documents([]).where(F.lit(True)))
    assert found.count() == 0 and found.columns == ["doc_id", "f0", "component_id"]


def test_wide_links_are_complete_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TABLES", 1)
    free = np.random.default_rng(simhash.SEED).permutation(512)[simhash.KEY_BITS :].tolist()
    rng, base, prints = random.Random(5), random.Random(6).getrandbits(512), []
    for i in range(20):  # one block for all; nodes 2k and 2k + 1 alone are close
        flips = rng.sample(free, 60) if i % 2 == 0 else free[:1]
        prints.append((prints[-1] if i % 2 else base) ^ sum(1 << b for b in flips))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *(signed(p >> 64 * k & (1 << 64) - 1) for k in range(8))) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{k} long" for k in range(8)))
    links = simhash.wide_links(nodes, 8, 3).collect()
    assert {(r.a, r.b) for r in links} == {(i, i + 1) for i in range(0, 20, 2)}
