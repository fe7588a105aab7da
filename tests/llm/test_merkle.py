import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hearthline.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(leaves):
    """Root, subroots and, per leaf of (tree, key, digest), the siblings with their sides; hashed anew."""
    trees = {}
    for tree, key, digest in sorted(leaves):
        trees.setdefault(tree, []).append(digest)

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
        return levels

    built = {tree: build(nodes) for tree, nodes in trees.items()}
    top = build([built[t][-1][0] for t in sorted(built)])

    def way(levels, at):
        steps = []
        for level in levels[:-1]:
            run = at - at % 2
            steps.append((at % 2, [d for i, d in enumerate(level[run : run + 2], run) if i != at]))
            at //= 2
        return steps

    rows = []
    for number, tree in enumerate(sorted(built)):
        for at, digest in enumerate(built[tree][0]):
            rows.append((tree, digest, built[tree][-1][0], top[-1][0], way(built[tree], at) + way(top, number)))
    return rows


def climbed(node, steps):
    for slot, others in steps:
        node = sha(*(others + [node] if slot else [node] + others))
    return node


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 5, 1], [4, 16, 17, 33], [65, 3, 64, 1, 9], [1] * 21])
def test_trees_against_hashing_all_anew(spark, sizes):
    rows = [(k, f"l{t}" if t else None, sha(f"{t}/{k}"), sha("x") if k % 3 == 0 else None) for t, n in enumerate(sizes) for k in range(n)]
    random.Random(4).shuffle(rows)
    table = spark.createDataFrame(rows, "id long, lang string, leaf string, changed string")
    found = {r["leaf"]: r for r in merkle.manifest(table, block=4).collect()}
    want = brute([("" if lang is None else "=" + lang, k, leaf) for k, lang, leaf, _ in rows])
    assert len(found) == len(want) == len(rows)
    changed = {leaf: new for _, _, leaf, new in rows}
    for _, leaf, subroot, root, steps in want:
        row = found[leaf]
        assert (row["subroot"], row["root"]) == (subroot, root)
        assert row["proof"] == sha(*[d for _, others in steps for d in others])
        assert row["folded_root"] == climbed(changed[leaf] or leaf, steps)
        assert (row["folded_root"] == root) == (changed[leaf] is None)


def test_a_replaced_child_resumes_the_state_before_it():
    run = [sha(str(i)) for i in range(5)]
    parent = merkle.Parent(run)
    assert parent.digest == sha(*run)
    for slot in range(5):
        assert parent.replaced(slot, sha("new")) == sha(*run[:slot], sha("new"), *run[slot + 1 :])
        assert parent.replaced(slot, run[slot]) == parent.digest


def test_steps_survive_writing():
    steps = [(0, ("a",)), (1, ("b",)), (0, ()), (2, ("c", "d"))]
    assert merkle.unpacked_steps(merkle.packed_steps(steps)) == steps
    assert merkle.unpacked_steps(merkle.packed_steps(steps[:2], merkle.packed_steps(steps[2:]))) == steps
    assert merkle.unpacked_steps(merkle.packed_steps([], "")) == []


def leaf_of(row):
    values = [row[c] for c in merkle.FIELDS]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def test_documents_with_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows).withColumn("leaf", F.lit("mine")).withColumn("place", F.lit(1)).withColumn("tree", F.lit(2))
    found = merkle.document_leaves(docs).collect()
    rows = docs.collect()
    assert sorted(r["leaf"] for r in found) == sorted(map(leaf_of, rows))
    by_leaf = {leaf_of(r): r for r in rows}
    for r in found:
        row = by_leaf[r["leaf"]].asDict()
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
        if hit and row["n_chars"] is not None:
            assert r["changed"] == leaf_of(row | {"n_chars": row["n_chars"] + 1})
        else:
            assert r["changed"] in (None, r["leaf"])
    whole = merkle.manifest(merkle.document_leaves(docs), block=4).collect()
    assert len(whole) == len(rows) and len({r["root"] for r in whole}) == 1
    tree = [("=en", (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)), leaf_of(r)) for r in rows]
    assert whole[0]["root"] == brute(tree)[0][3]
    assert merkle.manifest(merkle.document_leaves(documents([]))).count() == 0


def test_largest_count_of_characters_can_be_tampered_with(spark):
    tampered = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0)
    docs = spark.createDataFrame([(tampered, "s", None, (1 << 63) - 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.document_leaves(docs).first()
    assert row["changed"] == leaf_of({"doc_id": tampered, "source": "s", "lang": None, "n_chars": 1 << 63, "text": "t"})
