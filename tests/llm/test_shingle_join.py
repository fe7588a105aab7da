import random

from hearthline.llm import shingle_join


def shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def edited(words, places):
    return [f"edit{p}" if p in places else w for p, w in enumerate(words)]


def components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_against_brute_force_at_the_threshold(spark, documents, prose):
    rng, texts = random.Random(2), []
    for i in range(120):  # isolated pairs between about 0.74 and 0.85
        words = prose(200, 5000 + i).split()
        texts += [" ".join(words), " ".join(edited(words, range(8, 190, 190 // (3 + i % 4))))]
    base, passage = prose(200, 7), prose(40, 8)
    texts += [" ".join(edited(base.split(), rng.sample(range(200), rng.randrange(1, 9)))) for _ in range(60)]
    texts += [prose(60, 9000 + i) + " " + passage for i in range(40)]
    assert sum(1 for a, b in zip(texts[:240:2], texts[1:240:2], strict=True) if 0.8 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.85) >= 25
    docs = documents([(i, t, "a") for i, t in enumerate(texts)])
    found = {r.doc_id: r.root for r in shingle_join.near_duplicates(docs).collect()}
    want = components(texts)
    assert len({(found[i], want[i]) for i in found}) == len(set(found.values())) == len(set(want))


def test_rows_with_one_id_replace_each_other_only_in_one_class(spark, documents, prose):
    one, other = prose(80, 1), prose(80, 2)
    docs = documents([(2, one, "a"), (2, other, "a"), (1, one, "a"), (5, other + " x", "a"), (None, one, "a"), (2, other, "a")])
    kept = shingle_join.keep_one(docs, shingle_join.near_duplicates(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", one), ("2", other), ("None", one)])
