import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hearthline.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def brute_ids(texts):
    model = Tokenizer.from_file(PATH)
    return [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_lookup_gives_the_ids_of_the_whole_text():
    texts = [
        "", " ", "Hello, World! it's 'tis don't", "Á é x ́y", "ΣΑΣ Σ. ÉCOLE, naïve…", "a<|endoftext|>b", "<|EndOfText|> x",
        "tab\tnew\nline\x0bvt\x1cfs nbsp em", "don't!!! 'S 's, we'LL", "1234 12,5% x2", "日本語 テスト。", "--, a-,b .., |x|", "İstanbul, ǅ",
        "ﬁne, Å! ½. x².", "word.\" (word)", "🙂, 👩‍👩‍👧!",
    ]
    model = packing.WordTokenizer(PATH)
    for _ in range(2):
        found = [np.frombuffer(x, "<u4").tolist() for x in model.ids([t.encode() for t in texts])]
        assert found == brute_ids(texts)


def test_forgetting_words_changes_nothing(monkeypatch, prose):
    monkeypatch.setattr(packing, "KNOWN_BYTES", 2000)
    texts = [prose(80, i) for i in range(6)]
    model = packing.WordTokenizer(PATH)
    assert [np.frombuffer(model.ids([t.encode()])[0], "<u4").tolist() for t in texts] == brute_ids(texts)


def test_odd_rows(documents, odd_rows):
    rows = packing.packed(documents(odd_rows), PATH).collect()
    texts = [t or "" for _, t, _ in odd_rows]
    want = []
    for (i, _, _), ids in zip(odd_rows, brute_ids(texts), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want += [(str(i), n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert packing.packed(documents([]), PATH).count() == 0


def test_genetic_steps_keep_every_piece_once():
    rng = random.Random(3)
    lengths = [rng.choice((rng.randrange(1, 2048), rng.randrange(600, 800))) for _ in range(500)]
    bins = packing.best_fit(range(500), lengths)
    for child in (packing.mutated(bins, lengths, rng), packing.crossover(bins, packing.mutated(bins, lengths, rng), lengths, rng)):
        assert sorted(i for b in child for i in b) == list(range(500))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in child)
    best = packing.evolve(lengths, [], 1)
    assert sorted(i for b in best for i in b) == list(range(500)) and len(best) <= len(bins)


def test_evolution_improves_a_poor_packing():
    rng = random.Random(12)
    lengths = [rng.randrange(100, 900) for _ in range(300)]
    poor = [[i, i + 1] for i in range(0, 300, 2)]
    least = -(-sum(lengths) // 2048)
    assert least <= len(packing.evolve(lengths, [poor], 5, generations=20)) < len(poor) * 0.7
    assert len(packing.evolve(lengths, [], 5)) <= least + 1
