import random
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import substring

SIZE = substring.WINDOW


def brute(texts):
    lists = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + SIZE]) for w in lists for i in range(len(w) - SIZE + 1))
    out = []
    for words in lists:
        gone = [False] * len(words)
        for i in range(len(words) - SIZE + 1):
            if counts[tuple(words[i : i + SIZE])] > 1:
                gone[i : i + SIZE] = [True] * SIZE
        out.append((len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return out


def found(docs):
    rows = substring.remove_repeats(docs).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode()) for r in rows)


def check(documents, rows):
    want = sorted((str(i), *b) for (i, _, _), b in zip(rows, brute([t for _, t, _ in rows]), strict=True))
    assert found(documents(rows)) == want


def test_odd_rows(documents, odd_rows):
    check(documents, odd_rows)


def test_passages_at_all_borders(documents, prose):
    rng, passage, rows = random.Random(5), prose(60, 7).split(), []
    for i in range(60):
        low, high = sorted(rng.sample(range(61), 2))
        rows.append((i, " ".join([prose(rng.randrange(30), 100 + i), *passage[low:high], prose(rng.randrange(50), 200 + i)]), "a"))
    rows += [(90, "x " * 100, "a"), (91, "a b " * 40, "b"), (92, " ".join(passage[:35]), "c"), (93, " ".join(passage[:34]), "c")]
    rows += [(94, "\n\n".join(passage[20:]) + "\tend", "c"), (95, " ".join(passage), "c")]
    check(documents, rows)


def test_untouched_texts_stay_and_columns_do_too(documents, odd_rows):
    docs = documents([(1, " keeps  its\n\nwhite space ", "a"), (2, None, None)])
    out = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert out[1].text == " keeps  its\n\nwhite space " and out[1]["_id"] == "x" and out[2].text is None
    assert substring.remove_repeats(docs).columns == [*docs.columns, "n_words", "n_removed"]
    assert found(documents([])) == []


@pytest.mark.parametrize("seed", range(3))
def test_every_window_has_one_anchor_and_equal_windows_equal_ones(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 6, 400).astype(np.uint64)
    words[200:300] = words[50:150]
    counts = np.array([0, 190, 0, 210, 34 - 34])
    doc, low, lengths, anchor, _ = substring.anchor_runs(words, counts)
    starts = [(d, s + k, a) for d, s, n, a in zip(doc, low, lengths, anchor, strict=True) for k in range(n)]
    assert len(starts) == sum(max(0, c - SIZE + 1) for c in counts)
    first = np.cumsum(counts) - counts
    by_content = {}
    for d, s, a in starts:
        key = tuple(words[first[d] + s : first[d] + s + SIZE])
        assert by_content.setdefault(key, a) == a


def test_long_words_and_pieces():
    text = b"a" * (substring.PIECE + 5) + b" b " + b"c" * 10
    data, starts, ends, counts = substring.word_bounds([text, b"", b"b"])
    assert counts.tolist() == [3, 0, 1]
    hashes = substring.word_hashes(data, starts, ends)
    assert hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3
