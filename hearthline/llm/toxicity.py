"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The labelled rows fall into folds by crc32 of their id. Fold ``HELD_OUT`` is never learnt
from. Word and word-stem lexicons come from counts over the other rows: folds 0 and 1 take
their features from each other's lexicon, so that the trees do not learn to trust words that
only their own rows made frequent; all others take them from the joint one. Fold 3
calibrates. At most about ``FIT_ROWS`` labelled rows are used, picked by hash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import chunked, column_set, columns_besides, texts_of
from hearthline.llm.simhash import shingle_hashes
from hearthline.session import staged

FOLDS = 4
HELD_OUT = 2
FIT_FOLDS = (0, 1)
THRESHOLD = 0.3
FIT_ROWS = 20_000
LEXICON = 4_000
LEAST_DOCS = 3
# Among tens of thousands of tokens, less than one is expected to reach this by chance.
LEAST_EVIDENCE = 4.0
NEAR = 3
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 100, 4, 0.1, 64, 2.0, 1.0

# Forms of the second person, and letters that digits and signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti tus"
    " usted ustedes vosotros su".split()
)
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"[^\W\d_]*(?:[0-9@$*!#]+[^\W\d_]+)+")
_SHOUTED = re.compile(rb"[A-Z]{3,}")
_RUN = re.compile(rb"[!?]{2,}")
_UPPER, _DIGITS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"@#$%*&^"
CACHED_WORDS = 1 << 18

TIERS = ((4.0, 1.0), (5.5, 2.5), (8.0, 3.5))
NAMES = (
    [f"{kind}_{what}" for kind in ("word", "stem") for what in ("count", "density", "sum", "max", "second", *(f"above_{t[0]}" for t in TIERS))]
    + ["masked_hits", "near", "nearest", "you", "upper", "shouted", "exclaimed", "asked", "runs", "signs", "masked", "long", "spaced"]
    + ["words", "word_length", "digits", "variety", "lines"]
)


def fold(identity: Column) -> Column:
    return F.pmod(F.crc32(identity.cast("string")), F.lit(FOLDS)).cast("int")


def stems(word: str) -> tuple[str, ...]:
    return tuple(word[:n] for n in (3, 4, 5) if len(word) > n)


NOTHING = (0.0, 0.0)


@dataclass
class Lexicon:
    """Evidence and log odds of words and of stems."""

    words: dict[str, tuple[float, float]]
    stems: dict[str, tuple[float, float]]

    def __post_init__(self) -> None:
        self.known: dict[str, tuple] = {}

    def of(self, word: str) -> tuple:
        """The word's own entry and the best of its stems."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > CACHED_WORDS:
                self.known.clear()
            stem = max((self.stems.get(s, NOTHING) for s in stems(word)), key=lambda e: e[1]) if len(word) > 3 else NOTHING
            found = self.known[word] = (self.words.get(word, NOTHING), stem)
        return found

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "known": {}}


def weighed(pos: float, neg: float, positives: float, negatives: float) -> tuple[float, float]:
    """Square root of the likelihood ratio statistic, 0 if the token is rarer among toxic rows; log odds."""
    odds = math.log((pos + 0.5) / (positives - pos + 0.5)) - math.log((neg + 0.5) / (negatives - neg + 0.5))
    both, rows = pos + neg, max(1.0, positives + negatives)
    if odds <= 0 or not both:
        return 0.0, odds
    expected = both * positives / rows, both * negatives / rows
    ratio = sum(x * math.log(x / e) for x, e in zip((pos, neg), expected, strict=True) if x)
    return math.sqrt(max(0.0, 2 * ratio)), odds


def _long_runs(data: bytes) -> int:
    """Places where an ASCII letter stands three times."""
    a = np.frombuffer(data, np.uint8)
    if len(a) < 3:
        return 0
    letters = (a[2:] >= 97) & (a[2:] <= 122)
    return int((letters & (a[2:] == a[1:-1]) & (a[1:-1] == a[:-2])).sum())


def _spaced(words: list[str]) -> int:
    """Runs of four or more words of one letter."""
    runs = length = 0
    for word in words:
        length = length + 1 if len(word) == 1 else 0
        runs += length == 4
    return runs


def _entries(found: list[tuple[tuple[float, float], int]], words: int) -> list[float]:
    count = sum(n for _, n in found)
    odds = sorted((e[1] for e, _ in found), reverse=True)[:2] + [0.0, 0.0]
    tiers = [sum(n for e, n in found if e[0] >= evidence and e[1] >= least) for evidence, least in TIERS]
    return [count, count / words, sum(e[1] * n for e, n in found), *odds[:2], *tiers]


def _features(data: bytes, lexicon: Lexicon) -> list[float]:
    lower = data.decode().lower()
    words = _WORD.findall(lower)
    n, size = max(1, len(words)), max(1, len(data))
    counts = Counter(words)
    own, stemmed, strong = [], [], set()
    for word, times in counts.items():
        entry, stem = lexicon.of(word)
        if entry[0]:
            own.append((entry, times))
        if stem[0]:
            stemmed.append((stem, times))
        if max(entry[1] if entry[0] else 0, stem[1] if stem[0] else 0) >= TIERS[1][1]:
            strong.add(word)
    row = _entries(own, n) + _entries(stemmed, n)
    upper, digits, signs = (size - len(data.translate(None, kind)) if data else 0 for kind in (_UPPER, _DIGITS, _SIGNS))
    exclaimed, asked = data.count(b"!"), data.count(b"?")
    masked = _MASKED.findall(lower) if digits or signs or exclaimed else []
    row.append(sum(w.replace("*", "").translate(LOOKALIKES) in lexicon.words for w in masked))
    addressed = SECOND_PERSON & counts.keys()
    near, nearest = 0, 50
    if addressed and strong:
        you = np.array([at for at, w in enumerate(words) if w in addressed])
        hits = np.array([at for at, w in enumerate(words) if w in strong])
        after = np.searchsorted(you, hits)
        gaps = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - hits), np.abs(you[np.maximum(after - 1, 0)] - hits))
        near, nearest = int((gaps <= NEAR).sum()), min(50, int(gaps.min()))
    row += [near, nearest, sum(counts[w] for w in addressed) / n, upper / size, len(_SHOUTED.findall(data)) / n, exclaimed / n, asked / n]
    row += [len(_RUN.findall(data)) if exclaimed + asked > 1 else 0, signs / size, len(masked) / n, _long_runs(lower.encode()) / n]
    row.append(_spaced(words) if sum(c for w, c in counts.items() if len(w) == 1) > 3 else 0)
    row += [math.log1p(len(words)), size / n, digits / size, len(counts) / n, math.log1p(data.count(b"\n"))]
    return row


def features(texts: Iterable[bytes], lexicon: Lexicon) -> np.ndarray:
    rows = [_features(t, lexicon) for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(NAMES))


# ---- boosted trees


@dataclass
class Trees:
    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    low: np.ndarray
    high: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        bins = self.binned(x)
        tree = np.arange(len(self.feature))
        at = np.zeros((len(x), len(tree)), np.int64)
        for _ in range(DEPTH):
            feature = self.feature[tree, at]
            at = 2 * at + 1 + (np.take_along_axis(bins, feature, axis=1) > self.cut[tree, at])
        return self.base + self.leaf[tree, at - (2**DEPTH - 1)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a trace of the margin keeps the order inside a step."""
        margins = self.margins(x)
        return 0.998 * np.interp(margins, self.low, self.high) + 0.002 / (1 + np.exp(-margins))


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of ``DEPTH`` levels on histograms, by gradients of the logistic loss."""
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    trees = Trees([], np.empty((0, 0), int), np.empty((0, 0), int), np.empty((0, 0)), math.log(rate / (1 - rate)), np.array([0.0]), np.array([rate]))
    if not len(y) or y.min() == y.max():
        return trees
    trees.cuts = [np.unique(np.quantile(c[np.isfinite(c)], np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = trees.binned(x).astype(np.int64)
    rows, columns = bins.shape
    margin = np.full(rows, trees.base)
    inner = 2**DEPTH - 1
    picked, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, int), np.full(inner, BINS)
        at = np.zeros(rows, np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            key = (((at - first) * columns)[:, None] + np.arange(columns)) * BINS + bins
            shape = (nodes, columns, BINS)
            size = nodes * columns * BINS
            g = np.bincount(key.ravel(), np.repeat(gradient, columns), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(key.ravel(), np.repeat(weight, columns), size).reshape(shape).cumsum(axis=2)
            gs, hs = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (gs - g) ** 2 / (hs - h + RIDGE) - gs**2 / (hs + RIDGE)
            gain[(h < LEAST_WEIGHT) | (hs - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1).max(axis=1) > 1e-6
            feature[first : first + nodes] = best // BINS
            cut[first : first + nodes] = np.where(good, best % BINS, BINS)
            at = 2 * at + 1 + (bins[np.arange(rows), feature[at]] > cut[at])
        own = at - inner
        leaf = -RATE * np.bincount(own, gradient, inner + 1) / (np.bincount(own, weight, inner + 1) + RIDGE)
        margin += leaf[own]
        picked.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    trees.feature, trees.cut, trees.leaf = np.array(picked), np.array(cuts), np.array(leaves)
    return trees


def isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve that fits y best, by pooling neighbours that fall."""
    if not len(y):
        return np.array([-5.0, 5.0]), 1 / (1 + np.exp(np.array([5.0, -5.0])))
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, label in zip(margins[order], y[order], strict=True):
        blocks.append([label, 1, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


# ---- learning and scoring on Spark


def _counted(sample: DataFrame) -> DataFrame:
    """Rows of each fold and label with a word or stem; combined per batch before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            counts: Counter = Counter()
            for text, number, label in zip(texts_of(batch, "_text"), batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(_WORD.findall(text.decode().lower()))
                tokens = {("w", w) for w in words} | {("s", s) for w in words for s in stems(w)}
                counts.update((*t, number, label) for t in tokens)
            rows = list(zip(*((*k, n) for k, n in counts.items()), strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["kind", "token", "fold", "toxic", "n"])

    rows = sample.select("_text", "fold", "toxic").mapInArrow(run, "kind string, token string, fold int, toxic int, n long")
    cells = [
        F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n"))), F.lit(0)).alias(f"n{f}{t}")
        for f in FIT_FOLDS for t in (0, 1)
    ]
    return rows.groupBy("kind", "token").agg(*cells)


def _lexicons(sample: DataFrame) -> dict[tuple[int, ...], Lexicon]:
    """Lexicons by the folds they come from."""
    size = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    counts = _counted(sample.where(F.col("fold").isin(*FIT_FOLDS)))
    pos = sum((F.col(f"n{f}1") for f in FIT_FOLDS), F.lit(0))
    neg = sum((F.col(f"n{f}0") for f in FIT_FOLDS), F.lit(0))
    totals = [max(1, sum(size.get((f, t), 0) for f in FIT_FOLDS)) for t in (1, 0)]
    # Orders tokens much as their evidence does.
    gain = pos * (F.ln((pos + 0.5) / (neg + 0.5)) + math.log(totals[1] / totals[0]))
    likely = counts.where((pos >= LEAST_DOCS) & (gain > 0)).orderBy(gain.desc(), "kind", "token").limit(LEXICON).collect()
    out = {}
    for folds in ((FIT_FOLDS[0],), (FIT_FOLDS[1],), FIT_FOLDS):
        totals = [sum(size.get((f, t), 0) for f in folds) for t in (1, 0)]
        made = Lexicon({}, {})
        for row in likely:
            entry = weighed(*(sum(row[f"n{f}{t}"] for f in folds) for t in (1, 0)), *totals)
            if entry[0] >= LEAST_EVIDENCE:
                (made.words if row["kind"] == "w" else made.stems)[row["token"]] = entry
        out[folds] = made
    return out


def _thinned(sample: DataFrame) -> DataFrame:
    """Rows to learn from: of texts that share their smallest shingle hash and label, one.

    Groups of copies would else make all their words look like evidence.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            keys = [min(shingle_hashes(t, 5, True), default=0) >> 1 for t in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])

    keyed = sample.select("_id", "_text", "toxic", "fold").mapInArrow(run, "_id long, _text string, toxic int, fold int, key long")
    first = keyed.groupBy("key", "toxic").agg(F.min("_id").alias("_id"))
    return keyed.join(first, ["key", "toxic", "_id"]).select("_id", "_text", "toxic", "fold")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Lexicon, Trees]:
    """The joint lexicon and calibrated trees; labels: (id, toxic), of several the highest."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("_id"))).where(F.col("fold") != HELD_OUT)
    share = FIT_ROWS / max(1, known.count())
    draw = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30)) / (1 << 30)
    texts = column_set(docs, id_col, text_col).toDF("_id", "_text")
    # About FIT_ROWS rows of three numbers, whatever the table's size.
    sample = staged(texts.join(F.broadcast(known.where(draw < share)), "_id"), "labelled")
    learnt = F.col("fold").isin(*FIT_FOLDS)
    sample = staged(_thinned(sample.where(learnt)).unionByName(sample.where(~learnt).select("_id", "_text", "toxic", "fold")), "thinned")
    lexicons = _lexicons(sample)
    one, two = FIT_FOLDS
    by_fold = {one: lexicons[(two,)], two: lexicons[(one,)]}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_text"):
            numbers, found = batch.column("fold").to_pylist(), []
            for text, number in zip(texts_of(batch, "_text"), numbers, strict=True):
                found.append(features([text], by_fold.get(number, lexicons[FIT_FOLDS]))[0])
            x = pa.ListArray.from_arrays(np.arange(0, len(found) + 1, dtype=np.int32) * len(NAMES), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("fold"), batch.column("toxic"), x], ["_id", "fold", "toxic", "x"])

    rows = sample.mapInArrow(run, "_id long, fold int, toxic int, x array<double>").toPandas().sort_values("_id", kind="stable")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.empty((0, len(NAMES)))
    y, number = rows["toxic"].to_numpy(np.float64), rows["fold"].to_numpy()
    fitting = np.isin(number, FIT_FOLDS)
    trees = boosted(x[fitting], y[fitting])
    if len(trees.feature):
        trees.low, trees.high = isotonic(trees.margins(x[~fitting]), y[~fitting])
    return lexicons[FIT_FOLDS], trees


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with ``held_out``, ``score`` and ``predicted`` (1 from ``THRESHOLD``).

    Columns of these names in docs give way to them.
    Null texts count as empty. Without labels of both kinds every score is the share of
    toxic labels. A null id is not held out. The score depends on the text alone.
    """
    lexicon, trees = train(docs, labels, id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, at):
            x = features(texts_of(batch, at), lexicon)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.scores(x))], [*batch.schema.names, "score"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    done = docs.toDF(*names).mapInArrow(run, f"{kinds}, score double")
    identity = F.col(names[docs.columns.index(id_col)])
    kept = columns_besides(docs, "held_out", "score", "predicted")
    return done.select(
        *[F.col(n).alias(own) for n, own in zip(names, docs.columns, strict=True) if own in kept],
        F.coalesce(fold(identity) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
