"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each is a vector of hashed tag-path names, hashed words
and a few rates; a bidirectional LSTM in numpy reads the sequence both ways, so every block
is classified with the whole page as context.

Training uses at most about ``FIT_PAGES`` pages of the table, picked by hash. Their labels
come from page structure (``teacher``). Each page is read as it is and rebuilt in other
layouts, with neutral names and with menus, sidebars, notices, adverts, forms and reader
comments around and inside the article, so that the labels follow from several clues and
not from one element name. The weights have a fixed size and go to all tasks.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import chunked, column_set, texts_of
from hearthline.llm.html_blocks import Block, leaf_blocks

FIT_PAGES = 300
FIT_BYTES = 200_000
DEEP = (False, False, False, True, True)
HASHED = 128
RATES = 7
INPUTS = 2 * HASHED + RATES
HIDDEN = 16
EPOCHS = 16
BATCH = 32
SEED = 2

# Names that mark parts of a page.
BOILERPLATE = (
    "nav header footer aside form button select fieldset menu .ad .ads .advert .advertisement .banner .sidebar .comment"
    " .comments .cookie .consent .notice .alert .menu .nav .navbar .navigation .breadcrumb .breadcrumbs .promo .share"
    " .social .related .newsletter .subscribe .popup .modal .footer .header .masthead .toolbar .widget .pagination .login"
    " .search .sponsored .complementary .contentinfo .commentlist .discussion .reply .replies .disqus noscript template svg"
).split()
ARTICLE = "article main .article .main .content .post .entry .story .articlebody".split()
_OUT, _IN = frozenset(BOILERPLATE), frozenset(ARTICLE)


def teacher(path: tuple[str, ...]) -> bool:
    """Weak label of a block from the names it stands under."""
    return not _OUT.intersection(path) and bool(_IN.intersection(path))


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for at, block in enumerate(blocks):
        for name in set(block.path):
            out[at, zlib.crc32(name.encode()) % HASHED] = 1
        words = block.text.split()
        hashed = np.bincount([zlib.crc32(w.lower().encode()) % HASHED for w in words], minlength=HASHED)
        out[at, HASHED : 2 * HASHED] = hashed / max(1, len(words)) * 4
        size = len(block.text)
        out[at, 2 * HASHED :] = (
            np.log1p(size) / 6, np.log1p(len(words)) / 5, block.linked, at / max(1, len(blocks) - 1),
            sum(block.text.count(c) for c in ".,;!?") / max(1, len(words)), len(block.path) / 12,
            float(block.text[-1:] in ".!?"),
        )
    return out


# ---- layouts for training

# Short texts as page furniture holds.
FURNITURE = {
    "menu": "Home|News|Sport|About us|Contact|Archive|Login",
    "notice": "We use cookies to improve your visit.|Accept all|This site needs JavaScript.|Subscribe to our newsletter today",
    "share": "Share|Tweet|Print this page|Follow us",
    "form": "Your name|Email address|Send|Search this site",
    "footer": "Copyright All rights reserved|Privacy policy|Terms of use",
}
_CONTAINERS = {
    "menu": ("<nav>", '<div class="menu">', '<ul class="navbar">', '<div id="navigation">', "<header>", '<div class="header">'),
    "notice": ('<div class="cookie">', '<div class="notice">', '<div id="consent">', '<div class="alert">', '<div class="newsletter">', "<noscript>"),
    "share": ('<div class="share">', '<div class="social">', '<ul class="share">', "<svg>"),
    "form": ("<form>", '<form class="search">', '<div class="login">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="footer">', '<div role="contentinfo">'),
    "aside": ("<aside>", '<div class="sidebar">', '<div class="widget">', '<div class="related">', '<div class="promo">', "<template>"),
    "advert": ('<div class="ad">', '<div class="advert">', '<div class="sponsored">', '<div id="banner">'),
    "comments": ('<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div class="discussion">'),
}
_BODIES = ("<article>", "<main>", '<div class="content">', '<div class="post">', '<div class="entry">', '<div id="main">', '<section class="story">')


# Elements with names that tell nothing, as many pages nest them.
_NEUTRAL = (
    '<div class="row odd">', '<div class="col col-md-6 inner">', '<div class="grid wrap unit-12">', '<section class="box lead lg">',
    '<div id="u-42" class="flex stretch">', '<table class="table table-striped"><tbody><tr class="row odd"><td class="cell num">',
    '<ul class="list plain"><li class="item even">', '<dl class="pairs"><dd class="value text">',
)


def _deep(rng: np.random.Generator, inner: str) -> str:
    """The same within some nested elements."""
    for opening in rng.choice(_NEUTRAL, int(rng.integers(2, 6))):
        names = re.findall(r"<(\w+)", opening)
        inner = opening + inner + "".join(f"</{n}>" for n in reversed(names))
    return inner


def _wrapped(rng: np.random.Generator, kind: str, texts: Iterable[str], deep: bool = False) -> str:
    container = str(rng.choice(_CONTAINERS[kind]))
    inner = "p" if kind in ("comments", "aside", "advert", "notice") and rng.random() < 0.7 else "li" if rng.random() < 0.5 else "div"
    linked = kind in ("menu", "share", "footer") and rng.random() < 0.8
    parts = [f'<a href="#">{html.escape(t)}</a>' if linked else html.escape(t) for t in texts]
    name = container[1:].split()[0].rstrip(">")
    body = "".join(f"<{inner}>{p}</{inner}>" for p in parts)
    return container + (_deep(rng, body) if deep else body) + f"</{name}>"


def _paragraph(text: str, rng: np.random.Generator) -> str:
    kinds = ("p", "p", "p", "p", "div", "li", "blockquote", "pre")
    kind = str(rng.choice(("h2", "h3", "h4"))) if len(text) < 90 and rng.random() < 0.4 else str(rng.choice(kinds))
    return f"<{kind}>{html.escape(text)}</{kind}>"


def rebuilt(body: list[str], foreign: list[str], rng: np.random.Generator, deep: bool = False) -> str:
    """A page in a drawn layout: the body's blocks as article, furniture and other pages' blocks around it.

    Deep layouts hold the texts of both within further elements with classes.
    """
    def furniture(kind: str) -> str:
        texts = FURNITURE[kind].split("|") if kind in FURNITURE else []
        if not texts or rng.random() < 0.3:
            texts = [*texts, *rng.choice(foreign, int(rng.integers(1, 4)))]
        return _wrapped(rng, kind, rng.permutation(texts)[: int(rng.integers(1, 7))], deep)

    opening = str(rng.choice(_BODIES))
    inside = [_deep(rng, _paragraph(t, rng)) if deep else _paragraph(t, rng) for t in body]
    if body and rng.random() < 0.6:
        title = str(rng.choice(("h1", "h2")))
        inside.insert(0, f"<{title}>{html.escape(body[0][:60])}</{title}>")
    for kind in ("advert", "share", "aside", "notice"):
        if rng.random() < 0.25:
            inside.insert(int(rng.integers(0, len(inside) + 1)), furniture(kind))
    if rng.random() < 0.25:
        inside.append(_wrapped(rng, "comments", rng.choice(foreign, int(rng.integers(1, 5))), deep))
    before = [furniture(k) for k in ("notice", "menu", "advert", "form", "aside") if rng.random() < 0.5]
    after = [furniture(k) for k in ("share", "aside", "form", "notice", "footer") if rng.random() < 0.5]
    if rng.random() < 0.5:
        after.insert(0, _wrapped(rng, "comments", rng.choice(foreign, int(rng.integers(1, 6))), deep))
    name = opening[1:].split()[0].rstrip(">")
    wrapper = ("<div class='page'>", "</div>") if rng.random() < 0.4 else ("", "")
    return "<html><body>" + wrapper[0] + "".join(before) + opening + "".join(inside) + f"</{name}>" + "".join(after) + wrapper[1]


def training_set(pages: list[str], seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    parsed = [leaf_blocks(p) for p in pages]
    bodies = [[b.text for b in blocks if teacher(b.path)] for blocks in parsed]
    # A few made-up pages keep tables without usable ones from leaving the model untrained.
    for _ in range(max(0, 20 - len(bodies))):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(200)]
        bodies.append([" ".join(rng.choice(words, int(rng.integers(3, 80)))) + "." for _ in range(int(rng.integers(1, 10)))])
    bodies = [b for b in bodies if b]
    foreign = [t[:400] for b in bodies for t in b[:5]]
    sets = [blocks for blocks in parsed if blocks]
    for body in bodies:
        sets += [leaf_blocks(rebuilt(body[:30], foreign, rng, deep)) for deep in DEEP]
    return [(vectors(b), np.array([teacher(x.path) for x in b], np.float64)) for b in sets if b]


# ---- the network


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    weights = {"out": np.zeros(2 * HIDDEN), "bias": np.zeros(1)}
    for side in "lr":
        weights[f"{side}_in"] = rng.normal(0, INPUTS**-0.5, (INPUTS, 4 * HIDDEN))
        weights[f"{side}_back"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        weights[f"{side}_bias"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    weights["out"] = rng.normal(0, 0.3, 2 * HIDDEN)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(x: np.ndarray, live: np.ndarray, weights: dict[str, np.ndarray], side: str) -> tuple[np.ndarray, list]:
    """States for inputs (steps, pages, inputs); a page's state stays where it has no block."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    fed = x @ weights[f"{side}_in"] + weights[f"{side}_bias"]
    out, saved = np.zeros((steps, pages, HIDDEN)), []
    for t in range(steps) if side == "l" else range(steps - 1, -1, -1):
        z = fed[t] + h @ weights[f"{side}_back"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 3))
        g = np.tanh(z[:, 2 * HIDDEN : 3 * HIDDEN])
        new = f * c + i * g
        tanh = np.tanh(new)
        saved.append((t, h, c, i, f, g, o, tanh))
        on = live[t][:, None]
        h, c = np.where(on, o * tanh, h), np.where(on, new, c)
        out[t] = h
    return out, saved


def _back(x: np.ndarray, live: np.ndarray, weights: dict[str, np.ndarray], side: str, saved: list, d_out: np.ndarray, grads: dict) -> None:
    pages = x.shape[1]
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    d_fed = np.zeros((*x.shape[:2], 4 * HIDDEN))
    for t, h, c, i, f, g, o, tanh in reversed(saved):
        dh = dh + d_out[t]
        on = live[t][:, None]
        d_new = np.where(on, dc + dh * o * (1 - tanh * tanh), 0)
        d_gate = np.where(on, dh, 0)
        dz = np.hstack((d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_new * i * (1 - g * g), d_gate * tanh * o * (1 - o)))
        d_fed[t] = dz
        grads[f"{side}_back"] += h.T @ dz
        dh = np.where(on, 0, dh) + dz @ weights[f"{side}_back"].T
        dc = np.where(on, d_new * f, dc)
    grads[f"{side}_in"] += np.einsum("tpi,tpz->iz", x, d_fed)
    grads[f"{side}_bias"] += d_fed.sum(axis=(0, 1))


def _padded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in sets)
    x = np.zeros((steps, len(sets), INPUTS), np.float32)
    live = np.zeros((steps, len(sets)), bool)
    for at, own in enumerate(sets):
        x[: len(own), at], live[: len(own), at] = own, True
    return x, live


def probabilities(x: np.ndarray, live: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    left, _ = _run(x, live, weights, "l")
    right, _ = _run(x, live, weights, "r")
    return _sigmoid(np.concatenate((left, right), axis=2) @ weights["out"] + weights["bias"])


def fit(examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights after Adam over the examples; path names and words are dropped at random to spread the weight."""
    rng = np.random.default_rng(seed)
    weights = initial(rng)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    order = np.argsort([len(y) for _, y in examples], kind="stable")
    groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for at in rng.permutation(len(groups)):
            own = [examples[i] for i in groups[at]]
            x, live = _padded([a for a, _ in own])
            y, _ = _padded([np.repeat(b[:, None], INPUTS, 1) for _, b in own])
            x = x.copy()
            x[:, :, :HASHED] *= rng.random(x[:, :, :HASHED].shape) > 0.1
            x[:, :, HASHED : 2 * HASHED] *= rng.random((*x.shape[:2], 1)) > 0.5
            left, saved_l = _run(x, live, weights, "l")
            right, saved_r = _run(x, live, weights, "r")
            both = np.concatenate((left, right), axis=2)
            error = np.where(live, _sigmoid(both @ weights["out"] + weights["bias"]) - y[:, :, 0], 0) / live.sum()
            grads = {k: np.zeros_like(v) for k, v in weights.items()}
            grads["out"] += np.einsum("tp,tph->h", error, both)
            grads["bias"] += error.sum()
            d = error[:, :, None] * weights["out"]
            _back(x, live, weights, "l", saved_l, d[:, :, :HIDDEN], grads)
            _back(x, live, weights, "r", saved_r, d[:, :, HIDDEN:], grads)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return weights


def labelled(pages: list[list[Block]], weights: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For every page, whether each block is main text; pages of like length go together."""
    out = [np.empty(0, bool)] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
    for start in range(0, len(order), BATCH):
        own = order[start : start + BATCH]
        x, live = _padded([vectors(pages[i]) for i in own])
        chance = probabilities(x, live, weights)
        for at, i in enumerate(own):
            out[i] = chance[: len(pages[i]), at] >= 0.5
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, np.ndarray]:
    """Weights fitted on about ``FIT_PAGES`` pages of up to ``FIT_BYTES`` bytes, whatever the table's size."""
    share = FIT_PAGES / max(1, pages.count())
    usable = pages.where(F.octet_length(html_col) <= FIT_BYTES)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.octet_length(html_col)), F.lit(1 << 20)) / (1 << 20)
    rows = usable.where(draw < share).select(F.col(f"`{html_col}`").alias("html")).collect()
    return fit(training_set(sorted(r["html"] for r in rows)))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, blocks) per row: the main text, its blocks on lines of their own, and all blocks' number.

    Null and empty pages, and pages without main text, give an empty text. Repeated rows
    are treated alike. The whole page is read, whatever its length.
    """
    weights = train(pages, id_col, html_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "_html"):
            blocks = [leaf_blocks(t.decode()) for t in texts_of(batch, "_html")]
            marks = labelled(blocks, weights)
            texts = ["\n".join(b.text for b, on in zip(p, m, strict=True) if on) for p, m in zip(blocks, marks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array([len(p) for p in blocks], pa.int32())],
                ["_id", "_url", "text", "blocks"],
            )

    source = column_set(pages, id_col, url_col, html_col).toDF("_id", "_url", "_html").withColumn("_id", F.col("_id").cast("long"))
    done = source.mapInArrow(run, "_id long, _url string, text string, blocks int")
    return done.withColumnsRenamed({"_id": id_col, "_url": url_col})
