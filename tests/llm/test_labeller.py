import numpy as np
import pytest

from hearthline.llm import labeller
from hearthline.llm.html_blocks import leaf_blocks


def page(body, extra=""):
    return f"<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1>{body}</article>{extra}<footer>&copy; all</footer></body></html>"


def test_blocks():
    html = (
        "<!DOCTYPE html><title>no</title><style>p{}</style><script>var t='</p><p>x';</script><!-- <p>no</p> --><p>One &amp;\n two<br>three"
        "<p><b>Four</b> &nbsp;five &#233;&#x41;<div>six<span>teen</span></div>5 < 6 <textarea>no</textarea><ul><li>a<li>b</ul>tail &am"
    )
    assert [b.text for b in leaf_blocks(html)] == ["One & two three", "Four five éA", "sixteen", "5 < 6", "a", "b", "tail &am"]
    assert [b.text for b in leaf_blocks("<p>cut <b>off <script>never closed")] == ["cut off"]
    assert leaf_blocks("") == [] and leaf_blocks(" \n") == []
    assert leaf_blocks("<nav class='Top-Menu' id=m>x</nav>")[0].path == ("nav", ".top", ".menu", ".m")
    assert leaf_blocks("<p>a <a href='>'>link</a>")[0].linked > 0.5


def test_gradients():
    rng = np.random.default_rng(0)
    weights = labeller.initial(rng)
    x = rng.normal(size=(4, 3, labeller.INPUTS))
    live = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    d_out = rng.normal(size=(4, 3, labeller.HIDDEN)) * live[:, :, None]
    for side in "lr":
        def loss():
            return (labeller._run(x, live, weights, side)[0] * d_out).sum()

        grads = {k: np.zeros_like(v) for k, v in weights.items()}
        labeller._back(x, live, weights, side, labeller._run(x, live, weights, side)[1], d_out, grads)
        for name, at in ((f"{side}_in", (3, 5)), (f"{side}_back", (2, 40)), (f"{side}_bias", (17,))):
            weights[name][at] += 1e-5
            high = loss()
            weights[name][at] -= 2e-5
            low = loss()
            weights[name][at] += 1e-5
            assert abs((high - low) / 2e-5 - grads[name][at]) < 1e-5


@pytest.fixture(scope="module")
def pages(prose):
    return [page("".join(f"<p>{prose(30, 10 * i + k)}.</p>" for k in range(1 + i % 7)), f"<div class=ad>{prose(8, i)}</div>") for i in range(60)]


def test_held_out_layouts(pages):
    weights = labeller.fit(labeller.training_set(pages[:40]))
    bodies = [[b.text for b in leaf_blocks(p) if labeller.teacher(b.path)] for p in pages[40:]]
    foreign = [t for b in bodies for t in b]
    rng = np.random.default_rng(123)
    test = [leaf_blocks(labeller.rebuilt(b, foreign, rng)) for b in bodies for _ in range(3)]
    wrong = sum((m != [labeller.teacher(b.path) for b in t]).sum() for t, m in zip(test, labeller.labelled(test, weights), strict=True))
    assert wrong < 0.05 * sum(map(len, test))


def test_table(spark, pages, prose):
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<nav>only a menu</nav>"), (3, "u3", pages[3]), (None, "n", pages[4])]
    rows.append((103, "long", page("".join(f"<p>{prose(40, i)}.</p>" for i in range(400)))))
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, blocks int")
    found = labeller.main_text(table).select("page_id", "url", "text").collect()
    assert len(found) == len(rows)
    by = {(r.page_id, r.url): r.text for r in found}
    assert by[(100, None)] == by[(101, "u")] == by[(102, "u")] == ""
    right = sum(by[(i, u)] == "\n".join(b.text for b in leaf_blocks(p) if labeller.teacher(b.path)) for i, u, p in rows if p)
    assert right >= len(rows) - 5
    assert len(by[(103, "long")].split("\n")) >= 395
    assert labeller.main_text(table.limit(0)).count() == 0


def test_parts_without_end_tag_cost_no_text():
    for name in ("noscript", "template", "svg", "math", "object"):
        assert [b.text for b in leaf_blocks(f"<article><p>one</p><{name}><p>two</p><p>three</p></article>end")] == ["one", "two", "three", "end"]
    assert leaf_blocks("<article><svg><p>two</p></article>")[0].path == ("article", "p")
    blocks = leaf_blocks("<p>a <svg><g><svg><text>x</text></svg><text>y</text><path d=''/></g></svg> b <math><mi>c</mi><mo>=</mo><mn>1</mn></math> <object>d</object></p>")
    assert [(b.text, "svg" in b.path) for b in blocks] == [("x", True), ("y", True), ("a b c=1 d", False)]
    assert not any(labeller.teacher(b.path) for b in leaf_blocks("<article><noscript>turn it on</noscript></article>"))
    assert [b.text for b in leaf_blocks("<div>a<svg>b</div>c</svg>d")] == ["a", "b", "cd"]


def test_deep_layouts(pages):
    cell = "<table class='table table-striped'><tbody><tr class='row odd'><td class='cell num'><div><p>text</p></div></table>"
    inside, beside = (labeller.vectors(leaf_blocks(f"<{n}>{cell}</{n}>")) for n in ("article", "aside"))
    assert (inside != beside).any()
    weights = labeller.fit(labeller.training_set(pages[:40]))
    bodies = [[b.text for b in leaf_blocks(p) if labeller.teacher(b.path)] for p in pages[40:]]
    foreign = [t for b in bodies for t in b]
    rng = np.random.default_rng(321)
    test = [leaf_blocks(labeller.rebuilt(b, foreign, rng, True)) for b in bodies for _ in range(3)]
    wrong = sum((m != [labeller.teacher(b.path) for b in t]).sum() for t, m in zip(test, labeller.labelled(test, weights), strict=True))
    assert wrong < 0.05 * sum(map(len, test))
