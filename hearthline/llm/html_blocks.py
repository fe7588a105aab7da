"""Leaf blocks of a web page in page order: text, path of open elements, share of link text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title textarea iframe".split())
# Parts of their own, apart from the text around them; without an end tag they are none.
APART = frozenset("noscript template svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span"
    " strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mspace mpadded"
    " mphantom merror menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics"
    " annotation".split()
)
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.DOTALL)
_APART = re.compile(f"<(?:{'|'.join(sorted(APART))})", re.IGNORECASE)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float


class _Collector:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.pieces: list[str] = []
        self.links = self.linked = 0
        self.around: list[tuple[int, int, list[str], int, int]] = []

    def text(self, raw: str) -> None:
        self.pieces.append(raw)
        if self.links:
            self.linked += len(raw)

    def flush(self, at: int | None = None) -> None:
        raw = "".join(self.pieces)
        text = " ".join(html.unescape(raw).split())
        if text:
            path = tuple(name for _, names in self.stack for name in names)
            block = Block(text, path, min(1.0, self.linked / max(1, len(raw))))
            self.blocks.insert(len(self.blocks) if at is None else at, block)
        self.pieces, self.linked = [], 0

    def close(self, name: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == name:
                self.cut(at)
                return

    def cut(self, depth: int) -> None:
        """Elements from this depth on end; text begun before a part of its own comes before that part's."""
        while self.around and self.around[-1][0] >= depth:
            own, at, *begun = self.around.pop()
            del self.stack[own:]
            self.pieces, self.linked, self.links = begun
            if own > depth:
                self.flush(at)
        del self.stack[depth:]

    def apart(self, name: str, attributes: str) -> None:
        """A part within a text, which goes on after it."""
        self.around.append((len(self.stack), len(self.blocks), self.pieces, self.linked, self.links))
        self.pieces, self.linked, self.links = [], 0, 0
        self.push(name, attributes)

    def push(self, name: str, attributes: str) -> None:
        marks = " ".join("".join(m) for m in _NAMES.findall(attributes)).lower()
        self.stack.append((name, (name, *(f".{m}" for m in re.findall(r"[a-z]+|\d+", marks)))))

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.links = 1
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                self.text(" ")
            return
        self.flush()
        self.links = 0
        if name in VOID:
            return
        # A block element ends an open paragraph; some elements end one of their kind.
        if self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        elif name in CLOSED_BY_SAME and self.stack and self.stack[-1][0] == name:
            self.stack.pop()
        self.push(name, attributes)

    def end(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name not in INLINE:
            self.flush()
            self.close(name)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw, ""), ("start", name, attributes) and ("end", name, "") in page order."""
    at, size = 0, len(page)
    while at < size:
        opening = page.find("<", at)
        if opening < 0:
            yield "text", page[at:], ""
            break
        if opening > at:
            yield "text", page[at:opening], ""
        tag = _TAG.match(page, opening)
        if not tag:
            yield "text", "<", ""
            at = opening + 1
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            yield "end", name, ""
        elif name in SKIPPED and not tag[3].endswith("/"):
            closing = re.compile(f"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(page, at)
            at = closing.end() if closing else size
        else:
            yield "start", name, tag[3]


def _ended(page: str) -> set[int]:
    """Numbers of the tokens that start a part of its own which has an end tag."""
    found, open_at = set(), {name: [] for name in APART}
    for number, (kind, name, attributes) in enumerate(_tokens(page)):
        if name in APART and kind == "start" and not attributes.endswith("/"):
            open_at[name].append(number)
        elif name in APART and kind == "end" and open_at[name]:
            found.add(open_at[name].pop())
    return found


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text between block elements; scripts, styles, titles and comments are none.

    White space inside a block, line breaks too, is one blank. Unclosed elements end with
    the page; an unclosed script or style runs to its end, as in a browser. A noscript,
    template or svg element is a part of its own if it has an end tag, else it is ignored.
    """
    found = _Collector()
    ended = _ended(page) if _APART.search(page) else set()
    for number, (kind, name, attributes) in enumerate(_tokens(page)):
        if kind == "text":
            found.text(name)
        elif name in APART:
            if number in ended:
                found.apart(name, attributes)
            elif kind == "end" and any(n == name for n, _ in found.stack):
                found.flush()
                found.close(name)
        elif kind == "end":
            found.end(name)
        elif attributes.endswith("/") and any(n == "svg" for n, _ in found.stack):
            found.flush()
        else:
            found.start(name, attributes)
    found.flush()
    found.cut(0)
    found.flush()
    return found.blocks
