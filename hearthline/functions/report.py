"""Plain-text reports from titled lists of lines."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def rendered(head: Iterable[str], sections: Mapping[str, Iterable[str]]) -> str:
    """Head lines, then every section with its lines indented below a title."""
    lines = list(head)
    for title, own in sections.items():
        lines += ["", title, *(f"  {line}" for line in own)]
    return "\n".join(lines)


def numbered(texts: Iterable[str]) -> list[str]:
    return [f"{i}. {text}" for i, text in enumerate(texts, 1)]
