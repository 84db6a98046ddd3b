"""The text of an XML member by paragraphs, each character with its place in the markup, so that it can be written back.

The markup is cut into tags and text by one expression (comments, CDATA and processing instructions included); nothing
is parsed into a tree and nothing outside the edited text changes, not even a prefix or a blank.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_PART = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<(?P<end>/?)(?P<name>[^\s/>]+)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.S)
_ATTR = re.compile(r"([^\s=]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


@dataclass
class Paragraph:
    """A paragraph's text; pieces are (text start, length, markup start, markup end, editable)."""

    element: str
    text: str = ""
    pieces: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    path: tuple[str, ...] = ()

    def add(self, text: str, a: int, b: int, editable: bool) -> None:
        self.pieces.append((len(self.text), len(text), a, b, editable))
        self.text += text


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


#: Elements that stand for a character of the text.
SIGNS = {"tab": "\t", "br": "\n", "cr": "\n", "lineBreak": "\n", "noBreakHyphen": "-"}
#: Elements whose text is read, and those that hold it together.
TEXTS = frozenset("t v f delText instrText".split())
HOLDERS = frozenset("p si is".split())


def paragraphs(xml: str, holders: frozenset[str] = HOLDERS, texts: frozenset[str] = frozenset(("t",))) -> list[Paragraph]:
    """Paragraphs in the order in which they begin; text belongs to the innermost."""
    out: list[Paragraph] = []
    open_: list[Paragraph] = []
    stack: list[str] = []
    at = 0
    for m in [*_PART.finditer(xml), None]:
        a = m.start() if m else len(xml)
        if a > at and open_ and stack and stack[-1] in texts:
            open_[-1].add(html.unescape(xml[at:a]), at, a, True)
        if m is None:
            break
        at = m.end()
        if m["cdata"] is not None and open_ and stack and stack[-1] in texts:
            open_[-1].add(m["cdata"], m.start(), m.end(), True)
        if not m["name"]:
            continue
        name = local(m["name"])
        if m["end"]:
            if name in stack:
                while stack.pop() != name:
                    pass
            if name in holders and open_:
                open_.pop()
        elif name in SIGNS and open_:
            open_[-1].add(SIGNS[name], m.start(), m.end(), False)
            if not m["empty"]:
                stack.append(name)
        elif not m["empty"]:
            if name in holders:
                open_.append(Paragraph(name, path=tuple(stack)))
                out.append(open_[-1])
            stack.append(name)
    return out


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def edits(p: Paragraph, spans: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Markup edits for replacements in a paragraph's text, and the spans that cannot be made.

    The first piece that a span covers takes the replacement, the others lose what it covers. A span over a tab or a
    break crosses a hard border and is refused, unless the replacement says so by being of the form (start, end, text, True).
    """
    out, refused = [], []
    new = {i: list(p.text[s : s + n]) for i, (s, n, *_rest) in enumerate(p.pieces)}
    touched = set()
    for span in sorted(spans, key=lambda x: -x[0]):
        a, b, text, across = (*span, False)[:4]
        over = [i for i, (s, n, *_r) in enumerate(p.pieces) if s < b and a < s + n]
        if not over or not across and not all(p.pieces[i][4] for i in over) or not any(p.pieces[i][4] for i in over):
            refused.append((a, b))
            continue
        first = next(i for i in over if p.pieces[i][4])
        for i in over:
            s, n, _, _, editable = p.pieces[i]
            if editable:
                lo, hi = max(a - s, 0), min(b - s, n)
                new[i][lo:hi] = [text] if i == first else []
                # later spans lie before this one, so places up to ``lo`` still hold
                touched.add(i)
    for i in touched:
        out.append((p.pieces[i][2], p.pieces[i][3], escape("".join(new[i]))))
    return out, refused


def patched(xml: str, changes: list[tuple[int, int, str]]) -> str:
    """The markup with stretches replaced, from the end."""
    for a, b, text in sorted(changes, reverse=True):
        xml = xml[:a] + text + xml[b:]
    return xml


def attribute_values(xml: str) -> list[tuple[str, str, int, int]]:
    """(name, value, start, end) of every attribute; the place is that of the raw value without its quotes."""
    out = []
    for m in _PART.finditer(xml):
        if m["name"] and not m["end"]:
            base = m.start("rest")
            out += [(local(x[1]), html.unescape(x[2][1:-1]), base + x.start(2) + 1, base + x.end(2) - 1) for x in _ATTR.finditer(m["rest"]) if not x[1].startswith("xmlns")]
    return out


def chunks(xml: str) -> list[str]:
    """The stretches of text between tags."""
    out, at = [], 0
    for m in _PART.finditer(xml):
        out.append(html.unescape(xml[at : m.start()]))
        if m["cdata"]:
            out.append(m["cdata"])
        at = m.end()
    return [*out, html.unescape(xml[at:])]
