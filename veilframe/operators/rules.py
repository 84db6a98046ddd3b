"""The user's own deny list and rules over one text."""

from __future__ import annotations

import re
from functools import lru_cache

from veilframe.config import Config, Rule

Found = tuple[int, int, str, str, str]


@lru_cache(maxsize=8)
def _compiled(deny: tuple[tuple[str, str], ...], rules: tuple[Rule, ...]):
    category = {v: c for v, c in reversed(deny) if v}
    values = re.compile("|".join(map(re.escape, sorted(category, key=lambda v: (-len(v), v))))) if category else None
    return category, values, [(r, re.compile(r.context) if r.context else None, re.compile(r.pattern) if r.pattern else None) for r in rules]


def find(text: str, config: Config) -> list[Found]:
    """Every literal of the deny list (the longest at a place), then each rule's literals and pattern matches; blanks are none."""
    category, values, rules = _compiled(config.deny, config.rules)
    out: list[Found] = [(*m.span(), category[m[0]], "확실", "금칙어") for m in values.finditer(text)] if values else []
    for r, context, pattern in rules:
        if context and not context.search(text):
            continue
        for literal in r.literals:
            at = text.find(literal) if literal else -1
            while at >= 0:
                out.append((at, at + len(literal), r.category, r.grade, r.name))
                at = text.find(literal, at + len(literal))
        for m in pattern.finditer(text) if pattern else ():
            span = m.span(1) if pattern.groups and m[1] is not None else m.span()
            if span[1] > span[0]:
                out.append((*span, r.category, r.grade, r.name))
    return [f for f in out if text[f[0] : f[1]].strip()]
