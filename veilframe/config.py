"""What a user may set: categories, lists of values to keep or to catch, rules of their own.

A folder holds ``settings.yaml`` (a map), ``allowlist.txt`` (one value a line, ``#`` comments), ``denylist.txt``
(``value,category``, category confidential if left out) and ``confidential_rules.yaml`` (a list of rules). A file that is
absent leaves its part empty. An unknown category, grade or setting raises :class:`ConfigError`, whose message names the
file and the key but no value of a list.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace

# The categories, those that are off unless switched on, and the grades.
CATEGORIES = "person rrn foreign_id passport driver phone tel email card account address birth vehicle handle org dept title bizno corpno project_no budget confidential"
OFF = "title"
GRADES = ("확실", "추정", "검토")
SETTINGS = "categories replace_likely strict_only mask mask_char pseudonym_format keep_reports"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    """A rule of the user's: literals, then a pattern (its first group, if it has one), where the context matches the text."""

    name: str
    category: str = "confidential"
    pattern: str = ""
    literals: tuple[str, ...] = ()
    context: str = ""
    grade: str = "확실"


# Sample rules a user may take over.
SAMPLE_RULES = (
    Rule("NTIS number", "project_no", r"(?<!\d)\d{10}(?!\d)", context="NTIS|과제고유번호"),
    Rule("project number", "project_no", r"과제\s*번호\s*[:：]\s*([A-Za-z0-9\-]{6,})"),
    Rule("budget", "budget", r"(?<!\d)\d{1,3}(?:,\d{3})+\s*(?:천원|만원|백만원|억원|원)", context="예산|연구비|사업비|인건비"),
)


@dataclass(frozen=True)
class Config:
    categories: frozenset[str] = frozenset(CATEGORIES.split()) - frozenset(OFF.split())
    allow: tuple[str, ...] = ()
    deny: tuple[tuple[str, str], ...] = ()
    rules: tuple[Rule, ...] = ()
    replace_likely: bool = True
    strict_only: bool = False
    mask: str | None = None
    as_of: str = "2026-01-01"
    extra: tuple = field(default=())

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def plain(value: str) -> str:
    """White space collapsed and trimmed: how values of the allow list are held against findings."""
    return " ".join(value.split())


def _category(value: object, where: str) -> str:
    if value not in CATEGORIES.split():
        raise ConfigError(f"unknown category in {where}")
    return str(value)


def _lines(path: str) -> list[str]:
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8-sig") as f:
        return [x for x in (line.strip() for line in f) if x and not x.startswith("#")]


def _yaml(path: str):
    if not os.path.exists(path):
        return None
    import yaml

    try:
        with open(path, encoding="utf-8-sig") as f:
            return yaml.safe_load(f)
    except yaml.YAMLError as e:
        raise ConfigError(f"{os.path.basename(path)} cannot be read") from e


def rule(raw: dict, where: str) -> Rule:
    if not isinstance(raw, dict) or not raw.get("name"):
        raise ConfigError(f"a rule without a name in {where}")
    out = Rule(str(raw["name"]), _category(raw.get("category", "confidential"), where), str(raw.get("pattern") or ""), tuple(map(str, raw.get("literals") or ())), str(raw.get("context") or ""), str(raw.get("grade") or "확실"))
    if out.grade not in GRADES:
        raise ConfigError(f"unknown grade in {where}")
    for p in (out.pattern, out.context):
        try:
            re.compile(p)
        except re.error as e:
            raise ConfigError(f"a pattern of rule {out.name} in {where} is no regular expression") from e
    return out


def load(folder: str) -> Config:
    """The configuration in a folder."""
    at = lambda name: os.path.join(folder, name)
    settings = _yaml(at("settings.yaml")) or {}
    if not isinstance(settings, dict):
        raise ConfigError("settings.yaml is no map")
    for k in settings:
        if k not in SETTINGS.split():
            raise ConfigError(f"unknown setting {k} in settings.yaml")
    on = set(Config.categories)
    for name, use in (settings.get("categories") or {}).items():
        (on.add if use else on.discard)(_category(name, "settings.yaml"))
    deny = []
    for line in _lines(at("denylist.txt")):
        value, _, category = line.rpartition(",") if "," in line else (line, "", "")
        deny.append((value.strip(), _category(category.strip() or "confidential", "denylist.txt")))
    rules = _yaml(at("confidential_rules.yaml")) or []
    return Config(
        frozenset(on), tuple(sorted({plain(x) for x in _lines(at("allowlist.txt"))})), tuple(sorted(deny, key=lambda x: (-len(x[0]), x))),
        tuple(rule(r, "confidential_rules.yaml") for r in rules), bool(settings.get("replace_likely", True)), bool(settings.get("strict_only", False)),
        str(settings.get("mask_char", "*")) if settings.get("mask") else None,
    )
