"""Further candidates from a callable, such as a local model: what it is given and what of its answer is believed.

Segments go out in chunks with everything that has been found already masked. An answer counts only if it is well
formed; every value must stand in the chunk as it is. What is new is what no earlier finding covers. The callable is
injected and off by default; :func:`loopback` is for those that speak HTTP, and lets nothing but the own machine be asked.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable, Iterable
from urllib.parse import urlsplit

from veilframe.config import Config, plain
from veilframe.functions.lexicon import ORG_NOT, ORG_ROLES
from veilframe.operators.context import has_pseudonym

MASK = "[가림]"
SHORTEST, LONGEST = 2, 60
# What a candidate may be, and which of them must or must not hold digits.
TYPES = "person org dept address birth title quasi"
NO_DIGITS, DIGITS = "person org dept title", "birth"
LIKELY, REVIEW = "추정", "검토"


class Refused(ValueError):
    """An endpoint that is not on this machine."""


class Unusable(ValueError):
    """An answer that is not of the agreed form; its chunk counts as failed."""


def loopback(url: str) -> str:
    """The endpoint, if it is plain HTTP to this machine without credentials; else :class:`Refused`."""
    u = urlsplit(url)
    host = u.hostname or ""
    try:
        local = host == "localhost" or ipaddress.ip_address(host).is_loopback
    except ValueError:
        local = False
    if u.scheme != "http" or not local or u.username or u.password or u.query or u.fragment:
        raise Refused("only http to this machine is asked")
    return url


def masked(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text with what is known already put out of sight."""
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + MASK + text[b:]
    return text


def parsed(answer: str) -> list[dict]:
    """Items {type, text} of an answer: a JSON list, or an object with such a list under items."""
    try:
        raw = json.loads(answer)
    except (TypeError, ValueError) as e:
        raise Unusable("no JSON") from e
    items = raw.get("items") if isinstance(raw, dict) else raw
    if not isinstance(items, list) or any(not isinstance(i, dict) or not isinstance(i.get("text"), str) or i.get("type") not in TYPES.split() for i in items):
        raise Unusable("not of the agreed form")
    return items


def believed(items: list[dict], chunk: str, config: Config = Config()) -> list[dict]:
    """Items that stand in the chunk as they are, are of a possible length and shape, and are neither allowed nor pseudonyms."""
    out = []
    for i in items:
        v, kind = i["text"].strip(), i["type"]
        digits = any(map(str.isdigit, v))
        if not SHORTEST <= len(v) <= LONGEST or v not in chunk or MASK in v or has_pseudonym(v) or plain(v) in config.allow:
            continue
        if kind in NO_DIGITS.split() and digits or kind in DIGITS.split() and not digits:
            continue
        if kind == "org" and (v in ORG_NOT.split() or v.endswith("연구원") and v[:-3].endswith(tuple(ORG_ROLES.split()))):
            continue
        out.append({"type": kind, "text": v})
    return out


def minus(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of [a, b) outside the taken spans."""
    out = []
    for x, y in sorted(taken):
        if y <= a or b <= x:
            continue
        if x > a:
            out.append((a, x))
        a = max(a, y)
    return [*out, (a, b)] if a < b else out


def placed(text: str, items: list[dict], taken: list[tuple[int, int]], replace_orgs: bool = False) -> list[tuple[int, int, str, str, str]]:
    """Findings (start, end, category, grade, note) for every place of the items outside what is taken. Blank rests are none."""
    out: list[tuple[int, int, str, str, str]] = []
    taken = list(taken)
    for i in sorted(items, key=lambda x: (-len(x["text"]), x["text"])):
        if i["type"] == "quasi":
            continue
        for m in re.finditer(re.escape(i["text"]), text):
            for a, b in minus(*m.span(), taken):
                if len(text[a:b].strip()) >= SHORTEST:
                    out.append((a, b, i["type"], REVIEW if i["type"] == "org" and not replace_orgs else LIKELY, "모델 후보"))
                    taken.append((a, b))
    return sorted(out)


def ask(texts: list[tuple[str, list[tuple[int, int]]]], provider: Callable[[str], str], config: Config = Config(), replace_orgs: bool = False) -> tuple[list[list[tuple]], list[str], bool]:
    """One chunk of segments (text, taken spans): findings of each, what only hints at a person, and whether the chunk failed."""
    shown = "\n".join(masked(t, taken) for t, taken in texts)
    try:
        items = believed(parsed(provider(shown)), shown, config)
    except (Unusable, OSError):
        return [[] for _ in texts], [], True
    return [placed(t, items, taken, replace_orgs) for t, taken in texts], [i["text"] for i in items if i["type"] == "quasi"], False


def candidates(segments, findings, provider: Callable[[str], str], config: Config = Config(), size: int = 500, replace_orgs: bool = False):
    """(findings, failed chunks): rows like those of detection for what the provider adds, and rows (doc_id, chunk, level, code) that block.

    ``segments`` and ``findings`` are those of detection. Findings are added after the merge and not merged again. Chunks
    are those of :func:`veilframe.sources.text.chunks`; each is one call.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    from veilframe.session import ensure_checkpoint_dir
    from veilframe.sources import text as source

    ensure_checkpoint_dir(segments.sparkSession)
    chunk = source.chunks(segments, size, skip=F.col("table_ctx.is_header"))
    known = findings.groupBy("seg_key").agg(F.collect_list(F.struct("start_pos", "end_pos")).alias("taken"))
    own = segments.select("seg_key", "doc_id", "seg_id", "part", "ord", "text").join(chunk, ["doc_id", "seg_id"]).join(known, "seg_key", "left")
    schema = "seg_key long, doc_id string, seg_id string, part string, start_pos int, end_pos int, category string, grade string, note string, value string, chunk long, failed boolean"

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "seg_id"])
        texts = [(t, [(s["start_pos"], s["end_pos"]) for s in (k if k is not None else [])]) for t, k in zip(frame["text"], frame["taken"], strict=True)]
        found, _, failed = ask(texts, provider, config, replace_orgs)
        rows = [(r.seg_key, r.doc_id, r.seg_id, r.part, a, b, c, g, n, r.text[a:b], key[1], False) for r, fs in zip(frame.itertuples(index=False), found, strict=True) for a, b, c, g, n in fs]
        if failed:
            rows.append((None, key[0], None, None, None, None, None, None, None, None, key[1], True))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
        return out.astype({"seg_key": "Int64", "start_pos": "Int32", "end_pos": "Int32"})

    every = own.groupBy("doc_id", "chunk").applyInPandas(run, schema).checkpoint()
    new = every.filter("not failed").select("seg_key", "doc_id", "seg_id", "part", "start_pos", "end_pos", "category", "grade", F.array(F.lit("L4")).alias("detectors"), "note", "value")
    return new, every.filter("failed").select("doc_id", "chunk", F.lit("block").alias("level"), F.lit("chunk-failed").alias("code"))
