"""The second look at finished files: every part flattened, read as text, scanned and searched for known values.

Nothing is trusted: zips in zips are opened, member names are read, what is no XML is decoded in several ways. What
cannot be opened within the bounds is an error, and an error blocks.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.config import Config
from veilframe.operators import audit, merge, rules, values
from veilframe.sources import xmltext

# How deep zips are opened, the largest part, the shortest stretch and the longest attribute that are scanned.
DEEPEST, LARGEST = 3, 64 << 20
SHORTEST, LONGEST_ATTRIBUTE = 4, 200
ENCODINGS = ("utf-8", "utf-16-le", "cp949")


class Unopened(ValueError):
    pass


@dataclass
class Part:
    name: str
    text: str
    is_xml: bool


def parts(name: str, content: bytes, depth: int = 0) -> list[Part]:
    """Every part of a file as text: members of zips within zips, their names, other content in each encoding that reads it."""
    if len(content) > LARGEST:
        raise Unopened("too large")
    if content[:4] == b"PK\x03\x04":
        if depth >= DEEPEST:
            raise Unopened("nested too deep")
        out = []
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if info.file_size > LARGEST:
                    raise Unopened("too large")
                out.append(Part(f"{name}>name", info.filename, False))
                out += parts(f"{name}>{info.filename}", z.read(info), depth + 1)
        return out
    if content.lstrip()[:1] == b"<" or name.endswith((".xml", ".rels", ".hpf")):
        return [Part(name, content.decode("utf-8-sig", "replace"), True)]
    out = []
    for e in ENCODINGS:
        try:
            out.append(Part(f"{name}:{e}", content.decode(e), False))
        except UnicodeDecodeError:
            continue
    return out


def stretches(part: Part) -> list[str]:
    """What is scanned of a part: text between tags, attributes that may hold content, or lines."""
    if part.is_xml:
        found = xmltext.chunks(part.text)
        found += [v for _, v, _, _ in xmltext.attribute_values(part.text) if len(v) <= LONGEST_ATTRIBUTE and (re.search("[가-힣@]", v) or " " in v)]
    else:
        found = part.text.split("\n")
    lines = (line.strip() for c in found for line in c.split("\n"))
    return [x for x in lines if len(x) >= SHORTEST]


def look(name: str, content: bytes, originals: list[str], config: Config = Config()) -> dict:
    """The verdict on one file: findings of values and rules, known values that are left, errors. It passes if there is none."""
    found: list[str] = []
    left: set[str] = set()
    error, as_of = None, dt.date.fromisoformat(config.as_of)
    try:
        every = parts(name, content)
    except (Unopened, zipfile.BadZipFile, RuntimeError, OSError) as e:
        every, error = [], type(e).__name__
    for p in every:
        utf8 = not p.name.endswith(ENCODINGS[1:])
        for s in stretches(p):
            if utf8:
                candidates = [{"start_pos": a, "end_pos": b, "category": c, "grade": g, "note": n, "detectors": [d]} for d, fs in (("rule", rules.find(s, config)), ("L1", values.find(s, as_of=as_of))) for a, b, c, g, n in fs]
                kept = merge.fold(merge.allowed(candidates, s, frozenset(config.allow), config.categories))
                found += [f["category"] for f in kept if not config.strict_only or f["grade"] == merge.CERTAIN]
            left.update(audit.leak_hits(s, originals))
    return {"rescans": len(found), "leaks": len(left), "error": error, "passed": not found and not left and error is None}


def looked(files: DataFrame, originals: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows (doc_id, path, rescans, leaks, error, passed) for finished files (doc_id, path, content).

    ``originals`` (doc_id, original) are the values replaced in each document; a document's own are searched for in it.
    """
    per = originals.groupBy("doc_id").agg(F.collect_set("original").alias("os"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(d, p, *look(p, c or b"", list(o) if o is not None else [], config).values()) for d, p, c, o in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "rescans", "leaks", "error", "passed"])

    return files.select("doc_id", "path", "content").join(per, "doc_id", "left").select("doc_id", "path", "content", "os").mapInPandas(run, "doc_id string, path string, rescans long, leaks long, error string, passed boolean")


def looked_for(files: DataFrame, known: list[str], config: Config = Config()) -> DataFrame:
    """The same with one list of values for all files (path, content), given by the caller."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(p, *look(p, c or b"", known, config).values()) for p, c in frame.itertuples(index=False)], columns=["path", "rescans", "leaks", "error", "passed"])

    return files.select("path", "content").mapInPandas(run, "path string, rescans long, leaks long, error string, passed boolean")
