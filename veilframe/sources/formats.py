"""Files of any known format as segments, and back: a table of handlers by suffix.

A handler reads a file's bytes into rows (seg_id, part, kind, text, table, pieces) and writes the bytes again with the
planned replacements. A suffix without a handler, a missing library, a file that cannot be read - each gives one row
with ``error`` set, so that nothing unread is ever taken for clean. :func:`register` adds a handler.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sinks import office as office_sink
from veilframe.sinks.text import _lines, _rows
from veilframe.sources import office

# Suffixes of text that is read line by line, of separated values, and of formats whose library may be absent.
LINES = "md txt markdown html htm json jsonl yaml yml log tex rst srt vtt"
SEPARATED = {"csv": ",", "tsv": "\t"}
NEEDS_LIBRARY = "pdf hwp"
CELL = "struct<table_id:string,row_no:int,col_no:int,row_span:int,col_span:int,header_text:string,header_axis:string,is_header:boolean>"
PIECES = "array<struct<node:string,slot:string,start_pos:int,length:int,editable:boolean,soft:boolean,node_offset:int>>"
SCHEMA = f"doc_id string, seg_id string, ord int, part string, kind string, text string, table_ctx {CELL}, pieces {PIECES}, error string"
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_RULE = re.compile(r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$")


@dataclass(frozen=True)
class Handler:
    """read(path, content) gives segment rows; write(path, content, plans) gives (content, reasons to block)."""

    read: Callable[[str, bytes], list[dict]]
    write: Callable[[str, bytes, list[dict], list[tuple[str, str]]], tuple[bytes, list[str]]] | None


def _segment(seg_id: str, text: str, kind: str = "line", part: str = "", cell: tuple | None = None, node: str = "", offset: int = 0) -> dict:
    ctx = None if cell is None else dict(zip(("table_id", "row_no", "col_no", "row_span", "col_span", "header_text", "header_axis", "is_header"), cell, strict=True))
    piece = {"node": node, "slot": kind, "start_pos": 0, "length": len(text), "editable": True, "soft": False, "node_offset": offset}
    return {"seg_id": seg_id, "part": part, "kind": kind, "text": text, "table_ctx": ctx, "pieces": [piece]}


def text_rows(text: str) -> list[dict]:
    """Lines, and the cells of Markdown tables in place of their lines."""
    lines = text.split("\n")
    out, heads, table, row = [], [], 0, -1
    for i, line in enumerate(lines):
        bare = line.removesuffix("\r")
        opens = row < 0 and _ROW.match(bare) and not _RULE.match(bare) and i + 1 < len(lines) and _RULE.match(lines[i + 1].removesuffix("\r"))
        if opens:
            table, row, heads = table + 1, 0, []
        elif row >= 0 and not _ROW.match(bare):
            row = -1
        if row < 0 or _RULE.match(bare):
            out.append(_segment(f"L{i + 1:05d}", bare, node=str(i)))
            continue
        start = bare.index("|") + 1
        for c, cell in enumerate(bare[start : bare.rindex("|")].split("|")):
            if row == 0:
                heads.append(cell.strip())
            head = heads[c] if row and c < len(heads) else ""
            out.append(_segment(f"L{i + 1:05d}C{c:02d}", cell, "cell", cell=(f"T{table}", row, c, 1, 1, head, "col", row == 0), node=str(i), offset=start))
            start += len(cell) + 1
        row += 1
    return out


def _decode(content: bytes) -> str:
    return content.decode("utf-8-sig", "replace")


def _read_lines(path: str, content: bytes) -> list[dict]:
    return text_rows(_decode(content))


def _write_lines(path: str, content: bytes, plans: list[dict], values) -> tuple[bytes, list[str]]:
    mark = b"\xef\xbb\xbf" if content.startswith(b"\xef\xbb\xbf") else b""
    edits = [{"line": int(p["node"]), "start_pos": p["start_pos"] + p["node_offset"], "end_pos": p["end_pos"] + p["node_offset"], "replacement": p["replacement"]} for p in plans]
    return mark + (_lines(_decode(content), edits) or "").encode("utf-8"), []


def _read_separated(path: str, content: bytes) -> list[dict]:
    rows = list(csv.reader(io.StringIO(_decode(content)), delimiter=SEPARATED[path.rsplit(".", 1)[-1].lower()]))
    return [
        _segment(f"R{r:05d}C{c:03d}", v, "cell", cell=("T1", r, c, 1, 1, rows[0][c] if r and c < len(rows[0]) else "", "col", False), node=f"{r},{c}")
        for r, row in enumerate(rows) for c, v in enumerate(row) if v.strip()
    ]


def _spliced(text: str, plans: list[dict]) -> str:
    for p in sorted(plans, key=lambda x: -x["start_pos"]):
        text = text[: p["start_pos"]] + p["replacement"] + text[p["end_pos"] :]
    return text


def _write_separated(path: str, content: bytes, plans: list[dict], values) -> tuple[bytes, list[str]]:
    per: dict[str, list[dict]] = {}
    for p in plans:
        per.setdefault(p["node"], []).append(p)
    cells = [{"row_no": int(n.split(",")[0]), "col_no": int(n.split(",")[1]), "rewritten": _spliced(ps[0]["text"], ps)} for n, ps in per.items()]
    return (_rows(content.decode("utf-8", "replace"), cells, SEPARATED[path.rsplit(".", 1)[-1].lower()]) or "").encode("utf-8"), []


def _read_office(path: str, content: bytes) -> list[dict]:
    out = []
    for _, seg_id, _, part, kind, text, table, r, c, head, is_head, error in office.read(path, content):
        if error:
            raise office.Unsupported(error)
        if seg_id is not None:
            out.append(_segment(seg_id, text, kind, part, None if table is None else (table, r, c, 1, 1, head, "col", is_head)))
    return out


def _write_office(path: str, content: bytes, plans: list[dict], values) -> tuple[bytes, list[str]]:
    # Equal texts of a member are edited alike: what is replaced in one of them is replaced in all.
    per: dict[tuple[str, str], list[tuple[int, int, str, bool]]] = {}
    for p in plans:
        per.setdefault((p["part"], p["text"]), []).append((p["start_pos"], p["end_pos"], p["replacement"], p["cross_boundary"]))

    def edit(member: str, text: str):
        out: list[tuple[int, int, str, bool]] = []
        for s in sorted(set(per.get((member, text), ()))):
            if not out or out[-1][1] <= s[0]:
                out.append(s)
        return out

    done = office_sink.rewrite(content, edit, values)
    return done.content, done.blocks


HANDLERS: dict[str, Handler] = {
    **dict.fromkeys(LINES.split(), Handler(_read_lines, _write_lines)), **dict.fromkeys(SEPARATED, Handler(_read_separated, _write_separated)),
    **dict.fromkeys((s.removeprefix(".") for s in office.SUFFIXES), Handler(_read_office, _write_office)),
}


def register(suffix: str, handler: Handler) -> None:
    """Add a format, or put another handler in the place of one."""
    HANDLERS[suffix.lower().removeprefix(".")] = handler


def read(path: str, content: bytes, handlers: dict[str, Handler]) -> list[dict]:
    """Segment rows of a file, or one row with an error; the message holds nothing of the text."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if suffix not in handlers:
            raise office.Unsupported("library absent" if suffix in NEEDS_LIBRARY.split() else "format")
        rows = handlers[suffix].read(path, content)
        return [{"doc_id": path, "ord": i, "error": None, **r} for i, r in enumerate(rows)] or [{"doc_id": path}]
    except Exception as e:  # whatever is wrong with a file, its row says so
        return [{"doc_id": path, "error": type(e).__name__ + (f": {e}" if isinstance(e, office.Unsupported) else "")}]


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (path, content) of files, folders and globs; names that begin with a dot are left out."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    return out.filter(~F.element_at(F.split("path", "/"), -1).startswith("."))


def segments(found: DataFrame) -> DataFrame:
    """Rows (seg_key, *:data:`SCHEMA`) of files (path, content). A file without text, or unread, has one row without a segment."""
    names, handlers = [x.split()[0] for x in "doc_id seg_id ord part kind text table_ctx pieces error".split()], dict(HANDLERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                rows = read(path, bytes(content or b""), handlers)
                out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
                yield out.astype({n: object for n in names if n != "ord"}).assign(ord=out["ord"].astype("Int32"))

    return found.select("path", "content").mapInPandas(run, SCHEMA).withColumn("seg_key", F.xxhash64("doc_id", "seg_id"))


def written(found: DataFrame, parts: DataFrame, plans: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (doc_id, content, blocks): files with their plans carried out. ``parts`` are the segments, ``plans`` (seg_key, start_pos, ...).

    A format that cannot be written blocks its file.
    """
    own = parts.select("seg_key", "doc_id", "part", "text", F.get("pieces", F.lit(0))["node"].alias("node"), F.get("pieces", F.lit(0))["node_offset"].alias("node_offset"))
    of = plans.join(own, "seg_key").groupBy("doc_id").agg(F.collect_list(F.struct("part", "text", "node", "node_offset", "start_pos", "end_pos", "replacement", "cross_boundary", "original")).alias("plans"))
    src = found.select(F.col("path").alias("doc_id"), "content").join(of, "doc_id", "left").select("doc_id", "content", "plans")
    handlers = dict(HANDLERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content, ps in frame.itertuples(index=False):
                own_plans = [dict(p) if isinstance(p, dict) else p.asDict() for p in (ps if ps is not None else [])]
                h = handlers.get(path.rsplit(".", 1)[-1].lower())
                try:
                    if h is None or h.write is None:
                        raise office.Unsupported("no writer")
                    # what is replaced anywhere in the document is replaced in its attributes and properties too
                    body, blocks = h.write(path, bytes(content), own_plans, sorted({(p["original"], p["replacement"]) for p in own_plans}))
                except Exception as e:
                    body, blocks = b"", [type(e).__name__]
                rows.append((path, body, blocks))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "blocks"])

    return src.mapInPandas(run, "doc_id string, content binary, blocks array<string>")
