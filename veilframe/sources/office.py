"""Office packages (xlsx, docx, pptx, hwpx) as segments.

Input is what ``spark.read.format("binaryFile")`` gives: path and content. Every package gives its segments, or one
row with ``error`` set; no file is dropped, so that a file that could not be read is never taken for a clean one.

* xlsx: each shared string once (``S000000``), with the place of the first cell that refers to it; inline strings
  (``I:``), cached strings of formulas (``V:``), and numbers of nine or more digits or under a known header (``N:``).
  The first row names the columns.
* docx: paragraphs of the main part, headers, footers and notes, with table, row and column; tabs and breaks become
  characters. The first row names the columns of a table with two rows and columns or more.
* pptx: paragraphs of slides and notes, blank ones left out.
* hwpx: every paragraph of every section, by the same automaton as parsed trees.

Members above :data:`MAX_BYTES` make the package unreadable rather than silently shorter.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.lexicon import HEADER_CATEGORY
from veilframe.operators import nested
from veilframe.sources import xmltext

MAX_BYTES = 64 << 20
SCHEMA = "doc_id string, seg_id string, ord int, part string, kind string, text string, table_id string, row_no int, col_no int, header_text string, is_header boolean, error string"
SUFFIXES = {".xlsx": "xlsx", ".xlsm": "xlsx", ".docx": "docx", ".pptx": "pptx", ".pptm": "pptx", ".hwpx": "hwpx"}
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


class Unsupported(ValueError):
    pass


def _name(el) -> str:
    return nested.local_name(el.tag) if isinstance(el.tag, str) else ""


def _xml(z: zipfile.ZipFile, member: str):
    if z.getinfo(member).file_size > MAX_BYTES:
        raise Unsupported(f"member too large: {member}")
    return ElementTree.fromstring(z.read(member))


def _number_in(member: str) -> tuple[int, str]:
    m = re.search(r"(\d+)\.xml$", member)
    return int(m[1]) if m else 0, member


def _row(seg_id, part, kind, text, at=None, header="", is_header=False):
    table, r, c = at or (None, None, None)
    return (seg_id, part, kind, text, table, r, c, header if at else None, is_header if at else None)


def _cell_place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref or "")
    if not m:
        return -1, -1
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def read_xlsx(z: zipfile.ZipFile) -> list[tuple]:
    names = z.namelist()
    text_of = lambda el: "".join(t.text or "" for t in el.iter() if _name(t) == "t")
    shared = [text_of(si) for si in _xml(z, "xl/sharedStrings.xml") if _name(si) == "si"] if "xl/sharedStrings.xml" in names else []
    first: dict[int, tuple] = {}
    other = []
    for member in sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=_number_in):
        sheet, heads = member.rsplit("/", 1)[-1].removesuffix(".xml"), {}
        for c in (x for x in _xml(z, member).iter() if _name(x) == "c"):
            r, col = _cell_place(c.get("r", ""))
            kids = {_name(k): k for k in c}
            value = (kids["v"].text or "") if "v" in kids else ""
            kind = c.get("t", "n")
            text = shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else text_of(kids["is"]) if kind == "inlineStr" and "is" in kids else value
            if r == 0:
                heads[col] = text
            at, head = (sheet, r, col), heads.get(col, "") if r else ""
            if kind == "s":
                if value.isdigit():
                    first.setdefault(int(value), (at, head, r == 0))
            elif text.strip() and (kind in ("inlineStr", "str") or len(re.sub(r"\D", "", text)) >= 9 or head in HEADER_CATEGORY):
                mark = "I" if kind == "inlineStr" else "V" if kind == "str" else "N"
                other.append(_row(f"{mark}:{sheet}!{c.get('r')}", member, "cell", text, at, head, r == 0))
    out = [_row(f"S{i:06d}", "xl/sharedStrings.xml", "cell", t, *first.get(i, (None, "", False))) for i, t in enumerate(shared) if t.strip()]
    return out + other


def _paragraph(p) -> str:
    out = []
    for el in p.iter():
        n = _name(el)
        if n == "t":
            out.append(el.text or "")
        elif n == "tab":
            out.append("\t")
        elif n in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def orientation(grid: list[list[str]]) -> str:
    """Where a table's headers stand: 'col' in the first row, 'row' in the first column, '' nowhere.

    Known headers decide; else the share of short cells without digits, if it is half at least or leads by 0.3. A single
    row or column has none.
    """
    if len(grid) < 2 or max(map(len, grid), default=0) < 2:
        return ""
    first = {"col": grid[0], "row": [r[0] for r in grid if r]}
    known = {k: sum(re.sub(r"\s+", "", c) in HEADER_CATEGORY for c in v) for k, v in first.items()}
    if known["col"] != known["row"]:
        return max(known, key=known.get)
    if known["col"]:
        return "col"
    label = lambda c: 0 < len(c.strip()) <= 12 and not re.search(r"\d", c)
    share = {k: sum(map(label, v)) / max(1, len(v)) for k, v in first.items()}
    if share["row"] - share["col"] > 0.3:
        return "row"
    return "col" if share["col"] >= 0.5 or share["col"] - share["row"] > 0.3 else ""


def read_docx(z: zipfile.ZipFile) -> list[tuple]:
    names = z.namelist()
    main = "word/document.xml"
    parts = [main, *sorted(n for n in names if re.fullmatch(r"word/(?:header|footer|footnotes|endnotes)\d*\.xml", n))]
    if main not in names:
        raise Unsupported("no main part")
    out: list[tuple] = []
    for part in parts:
        kind = "para" if part == main else re.sub(r"s?\d*$", "", part.split("/")[1].removesuffix(".xml"))
        n_tables = 0

        def walk(el, at, header, is_header, part=part, kind=kind):
            nonlocal n_tables
            for k in el:
                n = _name(k)
                if n == "p":
                    text = _paragraph(k)
                    if text.strip():
                        out.append(_row(f"P{len(out):06d}", part, "cell" if at else kind, text, at, header, is_header))
                elif n == "tbl":
                    n_tables += 1
                    table = f"T{n_tables}"
                    rows = [[c for c in r if _name(c) == "tc"] for r in k if _name(r) == "tr"]
                    texts = [["".join(_paragraph(p) for p in c.iter() if _name(p) == "p") for c in cells] for cells in rows]
                    axis = orientation(texts)
                    for r, cells in enumerate(rows):
                        for c, cell in enumerate(cells):
                            head = texts[0][c] if axis == "col" and r and c < len(texts[0]) else texts[r][0] if axis == "row" and c else ""
                            walk(cell, (table, r, c), head, axis == "col" and r == 0 or axis == "row" and c == 0)
                else:
                    walk(k, at, header, is_header)

        walk(_xml(z, part), None, "", False)
    return out


def read_pptx(z: zipfile.ZipFile) -> list[tuple]:
    names = z.namelist()
    parts = [n for folder in ("slides", "notesSlides") for n in sorted((n for n in names if re.fullmatch(rf"ppt/{folder}/[^/]+\.xml", n)), key=_number_in)]
    out: list[tuple] = []
    for part in parts:
        for p in (x for x in _xml(z, part).iter() if _name(x) == "p"):
            text = _paragraph(p)
            if text.strip():
                out.append(_row(f"P{len(out):06d}", part, "para", text))
    return out


def _tree(el) -> dict:
    """The element as a parsed tree; built with a stack, so depth is no matter."""
    root: dict = {}
    stack = [(el, root)]
    while stack:
        e, node = stack.pop()
        kids = [(k, {}) for k in e if isinstance(k.tag, str)]
        node |= {"tag": e.tag, "attrib": dict(e.attrib), "text": e.text, "tail": e.tail, "children": [d for _, d in kids]}
        stack += kids
    return root


def read_hwpx(z: zipfile.ZipFile) -> list[tuple]:
    members = sorted((n for n in z.namelist() if re.fullmatch(r"Contents/(?:section|masterpage)\d+\.xml", n)), key=lambda n: ("section" not in n, *_number_in(n)))
    if not members:
        raise Unsupported("no sections")
    out = []
    for member in members:
        for kind, _, _, _, seg_id, table, r, c, _, text in nested.walk(_tree(_xml(z, member)), member):
            if kind == "paragraph" and text.strip():
                out.append(_row(seg_id, member, "cell" if table else "para", text, (table, r, c) if table else None))
    return out


# Attributes that hold no text, side members that do, packages that may be embedded.
NO_TEXT = "id rid rsidr rsidrdefault rsidp uri type target val ref style w h x y cx cy sqref r s t spans space lang font ascii hansi eastasia typeface guid"
SIDE = re.compile(r"(?:docProps/(?:core|app|custom)|word/comments\w*|xl/comments\d*|xl/threadedComments/[^/]+|ppt/comments/[^/]+|xl/workbook|ppt/(?:slideMasters|slideLayouts)/[^/]+)\.xml$")
EMBEDDED = re.compile(r"\.(?:xlsx|xlsm|docx|pptx|pptm)$", re.IGNORECASE)
_STAMP = re.compile(r"\{?[0-9A-Fa-f]{8}-[0-9A-Fa-f-]{27}\}?|\d{4}-\d\d-\d\dT[\d:.]+Z?")


def has_content(value: str) -> bool:
    """A value that may say something about somebody: Hangul, an address sign, or two words; no identifiers or time stamps."""
    bare = _STAMP.sub("", value).strip()
    return bool(re.search("[가-힣@]", bare)) or " " in bare and bool(re.search("[A-Za-z]{2}", bare))


def hidden(z: zipfile.ZipFile) -> list[tuple]:
    """Text that no paragraph shows: attributes of all members, and what stands in properties, comments and masters."""
    out = []
    for name in z.namelist():
        if not name.endswith(".xml") or z.getinfo(name).file_size > MAX_BYTES:
            continue
        xml = z.read(name).decode("utf-8-sig", "replace")
        found = [v for n, v, _, _ in xmltext.attribute_values(xml) if n.lower() not in NO_TEXT.split() and len(v) <= 200 and has_content(v)]
        if SIDE.match(name):
            found += [t.strip() for t in xmltext.chunks(xml) if t.strip() and (has_content(t) or re.fullmatch("[A-Za-z][A-Za-z .'-]+", t.strip()))]
        out += [(f"H{i:05d}:{name}", name, "hidden", v, None, None, None, None, None) for i, v in enumerate(dict.fromkeys(found))]
    return out


def embedded(z: zipfile.ZipFile, depth: int = 0) -> list[tuple]:
    """Segments of packages within the package, their ids after the member's name. One that cannot be read makes the whole unreadable."""
    out = []
    for name in z.namelist():
        if EMBEDDED.search(name):
            if depth >= 3:
                raise Unsupported("embedded too deep")
            with zipfile.ZipFile(io.BytesIO(z.read(name))) as inner:
                kind = next(k for s, k in SUFFIXES.items() if name.lower().endswith(s))
                rows = READERS[kind](inner) + hidden(inner) + embedded(inner, depth + 1)
            out += [(f"{name}>{r[0]}", f"{name}>{r[1]}", *r[2:]) for r in rows]
    return out


READERS = {"xlsx": read_xlsx, "docx": read_docx, "pptx": read_pptx, "hwpx": read_hwpx}


def read(path: str, content: bytes) -> list[tuple]:
    """Rows of :data:`SCHEMA` for one package."""
    kind = next((k for s, k in SUFFIXES.items() if path.lower().endswith(s)), None)
    error = None
    rows: list[tuple] = []
    try:
        if kind is None:
            raise Unsupported("format")
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            rows = READERS[kind](z) + hidden(z) + embedded(z)
    except Exception as e:  # whatever is wrong with a file, its row says so; the message holds no text of it
        rows, error = [], f"{type(e).__name__}" + (f": {e}" if isinstance(e, Unsupported) else "")
    if error or not rows:
        return [(path, None, None, None, None, None, None, None, None, None, None, error)]
    return [(path, seg_id, i, part, k, text, table, r, c, head, is_head, None) for i, (seg_id, part, k, text, table, r, c, head, is_head) in enumerate(rows)]


def segments(files: DataFrame) -> DataFrame:
    """Rows of :data:`SCHEMA` for files with path and content. A package without text gives one row without a segment."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                out = pd.DataFrame(read(path, content or b""), columns=_COLUMNS)
                for c in ("ord", "row_no", "col_no"):
                    out[c] = out[c].astype("Int32")
                yield out.astype({c: "object" for c in _COLUMNS if c not in ("ord", "row_no", "col_no")})

    return files.select(F.col("path"), F.col("content")).mapInPandas(run, SCHEMA)
