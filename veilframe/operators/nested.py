"""Deeply nested XML-like JSON trees to flat, linked tables.

An element is a JSON object with ``tag`` and optionally ``attrib``, ``text``, ``tail`` and ``children``.
Producers write the same structure in different shapes, so each tree runs through two automata:

* a bottom-up one over JSON values. Its states (``SHAPES``) say what a value is: null, scalar, attribute
  object, list of name/value pairs, one element, list of elements. The states of an element's ``attrib``
  and ``children`` name its *variant*; the variant decides how the two fields are read, and is kept as a column;
* a top-down one over element names (``ROLES``). Its state says what the element is to its parent:
  paragraph, table, row, cell, caption or a plain element.

Every element of interest becomes a row of one supertype relation (:data:`NODE_SCHEMA`): its role, its variant,
its own number, its parent's number, and the keys of its member, table, cell and enclosing paragraph. The subtype
tables (:func:`paragraphs`, :func:`tables`, :func:`cells`, :func:`unreadable`) are filters of that relation, so
all of them share the keys.

Defined results: a null tree, text that is not JSON, and JSON without an element give one ``unreadable`` row and
nothing else. A leading byte order mark and JSON that was encoded once more as a JSON string are read. A child
that is not an element is passed over. Input columns other than those named are ignored. Trees may nest to any
depth: where the C decoder gives up, a decoder with its own stack takes over. An empty table gives an empty table.
A repeated row gives its rows again; the queries remove them by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "doc_id string, member string, kind string, variant string, node_no int, parent_node_no int, seg_id string, "
    "table_id string, row_no int, col_no int, parent_seg_id string, text string, reason string"
)
_ARROW = pa.schema([
    ("doc_id", pa.string()), ("member", pa.string()), ("kind", pa.string()), ("variant", pa.string()),
    ("node_no", pa.int32()), ("parent_node_no", pa.int32()), ("seg_id", pa.string()), ("table_id", pa.string()),
    ("row_no", pa.int32()), ("col_no", pa.int32()), ("parent_seg_id", pa.string()), ("text", pa.string()),
    ("reason", pa.string()),
])

#: Role of an element by (role of its parent, its name); names that are not here keep no role.
ROLES = {"p": "paragraph", "tbl": "table"}
ROLES_IN = {("table", "tr"): "row", ("row", "tc"): "cell", ("table", "caption"): "caption"}
#: Rows go out in batches of about this many.
BATCH_ROWS = 20_000


class Unreadable(ValueError):
    """A tree that cannot be read; the message is the reason."""


def local_name(tag: str) -> str:
    """The name after a namespace in braces or a prefix with a colon."""
    return tag[max(tag.rfind("}"), tag.rfind(":")) + 1 :]


def _decode_deep(s: str):
    """JSON decoder with its own stack, for nesting that the C decoder refuses."""
    holder: list = []
    stack: list = [holder]
    keys: list = [None]
    i, n, key, want_key = 0, len(s), None, False
    scalar = json.JSONDecoder()

    def put(value):
        top = stack[-1]
        if isinstance(top, list):
            top.append(value)
        else:
            top[keys[-1]] = value

    while i < n:
        c = s[i]
        if c in " \t\r\n,":
            want_key = want_key or (c == "," and isinstance(stack[-1], dict))
            i += 1
        elif c == ":":
            want_key = False
            i += 1
        elif c in "{[":
            value: dict | list = {} if c == "{" else []
            put(value)
            stack.append(value)
            keys.append(None)
            want_key = c == "{"
            i += 1
        elif c in "}]":
            if len(stack) == 1 or isinstance(stack[-1], dict) != (c == "}"):
                raise ValueError("unbalanced")
            stack.pop()
            keys.pop()
            want_key = False
            i += 1
        elif c == '"' and want_key and isinstance(stack[-1], dict):
            key, i = scanstring(s, i + 1)
            keys[-1] = key
            want_key = False
        else:
            value, i = scalar.raw_decode(s, i)
            put(value)
    if len(stack) != 1 or len(holder) != 1:
        raise ValueError("not one value")
    return holder[0]


def read_tree(tree: str | None):
    """The decoded root element, or a list of them. Raises :class:`Unreadable`."""
    if tree is None:
        raise Unreadable("null")
    value = tree
    while isinstance(value, str):
        try:
            value = json.loads(value.lstrip("﻿"))
        except RecursionError:
            try:
                value = _decode_deep(value.lstrip("﻿"))
            except (ValueError, RecursionError):
                raise Unreadable("parse") from None
        except ValueError:
            raise Unreadable("parse") from None
    if shape(value) not in ("elem", "list"):
        raise Unreadable("no element")
    return value


def shape(value) -> str:
    """State of the bottom-up automaton for a JSON value."""
    if value is None:
        return "null"
    if type(value) is dict:
        return "elem" if "tag" in value else "object"
    if type(value) is list:
        return "list" if value else "empty"
    return "scalar"


def elements(value) -> list:
    """Child elements, by the shape of ``children``."""
    kind = shape(value)
    if kind == "elem":
        return [value]
    if kind == "list":
        return [x for x in value if type(x) is dict and isinstance(x.get("tag"), str)]
    return []


def attributes(value) -> dict:
    """Attributes by local name, by the shape of ``attrib``."""
    kind = shape(value)
    if kind in ("object", "elem"):
        return {local_name(k): v for k, v in value.items()}
    if kind == "list":
        return {local_name(str(x.get("name"))): x.get("value") for x in value if type(x) is dict}
    return {}


def _int(value) -> int | None:
    try:
        return int(str(value).strip())
    except ValueError:
        return None


def file_stem(member: str | None) -> str:
    """The member's file name without folder and ``.xml``."""
    return (member or "").rsplit("/", 1)[-1].removesuffix(".xml")


def walk(root, member: str | None, with_text: bool = True) -> list[tuple]:
    """Rows (kind, variant, node_no, parent_node_no, seg_id, table_id, row_no, col_no, parent_seg_id, text) of one tree."""
    stem = file_stem(member)
    rows: list[list] = []
    node_no = p_no = t_no = 0
    # An entry: element, its parent's role, parent's node number, innermost paragraph's row (or None), innermost
    # cell (table_id, row, col), the state of the enclosing table [table_id, rows so far] and row [row, cells so far].
    stack = [(x, "", -1, None, None, None, None) for x in reversed(elements(root))]
    no_cell = ("", -1, -1)
    while stack:
        el, parent_role, parent_no, para, cell, table, row = stack.pop()
        tag = el["tag"]
        name = tag[max(tag.rfind("}"), tag.rfind(":")) + 1 :]
        role = ROLES.get(name) or ROLES_IN.get((parent_role, name), "")
        this, node_no = node_no, node_no + 1
        children = el.get("children")
        kids = elements(children) if children else []
        if role:
            at = cell or no_cell
            out = None
            if role == "paragraph":
                out = [role, "", this, parent_no, f"{stem}:{p_no:06d}", *at, para[4] if para else "", [] if with_text else None]
                p_no += 1
                para = out
            elif role == "table":
                t_no += 1
                table, row = [f"{stem}T{t_no}", 0], None
                out = [role, "", this, parent_no, para[4] if para else "", table[0], *at[1:], para[4] if para else "", None]
            elif role == "row":
                row = [table[1], 0]
                table[1] += 1
            elif role == "cell":
                r, c = row
                row[1] += 1
                for kid in kids:
                    if local_name(kid["tag"]) == "cellAddr":
                        a = attributes(kid.get("attrib"))
                        x, y = _int(a.get("rowAddr")), _int(a.get("colAddr"))
                        r, c = r if x is None else x, c if y is None else y
                        break
                cell = (table[0], r, c)
                out = [role, "", this, parent_no, "", *cell, para[4] if para else "", None]
            elif role == "caption":
                out = [role, "", this, parent_no, "", table[0], *at[1:], para[4] if para else "", None]
            if out:
                out[1] = f"{shape(el.get('attrib'))}/{shape(children)}" if "attrib" in el else f"-/{shape(children)}"
                rows.append(out)
        if with_text and para is not None:
            if name == "t" and isinstance(el.get("text"), str):
                para[-1].append(el["text"])
            elif name == "tab":
                para[-1].append("\t")
        # An element without a role of its own hands on the role it stands in, so that wrappers do not break the chain.
        for kid in reversed(kids):
            stack.append((kid, role or parent_role, this, para, cell, table, row))
    return [(*r[:-1], "".join(r[-1]) if isinstance(r[-1], list) else None) for r in rows]


def flatten(parts: DataFrame, kinds: tuple[str, ...] = ("paragraph", "table", "cell", "caption", "unreadable"), with_text: bool = True) -> DataFrame:
    """The supertype relation of all elements of the given ``kinds``.

    ``parts`` needs doc_id, member and tree. No shuffle: each tree is read where its file split lies.
    """
    wanted = frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for doc_id, member, tree in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    root = read_tree(tree)
                except Unreadable as why:
                    if "unreadable" in wanted:
                        out.append((doc_id, member, "unreadable", None, None, None, None, None, None, None, None, None, str(why)))
                    continue
                out += [(doc_id, member, *r, None) for r in walk(root, member, with_text) if r[0] in wanted]
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return parts.select("doc_id", "member", "tree").mapInArrow(run, NODE_SCHEMA)


def paragraphs(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "paragraph").select("doc_id", "member", "seg_id", "table_id", "row_no", "col_no", "parent_seg_id", "variant", "text")


def tables(nodes: DataFrame) -> DataFrame:
    """One row per table; row_no and col_no are those of the cell around it, parent_seg_id the paragraph around it."""
    return nodes.filter(F.col("kind") == "table").select("doc_id", "member", "table_id", "row_no", "col_no", "parent_seg_id", "variant")


def cells(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "cell").select("doc_id", "member", "table_id", "row_no", "col_no", "parent_seg_id", "variant")


def unreadable(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "unreadable").select("doc_id", "member", "reason")


def store(nodes: DataFrame, path: str) -> None:
    """Every structural variant in a table of its own: folders by role and variant, below a common root.

    A reader of one variant opens its folder alone; a reader of a role or of everything sees the common columns.
    """
    nodes.write.partitionBy("kind", "variant").mode("errorifexists").parquet(path)


def linked_paragraphs(parts: DataFrame, packages: DataFrame, segments: DataFrame) -> DataFrame:
    """Paragraphs of trees, package entries that no tree gives, and table cells of segments, each once.

    One shuffle on (doc_id, member, seg_id): a tree's row wins over a package entry of the same key. Null keys
    group as equal; an entry of ``part_of`` with a null member keeps it.
    """
    keys = ["doc_id", "member", "seg_id"]
    rest = ["table_id", "row_no", "col_no", "parent_seg_id"]
    own = paragraphs(flatten(parts, ("paragraph",), with_text=False)).select(*keys, F.lit(1).alias("own"), *rest)
    listed = packages.select("doc_id", F.explode("part_of").alias("seg_id", "member")).select(
        *keys, F.lit(0).alias("own"), F.lit("").alias("table_id"), F.lit(-1).alias("row_no"), F.lit(-1).alias("col_no"), F.lit("").alias("parent_seg_id")
    )
    first = own.unionByName(listed).groupBy(*keys).agg(F.max(F.struct("own", *rest)).alias("x")).select(*keys, *(f"x.{c}" for c in rest))
    c = F.col("table_ctx")
    of_segments = segments.filter(c.isNotNull()).select(
        "doc_id", F.col("part").alias("member"), "seg_id", c["table_id"].alias("table_id"), c["row_no"].alias("row_no"), c["col_no"].alias("col_no"), F.lit("").alias("parent_seg_id")
    )
    return first.unionByName(of_segments.distinct())
