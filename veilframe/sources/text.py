"""Documents as text: lines, Markdown tables, separated values."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.mapping import numbered


def lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, seg_id, ord, kind, text): one for each line, blank ones too; a null text has none."""
    out = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n", -1)).alias("ord", "line"))
    return out.select("doc_id", F.format_string("L%05d", F.col("ord") + 1).alias("seg_id"), "ord", F.lit("line").alias("kind"), F.regexp_replace("line", "\r$", "").alias("text"))


_ROW, _SEPARATOR = re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$")
_CELLS = "line_no int, table_no int, row_no int, col_no int, header_text string, is_header boolean, text string"


def table_cells(text: str) -> list[tuple[int, int, int, int, str, bool, str]]:
    """(line, table, row, column, header, is header, text) of the cells of a text's Markdown tables.

    A table is a row line followed by a separator line, and the row lines after it; a row line before a further separator
    opens another.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    rows = [_ROW.match(x) is not None for x in lines]
    rules = [_SEPARATOR.match(x) is not None for x in lines]
    out: list[tuple] = []
    heads: list[str] = []
    table, row = 0, -1
    for i, line in enumerate(lines):
        if rows[i] and not rules[i] and i + 1 < len(lines) and rules[i + 1]:
            table, row = table + 1, 0
        elif row < 0 or not rows[i]:
            row = -1
            continue
        elif rules[i]:
            continue
        else:
            row += 1
        cells = re.sub(r"\|\s*$", "", re.sub(r"^\s*\|", "", line)).split("|")
        if row == 0:
            heads = [c.strip(" ") for c in cells]
        out += [(i, table, row, c, heads[c] if row and c < len(heads) else "", row == 0, cell) for c, cell in enumerate(cells)]
    return out


def markdown_cells(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, seg_id, table_no, row_no, col_no, header_text, is_header, text): cells of Markdown tables. One pass, no shuffle."""

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':') for c in _CELLS.split(', '))}>>")
    def run(texts: pd.Series) -> pd.Series:
        names = [c.split()[0] for c in _CELLS.split(", ")]
        return pd.Series([[dict(zip(names, c, strict=True)) for c in table_cells(t)] for t in texts], dtype=object)

    # Only a text with a separator line has tables.
    some = documents.filter(F.col(text).rlike(r"(?m)^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$"))
    out = some.select(F.col(doc_id).alias("doc_id"), F.explode(run(F.col(text))).alias("c")).select("doc_id", "c.*")
    return out.select("doc_id", F.format_string("L%05dC%02d", F.col("line_no") + 1, F.col("col_no")).alias("seg_id"), "table_no", "row_no", "col_no", "header_text", "is_header", "text")


def separated_cells(documents: DataFrame, sep: str = ",", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, seg_id, row_no, col_no, header_text, text): non-blank cells of separated values; row 0 names the columns but is scanned too.

    Quoted fields may hold separators, doubled quotes and line breaks.
    """
    import csv
    import io
    from collections.abc import Iterator

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for frame in frames:
            out = []
            for doc, body in frame.itertuples(index=False):
                rows = list(csv.reader(io.StringIO(body.lstrip("﻿")), delimiter=sep)) if body else []
                for r, row in enumerate(rows):
                    for c, cell in enumerate(row):
                        if cell.strip():
                            out.append((doc, f"R{r:05d}C{c:03d}", r, c, rows[0][c] if r and c < len(rows[0]) else "", cell))
            yield pd.DataFrame(out, columns=["doc_id", "seg_id", "row_no", "col_no", "header_text", "text"])

    return documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id string, seg_id string, row_no int, col_no int, header_text string, text string")


def grid(cells: DataFrame) -> DataFrame:
    """Rows (doc_id, table_id, row_no, line): table rows put together again as Markdown. Needs doc_id, table_id, row_no, col_no, text."""
    per = cells.groupBy("doc_id", "table_id", "row_no").agg(F.array_sort(F.collect_set(F.struct("col_no", "seg_id", "text"))).alias("c"))
    return per.select("doc_id", "table_id", "row_no", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: F.coalesce(x["text"], F.lit(""))), " | "), F.lit(" |")).alias("line"))


def chunks(segments: DataFrame, size: int = 500, skip: Column | None = None, block: int = 1000) -> DataFrame:
    """Rows (doc_id, seg_id, chunk): segments of a document in order, as many to a chunk as stay within ``size`` characters.

    A segment longer than that is a chunk of its own; blank ones and those of ``skip`` are left out. Chunks are counted
    from 0 in each document. What a chunk holds depends on all before it, but only through the sum at hand: each block of
    segments says what becomes of every sum it may be given, blocks are chained (a row for ``block`` segments), and each
    then counts its own, so no task holds a long document.
    """
    s = segments.filter(~F.coalesce(skip, F.lit(False))) if skip is not None else segments
    s = s.select("doc_id", "seg_id", "ord", F.length("text").alias("n")).filter("n > 0")
    s = numbered(s, "doc_id", ["ord", "seg_id"], "i").withColumn("block", F.expr(f"i div {block}"))
    kinds = {c.name: c.dataType.simpleString() for c in s.schema.fields}

    def transfer(key, frame: pd.DataFrame) -> pd.DataFrame:
        sums, new = np.arange(size + 1), np.zeros(size + 1, dtype=np.int64)
        for n in frame.sort_values("i")["n"].clip(upper=size + 1):
            opens = (sums > 0) & (sums + n > size)
            # a chunk over the size is full: the next segment opens another
            sums, new = np.minimum(np.where(opens, n, sums + n), size), new + opens
        return pd.DataFrame({"doc_id": [key[0]], "block": [key[1]], "sums": [sums.tolist()], "new": [new.tolist()]})

    def chain(key, frame: pd.DataFrame) -> pd.DataFrame:
        out, at, first = [], 0, 0
        for b, sums, new in frame.sort_values("block")[["block", "sums", "new"]].itertuples(index=False):
            out.append((key[0], b, at, first))
            at, first = int(sums[at]), first + int(new[at])
        return pd.DataFrame(out, columns=["doc_id", "block", "at", "first"])

    def count(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        total, c, out = int(frame["at"].iloc[0]), int(frame["first"].iloc[0]), []
        for n in frame["n"].clip(upper=size + 1):
            if total and total + n > size:
                c, total = c + 1, 0
            total = min(total + n, size)
            out.append(c)
        return pd.DataFrame({"doc_id": frame["doc_id"], "seg_id": frame["seg_id"], "chunk": out})

    d = kinds["doc_id"]
    blocks = s.groupBy("doc_id", "block").applyInPandas(transfer, f"doc_id {d}, block long, sums array<long>, new array<long>")
    starts = blocks.groupBy("doc_id").applyInPandas(chain, f"doc_id {d}, block long, at long, first long").select(F.col("doc_id").alias("_d"), F.col("block").alias("_b"), "at", "first")
    met = s.join(starts, s["doc_id"].eqNullSafe(F.col("_d")) & (s["block"] == F.col("_b")))
    return met.groupBy("doc_id", "block").applyInPandas(count, f"doc_id {d}, seg_id {kinds['seg_id']}, chunk long")
