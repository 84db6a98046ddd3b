"""Text documents and separated values written back, and Markdown copies of any document."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import rewrite


def line_edits(segments: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows (doc_id, line, start_pos, end_pos, replacement): plans (seg_key, ...) in the places of their lines.

    A segment's pieces say where in which line (node) it lies; a plan goes through the first piece that it overlaps.
    """
    at = F.filter("pieces", lambda p: (p["start_pos"] < F.col("end_pos")) & (F.col("start_pos") < p["start_pos"] + p["length"]))
    met = plans.join(segments.select("seg_key", "doc_id", "pieces"), "seg_key").withColumn("p", F.get(at, F.lit(0))).filter("p is not null")
    shift = F.col("p.node_offset") - F.col("p.start_pos")
    return met.select("doc_id", F.col("p.node").cast("int").alias("line"), (F.col("start_pos") + shift).alias("start_pos"), (F.col("end_pos") + shift).alias("end_pos"), "replacement")


def reassembled(documents: DataFrame, edits: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with a column ``rewritten``: edits (doc_id, line, start_pos, end_pos, replacement) carried out line by line, from the right.

    Lines, their ends and everything outside the edits stay as they are. Overlapping edits of a line: the first counts.
    """
    per = edits.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("line", "start_pos", "end_pos", "replacement")).alias("_e"))
    src = documents.join(per, documents[doc_id] == per["_d"], "left").drop("_d")

    @F.pandas_udf("string")
    def run(texts, every):
        import pandas as pd

        return pd.Series([_lines(t, e) for t, e in zip(texts, every, strict=True)], dtype=object)

    return src.withColumn("rewritten", run(F.col(text), F.col("_e"))).drop("_e")


def _lines(text: str | None, edits) -> str | None:
    if text is None or edits is None or len(edits) == 0:
        return text
    lines = text.split("\n")
    done: dict[int, int] = {}
    kept = []
    for e in sorted(edits, key=lambda x: (x["line"], x["start_pos"], x["end_pos"])):
        if 0 <= e["line"] < len(lines) and done.get(e["line"], 0) <= e["start_pos"] < e["end_pos"] <= len(lines[e["line"]]):
            done[e["line"]] = e["end_pos"]
            kept.append(e)
    for e in reversed(kept):
        line = lines[e["line"]]
        lines[e["line"]] = line[: e["start_pos"]] + e["replacement"] + line[e["end_pos"] :]
    return "\n".join(lines)


def separated(documents: DataFrame, cells: DataFrame, sep: str = ",", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with a column ``rewritten``: cells (doc_id, row_no, col_no, rewritten) put in place of theirs, the rest as it was read."""
    per = cells.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("row_no", "col_no", "rewritten")).alias("_c"))
    src = documents.join(per, documents[doc_id].cast("string") == per["_d"], "left").drop("_d")

    @F.pandas_udf("string")
    def run(texts, every):
        import pandas as pd

        return pd.Series([_rows(t, c, sep) for t, c in zip(texts, every, strict=True)], dtype=object)

    return src.withColumn("rewritten", run(F.col(text), F.col("_c"))).drop("_c")


def _rows(text: str | None, cells, sep: str) -> str | None:
    if text is None or cells is None or len(cells) == 0:
        return text
    new = {(c["row_no"], c["col_no"]): c["rewritten"] for c in cells}
    mark = "﻿" if text.startswith("﻿") else ""
    end = "\r\n" if "\r\n" in text else "\n"
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=end)
    for r, row in enumerate(csv.reader(io.StringIO(text.lstrip("﻿")), delimiter=sep)):
        writer.writerow([new.get((r, c), v) for c, v in enumerate(row)])
    body = out.getvalue()
    return mark + (body if text.endswith(("\n", "\r")) else body.removesuffix(end))


def markdown(segments: DataFrame, mapping: DataFrame, text: str = "rewritten") -> DataFrame:
    """Rows (doc_id, markdown): a readable copy of each document's rewritten segments, swept once more.

    Hidden text is left out, table rows are put together again, and known values that only the joined lines spell out
    are replaced. A row of the result is a document; the values that meet it are those that its own text may hold.
    """
    from veilframe.operators import meet

    c = F.col("table_ctx")
    shown = segments.filter(~F.coalesce(F.col("kind"), F.lit("")).isin("hidden")).select("doc_id", F.col(text).alias("t"), "ord", "seg_id", c["table_id"].alias("table_id"), c["row_no"].alias("row_no"), c["col_no"].alias("col_no")).filter("t is not null")
    rows = shown.groupBy("doc_id", "table_id", "row_no", F.when(F.col("table_id").isNull(), F.col("seg_id")).alias("own")).agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("col_no", "seg_id", "t"))).alias("cells"))
    joined = F.array_join(F.transform("cells", lambda x: x["t"]), " | ")
    line = F.when(F.col("table_id").isNull(), joined).otherwise(F.concat(F.lit("| "), joined, F.lit(" |")))
    docs = rows.select("doc_id", "ord", line.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("md"))
    compact = lambda x: F.regexp_replace(x, r"[\s·]", "")
    v = mapping.select("category", F.col("original").alias("value"), "pseudonym").filter(F.length("value") >= 2).withColumn("_k", compact(F.col("value")))
    met = meet.met(docs.select("doc_id", compact(F.col("md")).alias("c")), v, "doc_id", "c", "_k").join(v, "_k").groupBy("doc_id").agg(F.collect_set(F.struct("value", "pseudonym", "category")).alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [rewrite.sweep_text(t, vs) if vs else t for t, vs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "markdown"])

    return docs.join(met, "doc_id", "left").select("doc_id", "md", "vs").mapInArrow(run, "doc_id string, markdown string")
