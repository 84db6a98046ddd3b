"""Value detectors over segments: one Arrow pass, no shuffle.

A segment's candidates (start_pos, end_pos, category, grade, note) are in the order of :data:`DETECTORS`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators import values

DETECTORS = tuple(values.DETECTORS)
CANDIDATE = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("category", "grade", "note"))]))
_ARROW = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("category", pa.string()), ("grade", pa.string()), ("note", pa.string())]))
_FIELDS = ("start_pos", "end_pos", "category", "grade", "note")


def context(text: Column, header: Column | None) -> Column:
    """Where context words are looked for: the header, if there is one, before the text."""
    return text if header is None else F.when(F.length(header) > 0, F.concat_ws(" ", header, text)).otherwise(text)


def editable(pieces: Column, start: Column, end: Column) -> Column:
    """A span touches no piece that is neither editable nor soft; null pieces hold nothing back."""
    touches = lambda p: (p["start_pos"] < end) & (start < p["start_pos"] + p["length"]) & ~F.coalesce(p["editable"], F.lit(True)) & ~F.coalesce(p["soft"], F.lit(False))
    return ~F.coalesce(F.exists(pieces, touches), F.lit(False))


def candidates(segments: DataFrame, text: str = "text", header: Column | None = None, pieces: Column | None = None, only: tuple[str, ...] | None = None, as_of: str = "2026-01-01") -> DataFrame:
    """``segments`` with a column ``candidates``. ``only`` names the detectors to run. A null text has none.

    ``as_of`` is the last date that can be a birth date; it is a parameter so that a run can be repeated.
    """
    n, last = len(segments.columns), dt.date.fromisoformat(as_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(_FIELDS, f, strict=True)) for f in values.find(t, h, only, last)] for t, h in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, _ARROW)], names=[*batch.schema.names[:n], "candidates"])

    src = segments.select("*", F.col(text).alias("_text"), (F.lit("") if header is None else header).alias("_header"))
    out = src.mapInArrow(run, T.StructType([*segments.schema.fields, T.StructField("candidates", CANDIDATE)]))
    return out if pieces is None else out.withColumn("candidates", F.filter("candidates", lambda c: editable(pieces, c["start_pos"], c["end_pos"])))


def exploded(found: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per candidate, with its place in the order of detection and its value."""
    out = found.select(*keys, F.col(text).alias("_t"), F.posexplode("candidates").alias("seq", "c")).select(*keys, "_t", "seq", "c.*")
    return out.withColumn("value", F.substring("_t", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))).drop("_t")
