"""Sizes of documents in tokens of a public tokenizer, with what packing and mixing need beside them."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import copies

#: Where the public vocabulary files lie on every node; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_NO_LETTER = re.compile(r"[\W\d_]+")


def quality(text: str, squeezed: str | None = None) -> float:
    """Between 0.05 and 1: the share of letters among the signs, less for lines that say the same again. ``squeezed`` is the text with single blanks."""
    if not text:
        return 0.05
    squeezed = " ".join(text.split()) if squeezed is None else squeezed
    letters = len(_NO_LETTER.sub("", text)) / max(1, len(squeezed) - squeezed.count(" "))
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    fresh = len(set(lines)) / len(lines) if lines else 1.0
    return round(max(0.05, min(1.0, letters * fresh)), 6)


def measure(documents: DataFrame, vocabulary: str = VOCABULARY, near: bool = False) -> DataFrame:
    """Rows (doc_id, source, n_tokens, quality, copy_key), one per doc_id; no text in them. With ``near`` also bands and sig (:mod:`veilframe.llm.copies`).

    ``copy_key`` is equal for texts that are copies but for case and spacing. A null text has 0 tokens and no
    copy_key. A repeated row counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        enc, seen = encoder(vocabulary), copies.Hashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            tight = [" ".join(t.split()) if t else "" for t in texts]
            keys = [int.from_bytes(blake2b(x.lower().encode(), digest_size=8).digest(), "big", signed=True) if t else None for t, x in zip(texts, tight, strict=True)]
            cols = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([quality(t or "", x) for t, x in zip(texts, tight, strict=True)], pa.float64()), pa.array(keys, pa.int64())]
            if near:
                heads, prefixes = copies.signatures(texts, order, seen)
                cols += [pa.array([x.view(np.int32) for x in prefixes], pa.list_(pa.int32())), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    order = copies.common(documents) if near else None
    names = ["doc_id", "source", "n_tokens", "quality", "copy_key", *(["bands", "sig"] if near else [])]
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, source string, n_tokens long, quality double, copy_key long" + (", bands array<int>, sig binary" if near else ""))
    return out.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names[1:]))
