"""Clusters of copies and near copies of documents, for operators that must not put two of them together.

A document is the set of its shingles of :data:`SHINGLE` words. Texts that are equal but for case and spacing are one
node. Every pair of nodes with a Jaccard of :data:`LEAST` or more is found, none by chance: in one order of all shingles,
common ones last, two such sets share one of their first few (their prefix), and the places of the first they share
leave room for the overlap. Nodes meet on the shingles of their prefixes; a bitmap of each set gives a bound that
no such pair exceeds, and what is left is confirmed on the exact shingle sets. Confirmed pairs are clustered by
connected components. A shingle with many nodes is first held against one of them (another one for each shingle, by
hash); then only its nodes that are still in different clusters meet, in slices over tasks. Prefixes travel in blocks
of few bytes a shingle, one for a bucket of shingles and a batch of nodes.

Defined results: a null or empty text has no words and is in no cluster. A text of fewer words than a shingle is one
shingle. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators.components import HOT_LEAST, connected_components, lookup

SHINGLE = 5
LEAST = 0.8
#: The order of shingles is by their count among about so many texts; so many of the commonest have a count.
SAMPLE, COMMON = 10_000, 1 << 17
#: Nodes of one shingle that meet at once, and how many of a larger one meet in a slice.
MEET, SLICE = 50, 2000
#: Nodes for each bucket of shingles, and words whose shingles are worked out at once (a longer text alone).
BUCKET_NODES, WORDS = 5_000, 1 << 18
#: Ids are hashed to so many numbers before texts are fetched.
BUCKETS = 1 << 18
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words; kept, because words come again."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        raw = word.encode()
        self[word] = h = zlib.crc32(raw) << 32 | zlib.adler32(raw)
        return h


def shingles(text: str, seen: Hashes | None = None) -> np.ndarray:
    """64-bit hashes of the text's shingles, each once and sorted."""
    seen = Hashes() if seen is None else seen
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(own))
    total = np.zeros(len(own) - n + 1, np.uint64)
    for j in range(n):
        total = (total ^ own[j : len(own) - n + 1 + j]) * _MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def common(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of ``documents``, sorted, and their counts. At most :data:`COMMON` of them."""
    step = max(1, documents.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        sets = [shingles(t, seen) for batch in batches for t in batch.column(0).to_pylist()]
        found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["h", "n"])

    text = F.col("text").cast("string")
    counts = documents.select(text.alias("text")).filter(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(step)) == 0)).mapInArrow(run, "h long, n long")
    rows = counts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    at = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(at)
    return at[order], np.array([r.n for r in rows], np.int64)[order]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return x ^ (x >> np.uint64(31))


def _bits(n: int) -> int:
    """Bits in the bitmap of a set of ``n``."""
    return max(64, 1 << (2 * n - 1).bit_length())


def signature(hashes: np.ndarray, order: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Of a set of distinct hashes, in sorted order: its size (big-endian), its bitmap and its prefix; none for no hashes.

    A bit of the bitmap is the parity of the hashes that fall on it, so two sets differ in as many hashes as bits or more.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint32)
    first = n - math.ceil(LEAST * n - 1e-9) + 1
    mixed = _mixed(hashes)
    bits = np.bincount((mixed >> np.uint64(32)).astype(np.int64) & (_bits(n) - 1), minlength=_bits(n)) & 1
    if order is not None and len(order[0]):
        at = np.minimum(np.searchsorted(order[0], hashes), len(order[0]) - 1)
        mixed = mixed[np.argsort(np.where(order[0][at] == hashes, order[1][at], 0), kind="stable")]
    return np.concatenate([np.array([n], np.uint32).byteswap(), np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint32), mixed[:first].astype(np.uint32)])


def signatures(texts: list[str | None], order: tuple[np.ndarray, np.ndarray] | None = None, seen: Hashes | None = None) -> tuple[list[bytes | None], list[np.ndarray]]:
    """Of each text what :func:`split` gives of the :func:`signature` of its :func:`shingles`, many texts at once; prefixes as 32-bit numbers."""
    seen = Hashes() if seen is None else seen
    heads: list[bytes | None] = []
    prefixes: list[np.ndarray] = []
    listed = None
    if order is not None and len(order[0]):
        listed = np.zeros(1 << 22, bool)
        listed[(order[0] >> np.uint64(42)).astype(np.int64)] = True
    words: list[list[str]] = []
    n_words = 0
    for t in texts:
        own = _WORD.findall(t.lower()) if t else []
        if words and n_words + len(own) > WORDS:
            _signed(words, order, listed, seen, heads, prefixes)
            words, n_words = [], 0
        words.append(own)
        n_words += len(own)
    if words:
        _signed(words, order, listed, seen, heads, prefixes)
    return heads, prefixes


def _ramps(n: np.ndarray) -> np.ndarray:
    """0, 1, ... of each length in a row."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _signed(words: list[list[str]], order: tuple[np.ndarray, np.ndarray] | None, listed: np.ndarray | None, seen: Hashes, heads: list[bytes | None], prefixes: list[np.ndarray]) -> None:
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(n_words) - n_words
    own = np.fromiter(map(seen.__getitem__, chain.from_iterable(words)), np.uint64, int(n_words.sum()))
    # The same steps as in shingles(); a text of fewer words than a shingle ends after its last word.
    total, at = np.zeros(len(own), np.uint64), np.minimum(np.repeat(n_words, n_words), SHINGLE)
    for j in range(SHINGLE):
        more = np.flatnonzero(at[: len(own) - j] > j) if j and len(at) and at.min() <= j else slice(0, max(0, len(own) - j))
        x = (total[more] ^ own[j:][more]) * _MIX
        total[more] = x ^ (x >> np.uint64(29))
    n = np.where(n_words > 0, np.maximum(n_words - SHINGLE + 1, 1), 0)
    h = total[np.repeat(begin, n) + _ramps(n)]
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    doc = np.repeat(np.arange(len(words)), n)
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    n = np.bincount(doc, minlength=len(words))
    start = np.cumsum(n) - n
    mixed = _mixed(h)
    width = np.array([_bits(k) if k else 0 for k in n.tolist()], np.int64)
    end = np.cumsum(width)
    bit = (end - width)[doc] + ((mixed >> np.uint64(32)).astype(np.int64) & (width - 1)[doc])
    raw = np.packbits((np.bincount(bit, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    key = np.arange(len(h)) - start[doc]
    if order is not None and listed is not None:
        may = np.flatnonzero(listed[(h >> np.uint64(42)).astype(np.int64)])
        where = np.minimum(np.searchsorted(order[0], h[may]), len(order[0]) - 1)
        key[may] |= np.where(order[0][where] == h[may], order[1][where], 0) << 32
        for a, b in zip(start.tolist(), (start + n).tolist(), strict=True):
            key[a:b].sort()
    first = np.where(n > 0, n - np.ceil(LEAST * n - 1e-9).astype(np.int64) + 1, 0)
    base = np.repeat(start, first)
    prefix = mixed[base + (key[base + _ramps(first)] & 0xFFFFFFFF)].astype(np.uint32)
    heads += [k.to_bytes(4, "big") + raw[a // 8 : b // 8] if k else None for k, a, b in zip(n.tolist(), (end - width).tolist(), end.tolist(), strict=True)]
    prefixes += np.split(prefix, np.cumsum(first)[:-1])


def split(sig: np.ndarray) -> tuple[bytes | None, list[int]]:
    """Size and bitmap of a signature, and its prefix."""
    if not len(sig):
        return None, []
    end = 1 + _bits(int(sig[:1].byteswap()[0])) // 32
    return sig[:end].tobytes(), sig[end:].astype(np.int64).tolist()


def bands(sig: np.ndarray) -> list[int]:
    """The shingles of a signature's prefix, in order."""
    return split(sig)[1]


def _sets(texts: DataFrame) -> DataFrame:
    """Rows (node, s): the shingle sets of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for batch in batches:
            sets = [shingles(t, seen).view(np.int64).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return texts.mapInArrow(run, "node long, s array<long>")


def may_reach(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether two sets can have a Jaccard of LEAST, by their sizes and bitmaps, pair by pair; what follows the bitmaps is passed over."""
    m, n = (np.array([int.from_bytes(x[:4], "big") for x in s], np.int64) for s in (a, b))
    wide = [np.array([_bits(k) // 8 for k in x.tolist()], np.int64) for x in (m, n)]
    differ = np.zeros(len(m), np.int64)
    for p, q in {*zip(*(w.tolist() for w in wide), strict=True)}:
        at = np.flatnonzero((wide[0] == p) & (wide[1] == q))
        least = min(p, q) // 8
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([s[i][4 : 4 + w] for i in at.tolist()]), np.uint64).reshape(len(at), -1, least), axis=1) for s, w in ((a, p), (b, q)))
        differ[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return differ * (1 + LEAST) <= (1 - LEAST) * (m + n) + 1e-6


@F.pandas_udf(T.BooleanType())
def _may_reach(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(may_reach(a.tolist(), b.tolist()), dtype="bool")


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(x.max()))


def _wide(raw: list[bytes], n: list[int]) -> np.ndarray:
    """The numbers of such arrays, one after the other."""
    return np.concatenate([np.frombuffer(x, f"u{len(x) // k}").astype(np.int64) for x, k in zip(raw, n, strict=True)])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Arrays (shingle, node, size, pos) of a batch of (node, size, bands)."""
    n = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    shingle = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.uint32).astype(np.int64)
    node, size = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), n) for i in (0, 1))
    return shingle, node, size, _ramps(n)


def _near(size: np.ndarray, pos: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same as :func:`_room`, on arrays."""
    return np.minimum(size - pos, other - at) * (1 + LEAST) >= LEAST * (size + other) - 1e-6


_MET = "a long, b long, shingle long, size int, pos int"


def _met(a: np.ndarray, b: np.ndarray, shingle: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows of _MET: pairs (a, b), and nodes of a shingle with many as (a, null, shingle, size, pos)."""
    cols = [pa.concat_arrays([pa.array(a), pa.array(node)]), pa.concat_arrays([pa.array(b), pa.nulls(len(node), pa.int64())])]
    cols += [pa.concat_arrays([pa.nulls(len(a), kind), pa.array(x.astype(np.int64), kind)]) for x, kind in ((shingle, pa.int64()), (size, pa.int32()), (pos, pa.int32()))]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "shingle", "size", "pos"])


def _hot(nodes: DataFrame, n_nodes: int) -> list[np.ndarray]:
    """Arrays (shingle, node, size, pos), sorted: the shingles of HOT_LEAST nodes or so and more, of each one of its nodes.

    There are at most as many as all prefixes have shingles in half of HOT_LEAST. One that is passed over makes a bucket larger, no more.
    """
    least = HOT_LEAST / n_nodes / 2 if n_nodes else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingle, *rest = _rows(batch)
            found, at, n = np.unique(shingle, return_index=True, return_counts=True)
            some = n >= max(2, least * batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found[some], n[some], *(x[at[some]] for x in rest))], names=["shingle", "n", "node", "size", "pos"])

    if n_nodes < HOT_LEAST:
        return [np.empty(0, np.int64)] * 4
    found = nodes.mapInArrow(run, "shingle long, n long, node long, size long, pos long").groupBy("shingle").agg(F.sum("n").alias("n"), F.min(F.struct(F.xxhash64("node", "shingle").alias("h"), "node", "size", "pos")).alias("l"))
    rows = found.filter(F.col("n") >= HOT_LEAST // 2).select("shingle", "l.node", "l.size", "l.pos").orderBy("shingle").collect()
    return [np.array([r[i] for r in rows], np.int64) for i in range(4)]


def _held(nodes: DataFrame, hot: list[np.ndarray]) -> DataFrame:
    """Rows of _MET: the nodes of hot shingles, each held against the shingle's one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch)
            shingle, node, size, pos = (x[np.isin(rows[0], hot[0])] for x in rows)
            _, one, other, at = (x[np.searchsorted(hot[0], shingle)] for x in hot)
            near = (node != one) & _near(size, pos, other, at)
            yield _met(np.minimum(node, one)[near], np.maximum(node, one)[near], shingle, node, size, pos)

    return nodes.mapInArrow(run, _MET)


def _blocks(nodes: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Rows (bucket, base, shingle, node, size, pos): the prefixes of (node, size, bands) without ``hot``, the rows of a batch and bucket in one; nodes less ``base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch)
            if len(hot):
                cold = ~np.isin(rows[0], hot)
                rows = tuple(x[cold] for x in rows)
            bucket = rows[0] % buckets
            order = np.argsort(bucket, kind="stable")
            shingle, node, size, pos = (x[order] for x in rows)
            found, at = np.unique(bucket[order], return_index=True)
            base = node.min(initial=np.iinfo(np.int64).max)
            cols = [[x.tobytes() for x in np.split(shingle.astype(np.uint32), at[1:])] if len(at) else []]
            cols += [[_narrow(x).tobytes() for x in np.split(y, at[1:])] if len(at) else [] for y in ((node - base).view(np.uint64), size, pos)]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), base, np.int64)), *(pa.array(x, pa.binary()) for x in cols)], names=["bucket", "base", "shingle", "node", "size", "pos"])

    return nodes.mapInArrow(run, "bucket int, base long, shingle binary, node binary, size binary, pos binary")


def _meet(table: pa.Table) -> pa.Table:
    """Rows of _MET of the blocks of a bucket: the pairs that share a shingle; of one with many nodes its nodes, and their pairs with one of them."""
    raw = {c: table.column(c).to_pylist() for c in ("base", "shingle", "node", "size", "pos")}
    lengths = [len(x) // 4 for x in raw["shingle"]]
    shingle = _wide(raw["shingle"], lengths)
    order = np.argsort(shingle)
    shingle = shingle[order]
    heads = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    n = np.diff(np.append(heads, len(shingle)))
    n = np.repeat(n, n)
    order, shingle, n = order[n > 1], shingle[n > 1], n[n > 1]
    size, pos = (_wide(raw[c], lengths)[order] for c in ("size", "pos"))
    node = (_wide(raw["node"], lengths) + np.repeat(np.array(raw["base"], np.int64), lengths))[order]
    names, own = np.unique(node, return_inverse=True)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        some = (own[i] != own[j]) & _near(size[i], pos[i], size[j], pos[j])
        x, y = own[i[some]], own[j[some]]
        return np.unique(np.minimum(x, y) * len(names) + np.maximum(x, y))

    pairs = [np.empty(0, np.int64)]
    at = np.flatnonzero(n <= MEET)
    for d in range(1, MEET):
        at = at[at + d < len(shingle)]
        at = at[shingle[at] == shingle[at + d]]
        pairs.append(near(at, at + d))
    many = np.flatnonzero(n > MEET)
    if len(many):
        of = shingle[many]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        chance = _mixed(node[many].view(np.uint64) ^ _mixed(of.astype(np.uint64)))
        one = np.flatnonzero(chance == np.repeat(np.minimum.reduceat(chance, heads), n[many][heads]))
        one = many[one[np.unique(of[one], return_index=True)[1]]]
        pairs.append(near(many, np.repeat(one, n[many][heads])))
    pair = np.unique(np.concatenate(pairs))
    k = max(1, len(names))
    return pa.Table.from_batches([_met(names[pair // k], names[pair % k], *(x[many] for x in (shingle, node, size, pos)))])


def _room(a: str, b: str):
    """Whether the shingle that sets ``a`` and ``b`` share can be the first of as many as LEAST needs."""
    left = F.least(*(F.col(f"{x}.size") - F.col(f"{x}.pos") for x in (a, b)))
    return left * (1 + LEAST) >= LEAST * (F.col(f"{a}.size") + F.col(f"{b}.size")) - 1e-6


def _ends():
    return F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")


def _confirmed(met: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``met`` with a Jaccard of LEAST or more."""
    sigs = nodes.select("node", "sig")
    n_met = met.count()
    both = lookup(met, "a", sigs.select(F.col("node").alias("ka"), F.col("sig").alias("sa")), "ka", n_met)
    both = lookup(both, "b", sigs.select(F.col("node").alias("kb"), F.col("sig").alias("sb")), "kb", n_met)
    pairs = both.filter(_may_reach("sa", "sb")).select("a", "b").checkpoint()
    n_pairs = pairs.count()
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().checkpoint()
    # Texts whose hashed id no wanted document has stay where they are; the table of hashes is bounded by BUCKETS.
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).alias("_h")
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", bucket("doc_id")).join(F.broadcast(wanted.select(bucket("node")).distinct()), "_h", "left_semi").drop("_h")
    texts = wanted.join(own, F.col("node") == F.col("doc_id")).groupBy("node").agg(F.max("text").alias("text"))
    sets = _sets(texts).checkpoint()
    both = lookup(pairs, "a", sets.select(F.col("node").alias("ka"), F.col("s").alias("sa")), "ka", n_pairs)
    both = lookup(both, "b", sets.select(F.col("node").alias("kb"), F.col("s").alias("sb")), "kb", n_pairs)
    same = F.size(F.array_intersect("sa", "sb"))
    return both.filter(same >= LEAST * (F.size("sa") + F.size("sb") - same) - 1e-6).select("a", "b").checkpoint()


def clustered(items: DataFrame, documents: DataFrame) -> DataFrame:
    """``items`` (doc_id, copy_key, bands, sig, ...) with copy_key replaced by the cluster's, bands and sig dropped.

    ``documents`` has doc_id and text of the items.
    """
    nodes = items.filter("copy_key is not null and size(bands) > 0").groupBy("copy_key").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("d")).select("copy_key", F.col("d.doc_id").alias("node"), "d.bands", "d.sig").checkpoint()
    size = F.conv(F.hex(F.substring("sig", 1, 4)), 16, 10).cast("int").alias("size")
    n_nodes, own = nodes.count(), nodes.select("node", size, "bands")
    hot = _hot(own, n_nodes)
    found = _blocks(own, n_nodes // BUCKET_NODES + 1, hot[0]).groupBy("bucket").applyInArrow(_meet, _MET)
    own = (found.unionByName(_held(own, hot)) if len(hot[0]) else found).checkpoint()
    met = own.filter("shingle is null").select("a", "b").distinct().checkpoint()
    many = own.filter("shingle is not null").select("shingle", F.struct(F.col("a").alias("node"), "size", "pos").alias("r"))
    edges = _confirmed(met, nodes, documents)
    of = connected_components(edges).select("node", "component").checkpoint()
    if not many.isEmpty():
        part = many.select("shingle", "r", F.col("r.node").alias("node")).join(of, "node", "left").select("shingle", "r", F.coalesce("component", "node").alias("c")).checkpoint()
        apart = part.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.expr(f"cast(ceil(count(*) / {SLICE}) as int)").alias("slices")).filter("lo < hi").select("shingle", "slices")
        part = part.join(apart, "shingle")
        left = part.select("shingle", F.col("r").alias("l"), F.col("c").alias("lc"), F.pmod(F.xxhash64("r.node"), F.col("slices")).cast("int").alias("slice"))
        right = part.select("shingle", "r", F.col("c").alias("rc"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        rest = left.join(right, ["shingle", "slice"]).filter("l.node < r.node and lc <> rc").filter(_room("l", "r")).select(*_ends()).distinct().checkpoint()
        of = connected_components(edges.unionByName(_confirmed(rest, nodes, documents)))
    keyed = items.drop("bands", "sig")
    key = nodes.select("copy_key", "node").join(of, "node").select(F.col("copy_key").alias("_key"), "component")
    # A cluster goes by the copy key of its least node.
    key = key.join(nodes.select(F.col("node").alias("component"), F.col("copy_key").alias("cluster")), "component").select("_key", "cluster")
    hit = lookup(keyed.select("doc_id", "copy_key"), "copy_key", key, "_key", keyed.count()).select(F.col("doc_id").alias("_id"), "cluster")
    return keyed.join(hit, keyed["doc_id"] == hit["_id"], "left").withColumn("copy_key", F.coalesce("cluster", "copy_key")).drop("_id", "cluster")
