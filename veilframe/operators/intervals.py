"""Union of half-open integer intervals per entity, and the gaps between them.

The positions are discretised exactly. An entity's axis is cut into shards of ``2**SHARD_BITS`` positions and
each shard into 64-bit words. An interval leaves at most: a mask in its first word, a mask in its last word, runs
of full words inside its first and last shard, and one run of full shards. Masks of a word unite by ``bit_or`` and
runs by ``max(end)``, both before the shuffle, so what an (entity, shard) can send is bounded by its number of
words whatever the number of rows: a hot entity does not make a large task. Set runs are then read out of each
shard; only a shard's first and last run and the runs of full shards go to the stitching of an entity (at most two rows
for a shard in which an interval begins or ends). A long interval is a run, not a row for each of its shards.

Defined results: a row with a null bound or with end <= start covers nothing. Null entity keys form an entity of
their own. Negative positions are ordinary positions. Repeated and equal rows change nothing. Other columns are
ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD_BITS = 6
SHARD_BITS = 16


#: Bits _lo.._hi-1 of a word; 0 <= _lo < _hi <= 64.
_MASK = "shiftleft(shiftrightunsigned(-1L, 64 - (_hi - _lo)), _lo)"


def coverage(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows (*keys, kind, start, end): 'cover' for each longest covered stretch, 'gap' between two of them."""
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = intervals.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")).filter(
        F.col("_s").isNotNull() & F.col("_e").isNotNull() & (F.col("_e") > F.col("_s"))
    )
    # Pieces: level 0 is a mask of word `at`, 1 a run of full words [at, to) within a shard, 2 a run of full shards.
    size, word_of, shard_of = 1 << WORD_BITS, lambda x: f"shiftright({x}, {WORD_BITS})", lambda x: f"shiftright({x}, {SHARD_BITS})"
    step = SHARD_BITS - WORD_BITS
    w0, w1 = F.expr(word_of("_s")), F.expr(word_of("_e - 1"))
    rows = rows.withColumns({"_w0": w0, "_w1": w1}).withColumns({
        # the full words of the interval: [_f0, _f1)
        "_f0": F.when(F.col("_s") % size == 0, F.col("_w0")).otherwise(F.col("_w0") + 1),
        "_f1": F.when(F.col("_e") % size == 0, F.col("_w1") + 1).otherwise(F.col("_w1")),
    })
    has_full = F.col("_f1") > F.col("_f0")
    word_start = lambda w: F.expr(f"shiftleft({w}, {WORD_BITS})")

    def piece(level, at, to, lo=F.lit(0), hi=F.lit(64)):
        return F.struct(F.lit(level).alias("level"), at.cast("long").alias("at"), to.cast("long").alias("to"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    head = F.when(
        (F.col("_s") % size != 0) | (F.col("_w0") == F.col("_w1")) & ~has_full,
        piece(0, F.col("_w0"), F.col("_w0") + 1, F.col("_s") - word_start("_w0"), F.least(F.col("_e") - word_start("_w0"), F.lit(64))),
    )
    tail = F.when((F.col("_e") % size != 0) & (F.col("_w1") > F.col("_w0")), piece(0, F.col("_w1"), F.col("_w1") + 1, F.lit(0), F.col("_e") - word_start("_w1")))
    # full words, cut at shard borders
    h0, h1 = F.expr(f"shiftright(_f0, {step})"), F.expr(f"shiftright(_f1 - 1, {step})")
    s0 = F.expr(f"shiftright(_f0 + {(1 << step) - 1}, {step})")  # first shard that is full
    s1 = F.expr(f"shiftright(_f1, {step})")  # end of the full shards
    full_head = F.when(has_full, F.when(h0 == h1, piece(1, F.col("_f0"), F.col("_f1"))).otherwise(F.when(h0 < s0, piece(1, F.col("_f0"), F.expr(f"shiftleft(shiftright(_f0, {step}) + 1, {step})")))))
    full_tail = F.when(has_full & (h0 < h1) & (h1 >= s1), piece(1, F.expr(f"shiftleft(shiftright(_f1 - 1, {step}), {step})"), F.col("_f1")))
    shards = F.when(has_full & (h0 < h1) & (s1 > s0), piece(2, s0, s1))
    pieces = rows.select(*ks, F.explode(F.filter(F.array(head, tail, full_head, full_tail, shards), lambda x: x.isNotNull())).alias("_p")).select(*ks, "_p.*")
    pieces = pieces.withColumns({"_lo": F.col("lo"), "_hi": F.col("hi")})
    united = (
        pieces.withColumn("mask", F.when(F.col("level") == 0, F.expr(_MASK)).otherwise(F.lit(0).cast("long")))
        .groupBy(*ks, "level", "at")
        .agg(F.bit_or("mask").alias("mask"), F.max("to").alias("to"))
    )
    # Set runs of each word: a run starts at a set bit after a clear one. At most 32 in a word.
    bit = lambda m, i: F.call_function("getbit", m, i) == 1
    starts = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(F.col("mask"), i) & ((i == 0) | ~bit(F.col("mask"), F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(F.col("mask"), i) & ((i == 63) | ~bit(F.col("mask"), F.least(i + 1, F.lit(63)))))
    word_runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct((word_start("at") + r["a"]).alias("s"), (word_start("at") + r["b"] + 1).alias("e")))
    runs = F.when(F.col("level") == 0, word_runs).when(F.col("level") == 1, F.array(F.struct(word_start("at").alias("s"), word_start("to").alias("e")))).otherwise(
        F.array(F.struct(F.expr(f"shiftleft(at, {SHARD_BITS})").alias("s"), F.expr(f"shiftleft(to, {SHARD_BITS})").alias("e")))
    )
    flat = united.select(*ks, "level", F.explode(runs).alias("r")).select(*ks, "level", F.col("r.s").alias("s"), F.col("r.e").alias("e"))

    # Runs of full shards stay runs, however long. What else lies in their shards is covered and goes.
    full = _islands(flat.filter(F.col("level") == 2).select(*ks, "s", "e"), ks)
    inside = flat.filter(F.col("level") < 2).select(*ks, "s", "e", F.expr(shard_of("s")).alias("shard"))
    local = _islands(inside, [*ks, "shard"])
    local = _without(local, _covered(local, full, ks), [*ks, "shard"])
    order = Window.partitionBy(*ks, "shard").orderBy("s")
    local = local.withColumns({"before": F.lag("e").over(order), "after": F.lead("s").over(order)})
    is_edge = F.col("before").isNull() | F.col("after").isNull()
    cover = F.struct(F.lit("cover").alias("kind"), "s", "e")
    gap = F.struct(F.lit("gap").alias("kind"), F.col("before").alias("s"), F.col("s").alias("e"))
    across = _islands(local.filter(is_edge).select(*ks, "s", "e").unionByName(full.select(*ks, "s", "e")), ks).withColumn("before", F.lag("e").over(Window.partitionBy(*ks).orderBy("s")))
    # The last position before a gap and the first after it lie in one shard only if that shard gave the gap.
    new_gap = F.col("before").isNotNull() & (F.expr(shard_of("before - 1")) != F.expr(shard_of("s")))
    give = lambda df, covers, gaps: df.select(*ks, F.explode(F.filter(F.array(F.when(covers, cover), F.when(gaps, gap)), lambda x: x.isNotNull())).alias("x")).select(*ks, "x.*")
    kinds = dict(intervals.dtypes)
    return (
        give(local, ~is_edge, F.col("before").isNotNull()).unionByName(give(across, F.lit(True), new_gap))
        .select(*(F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)), "kind", F.col("s").cast(kinds[start]).alias(start), F.col("e").cast(kinds[end]).alias(end))
    )


def _same(left: DataFrame, right: DataFrame, by: list[str]):
    """Join condition on keys of which null is one."""
    out = F.lit(True)
    for c in by:
        out = out & left[c].eqNullSafe(right[f"{c}_r"])
    return out


def _without(rows: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    right = gone.select(*(F.col(c).alias(f"{c}_r") for c in by))
    return rows.join(right, _same(rows, right, by), "left_anti")


#: Levels of dyadic blocks: enough for every 64-bit position.
LEVELS = 64 - SHARD_BITS


def _covered(local: DataFrame, full: DataFrame, ks: list[str]) -> DataFrame:
    """Rows (*ks, shard): shards of ``local`` that lie in a run of full shards.

    A run is cut into dyadic blocks, at most two a level; a shard lies in one block of each level. So a range meets its
    shards by equality. Only shards of entities that have a full run at all are looked up.
    """
    lo, hi = F.expr(f"shiftright(s, {SHARD_BITS})"), F.expr(f"shiftright(e, {SHARD_BITS})")
    # Blocks of level l that stick out at the start (odd index) or at the end of what is left of the run.
    runs = full.select(*ks, lo.alias("a"), hi.alias("z"))
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    at = lambda x, l, up: F.call_function("shiftright", F.col(x) + (F.call_function("shiftleft", F.lit(1).cast("long"), l) - 1 if up else 0), l)
    pair = lambda l: F.struct(l.alias("l"), at("a", l, True).alias("x"), at("z", l, False).alias("y"))
    pieces = runs.select(*ks, F.explode(F.transform(levels, pair)).alias("p")).select(*ks, "p.*").filter("x < y")
    # At its level a run covers blocks x..y-1; those with a parent that is covered too are left to the parent.
    inner = F.filter(F.array(F.when(F.col("x") % 2 != 0, F.col("x")), F.when((F.col("y") % 2 != 0) & ((F.col("y") - 1 != F.col("x")) | (F.col("x") % 2 == 0)), F.col("y") - 1)), lambda v: v.isNotNull())
    blocks = pieces.select(*ks, "l", F.explode(inner).alias("b"))
    own = local.select(*ks, "shard").distinct()
    some = full.select(*(F.col(c).alias(f"{c}_r") for c in ks)).distinct()
    own = own.join(some, _same(own, some, ks), "left_semi")
    own = own.select(*ks, "shard", F.explode(levels).alias("l")).withColumn("b", F.expr("shiftright(shard, l)"))
    right = blocks.select(*(F.col(c).alias(f"{c}_r") for c in (*ks, "l", "b")))
    return own.join(right, _same(own, right, [*ks, "l", "b"]), "left_semi").select(*ks, "shard").distinct()


def _islands(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs that touch or overlap, joined."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")
