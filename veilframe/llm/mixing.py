"""Mixing sources to target shares of all tokens.

The total of a mix is the largest for which no source would have to repeat its documents more often than its cap
allows (a source without documents cannot take part; the others keep their proportions). A source's budget is its
share of that total. Complete epochs over the source come first: every document once per whole multiple of the
source's size in the budget. The rest is drawn by Efraimidis-Spirakis sampling: each document has the exponential
key -ln(u)/w, u uniform by hash of mix and id, w its quality weight; in the order of the keys documents are taken
while their running sum of tokens stays within the rest. A document that does not fit ends a pass; what it leaves is
drawn from the documents that fit in it, pass by pass, until none fits. So a source misses its budget by less than its
smallest document that is not drawn; the report gives what is missing. A pass leaves less than the document that ended
it, so passes are few; each works only on what the one before left over.

The running sum is in two steps, so that a hot source is no task of its own: keys are put into
:data:`BUCKETS` ordered buckets, the buckets' sums are added up per source (at most ``BUCKETS`` rows), and only the
rows of one bucket are sorted among themselves.

Defined results: documents of 0 tokens and sources outside a mix are not drawn; a null source belongs to no target;
shares that do not add up to 1 are scaled; a mix whose sources all lack documents selects nothing and is reported
with zeros. Repeats are counted, not repeated as rows. Ties of a key go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import ensure_checkpoint_dir

BUCKETS = 4096


def budgets(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (mix_id, source, target_share, max_repeats, available, epochs, rest): what each source has to give."""
    have = items.filter("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.select("mix_id", "source", "target_share", "max_repeats").distinct().join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    takes = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    mix = Window.partitionBy("mix_id")  # as many rows as the mix has sources
    t = t.withColumn("share", F.when(takes, F.col("target_share")) / F.sum(F.when(takes, F.col("target_share"))).over(mix))
    t = t.withColumn("total", F.min(F.col("max_repeats") * F.col("available") / F.col("share")).over(mix))
    budget = F.coalesce(F.least(F.floor(F.col("share") * F.col("total") + F.lit(1e-6)), F.col("max_repeats") * F.col("available")), F.lit(0)).cast("long")
    t = t.withColumn("budget", budget).withColumn("epochs", F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0).cast("long"))
    return t.select("mix_id", "source", "target_share", "max_repeats", "available", "epochs", (F.col("budget") - F.col("epochs") * F.col("available")).alias("rest"))


def select(items: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """Rows (mix_id, doc_id, source, n_tokens, repeats). ``items`` needs doc_id, source, n_tokens and quality."""
    # The plan has a row for each target; targets are a parameter table.
    takes = items.filter("n_tokens > 0").join(F.broadcast(plan.select("mix_id", "source", "epochs", "rest")), "source")
    u = (F.expr(f"shiftrightunsigned(xxhash64(mix_id, doc_id, {seed}L), 11)").cast("double") + 0.5) / F.lit(float(1 << 53))
    drawn = takes.withColumn("k", -F.log(u) / F.greatest("quality", F.lit(0.001)))
    # 1 - exp(-k) keeps the order of the keys and lies between 0 and 1.
    drawn = drawn.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("k"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    ensure_checkpoint_dir(items.sparkSession)
    drawn = drawn.select("mix_id", "source", "doc_id", "n_tokens", "epochs", "k", "bucket", F.col("rest").alias("left")).checkpoint()
    whole = drawn.filter("epochs > 0").select("mix_id", "source", "doc_id", "n_tokens", F.col("epochs").alias("n"))
    may, taken = drawn.filter("n_tokens <= left"), []
    while not may.isEmpty():
        once, may = _draw(may)
        taken.append(once)
    for t in taken:
        whole = whole.unionByName(t.select("mix_id", "source", "doc_id", "n_tokens", F.lit(1).cast("long").alias("n")))
    out = whole.groupBy("mix_id", "doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.sum("n").cast("int").alias("repeats"))
    return out.select("mix_id", "doc_id", "source", "n_tokens", "repeats")


def _draw(may: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass in the order of the keys over documents that each fit in what is left: those drawn, and those that still fit."""
    of = ["mix_id", "source", "bucket"]
    sums = may.groupBy(*of).agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    met = may.join(sums, of)
    whole = F.col("before") + F.col("n") <= F.col("left")
    # Only the bucket in which the sum reaches what is left is put in order.
    running = F.sum("n_tokens").over(Window.partitionBy(*of).orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = met.filter(~whole & (F.col("before") < F.col("left"))).withColumn("once", F.col("before") + running <= F.col("left"))
    rest = met.filter(whole | (F.col("before") >= F.col("left"))).withColumn("once", whole)
    both = edge.unionByName(rest).drop("n", "before").checkpoint()
    took = both.groupBy("mix_id", "source").agg(F.coalesce(F.sum(F.when(F.col("once"), F.col("n_tokens"))), F.lit(0)).alias("taken"))
    # One row for each target of the parameter table.
    left = both.filter(~F.col("once")).drop("once").join(F.broadcast(took), ["mix_id", "source"]).withColumn("left", F.col("left") - F.col("taken")).drop("taken")
    return both.filter("once"), left.filter("n_tokens <= left").checkpoint()


def report(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (mix_id, source, target_share, share, n_docs, n_tokens, most_repeats, missing): the shares reached and the tokens of the budget not reached."""
    got = selected.groupBy("mix_id", "source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    out = plan.select("mix_id", "source", "target_share", (F.col("epochs") * F.col("available") + F.col("rest")).alias("budget")).join(got, ["mix_id", "source"], "left")
    out = out.select("mix_id", "source", "target_share", "budget", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "most_repeats")))
    out = out.withColumn("missing", F.col("budget") - F.col("n_tokens")).drop("budget")
    total = F.sum("n_tokens").over(Window.partitionBy("mix_id"))
    return out.withColumn("share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))
