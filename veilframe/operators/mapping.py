"""Pseudonyms: one per (category, key) over all documents, numbered in the order in which keys are first seen.

Numbers are given without one task seeing a category: first occurrences are range-partitioned in order, counted per
partition, and each partition adds the counts before it. A key that an earlier run has issued keeps its number; new
ones follow the largest number of their category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import checks
from veilframe.functions.lexicon import LABELS, NUMBERED
from veilframe.session import ensure_checkpoint_dir


def pseudonym(category: Column, idx: Column) -> Column:
    """[label + letters] for people, organisations and departments, [label + number] for the rest; idx counts from 0.

    A category that is none of the known ones is its own label, without what is no letter.
    """
    label = lambda names, other: F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[category], other)
    named = label(LABELS, F.lit(None).cast("string"))
    other = label(NUMBERED, F.regexp_replace(category, "[^A-Za-z가-힣]", ""))
    return F.concat(F.lit("["), F.when(named.isNotNull(), F.concat(named, checks.alpha_tag(idx))).otherwise(F.concat(other, (idx + 1).cast("string"))), F.lit("]"))


def numbered(keys: DataFrame, group: str, order: list[str], into: str) -> DataFrame:
    """``keys`` with its rank from 0 within ``group`` by ``order``, which must be unique within a group."""
    ensure_checkpoint_dir(keys.sparkSession)
    ranged = keys.repartitionByRange(group, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p", group).orderBy(*order)) - 1)
    counts = ranged.groupBy(group, "_p").agg(F.count("*").alias("_c"))  # a row per group and partition
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "_p", F.coalesce(before, F.lit(0)).alias("_b"))
    counts = counts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), "_b")
    met = local.join(counts, (F.col("_p") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g"))).drop("_g", "_q")
    return met.withColumn(into, (F.col("_n") + F.col("_b")).cast("long")).drop("_p", "_n", "_b")


def issue(values: DataFrame, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Rows (category, map_key, original, idx, pseudonym, n_used) for ``values`` (category, value, *order).

    ``original`` is the first spelling of a key. Null or blank values and null categories have no key. ``existing``
    (category, map_key, idx) keeps its numbers and is not returned again.
    """
    v = values.filter("category is not null and trim(value) <> ''").withColumn("map_key", checks.mapping_key(F.col("value")))
    first = v.groupBy("category", "map_key").agg(F.min(F.struct(*order, "value")).alias("f"), F.count("*").alias("n_used"))
    keys = first.select("category", "map_key", F.col("f.value").alias("original"), *(F.col(f"f.{c}").alias(c) for c in order), "n_used")
    if existing is not None:
        keys = keys.join(existing.select("category", "map_key").distinct(), ["category", "map_key"], "left_anti")
    out = numbered(keys, "category", [*order, "map_key"], "idx")
    if existing is not None:
        tops = existing.groupBy("category").agg((F.max("idx") + 1).alias("_top"))
        out = out.join(tops, "category", "left").withColumn("idx", F.col("idx") + F.coalesce("_top", F.lit(0))).drop("_top")
    return out.select("category", "map_key", "original", "idx", pseudonym(F.col("category"), F.col("idx")).alias("pseudonym"), "n_used")
