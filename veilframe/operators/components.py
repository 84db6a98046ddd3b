"""Connected components of an edge list, by repeated minimum-label hops and pointer jumping.

Nothing is collected but a flag a round. The two joins of a round - edges with labels on a node, labels with labels on
a component - would send all rows of a hot key to one task. Keys with more than a :data:`HOT_PARTS`-th of the rows
(at most HOT_PARTS of them can exist, whatever the data) are therefore looked up in a broadcast table, and only the
others are shuffled. Aggregates combine on the map side. Labels are cut from their lineage by checkpoint() each
round, so a lost executor costs at most a round. Rounds grow with the logarithm of the longest path.

Defined results: null ends and self-loops are passed over; repeated edges change nothing; no edges give no rows.
Nodes without an edge are not in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import ensure_checkpoint_dir, unsized

HOT_PARTS = 1000
#: A key with fewer rows than this is never hot: as many of these narrow rows are a small task.
HOT_LEAST = 1_000_000


def lookup(rows: DataFrame, key: str, values: DataFrame, at: str, n_rows: int) -> DataFrame:
    """``rows`` inner-joined with ``values`` (one row per ``at``), hot keys of ``rows`` by broadcast."""
    if n_rows < HOT_LEAST:
        return rows.join(unsized(values), rows[key] == values[at])
    hot = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(HOT_LEAST, n_rows // HOT_PARTS)).select("_hot").checkpoint()
    if hot.isEmpty():
        return rows.join(unsized(values), rows[key] == values[at])
    hot = F.broadcast(hot)
    few = F.broadcast(values.join(hot, F.col(at) == F.col("_hot"), "left_semi"))
    cold = rows.join(hot, F.col(key) == F.col("_hot"), "left_anti").join(unsized(values), F.col(key) == F.col(at))
    return rows.join(few, F.col(key) == F.col(at)).unionByName(cold)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Rows (node, component): the least node id reachable. Raises if ``max_rounds`` do not suffice."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    e = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint()
    n_edges = e.count()
    labels = e.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).select(F.col("x").alias("node"), "label").checkpoint()
    n_nodes = labels.count()
    for _ in range(max_rounds):
        near = lookup(e, "y", labels, "node", n_edges).groupBy("x").agg(F.min("label").alias("near"))
        hop = labels.join(unsized(near), labels["node"] == near["x"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        new = lookup(hop, "label", of, "at", n_nodes).select("node", F.least("label", "jump").alias("label"), "old").checkpoint()
        moved = not new.filter("label <> old").isEmpty()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")
