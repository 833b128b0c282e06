"""Connected components by repeated label exchange on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recallspark.llm.arrow import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """For every vertex v of the edges (a, b) the smallest vertex c it is connected with, as a written table.

    Each round a vertex takes the smallest label of itself and its neighbours,
    then the label of that label, so paths shorten by halves; the rounds end when no
    label changed. Everything stays in tables.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(edges.select(F.inline(ways)).distinct())
    labels = written = scratch.write(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        heard = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        nearer = labels.join(heard, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jumped = nearer.join(
            labels.select(F.col("v").alias("c"), F.col("c").alias("next")), "c", "left"
        ).select("v", "old", F.least("c", F.coalesce("next", "c")).alias("c"))
        # counted while it is written, so that no pass is needed to see the end
        changed = Observation()
        new = scratch.write(jumped.observe(changed, F.count(F.when(F.col("c") < F.col("old"), 1)).alias("rows")))
        scratch.drop(written)
        if not changed.get["rows"]:
            scratch.drop(both)
            return new
        labels, written = new.select("v", "c"), new


def joined_by(known: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (v, c) once edges (a, b) are added to `known` ones, as a written table.

    Only the edges between different components take part in the rounds, as edges between the
    components' smallest vertices. A vertex that `known` lacks is its own component.
    """
    of = [known.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in ("a", "b")]
    named = edges.join(of[0], "a", "left").join(of[1], "b", "left")
    named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connected(named.filter("a != b"), scratch)
    moved = known.join(merged.select(F.col("v").alias("c"), F.col("c").alias("into")), "c", "left")
    added = merged.select("v", "c").join(known.select("v"), "v", "left_anti")
    new = scratch.write(moved.select("v", F.coalesce("into", "c").alias("c")).union(added))
    scratch.drop(merged)
    return new
