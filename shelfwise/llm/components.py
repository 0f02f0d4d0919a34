"""Connected components of an edge table, by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a long, b long) reaches.

    Every round hangs each node's neighbours on its smallest one, then each root on the smallest root that its members
    see (hooking and pointer jumping); paths shorten by half at least, so rounds grow with the logarithm of the longest.
    Only minima are gathered, never lists, and each round's labels are a table in the shared folder.
    """
    both = common.stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges"
    )
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    held = labels = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        # the smallest root among the neighbours of each node
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        met = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("near"))
        # a root takes the smallest that any of its members has met
        hooked = met.groupBy("root").agg(F.min("near").alias("up"))
        step = met.join(hooked, "root").select("node", "root", F.least("near", "up").alias("next"))
        # jump: the root of the root
        over = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = common.stored(
            step.join(over, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("was")), "labels"
        )
        changed = after.filter("root <> was").limit(1).count()
        common.forget(held)
        held, labels = after, after.select("node", "root")
        if not changed:
            common.forget(both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
