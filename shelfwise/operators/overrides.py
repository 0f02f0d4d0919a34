"""One log of manual overrides of families: moves, merges, splits and undos, settled at once.

A log row is (session, seq, action, key, source, target, keys). `move` puts key from source to target, `merge` all of source
into target, `split` takes keys out of source into a family of their own (target "new_family") or out of all families
(target "standalone"), `undo` reverses the last action that still stands. Null and "standalone" mean no family. The log
holds what was accepted: a split lists keys that were in its source.

Undoing is bracket matching, so no replay step by step is needed: with +1 for an action and -1 for an undo, floored at 0, an
action stands if the running sum never falls below its own level again. What stands is order-free but for two things: the
last placing of a key, and the merges after it, whose chains are followed by pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

c = F.col

LOG = "session string, seq long, action string, key string, source string, target string, keys array<string>"


def standing(log: DataFrame) -> DataFrame:
    """The actions that no undo reverses; an undo with nothing left to reverse does nothing."""
    order = W.partitionBy("session").orderBy("seq")
    run = log.withColumn("sum", F.sum(F.when(c("action") == "undo", -1).otherwise(1)).over(order))
    # undos with nothing to reverse lift the floor
    level = c("sum") - F.least(F.lit(0), F.min("sum").over(order))
    run = run.withColumn("level", level)
    # from behind, so that the lowest level that follows is a running minimum too
    after = F.min("level").over(W.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1))
    return run.withColumn("after", after).filter((c("action") != "undo") & (c("after").isNull() | (c("after") >= c("level")))).select(*log.columns)


def split_id(source: Column, keys: Column) -> Column:
    """The id of the family that a split makes."""
    return F.concat(F.lit("FAM-"), F.substring(F.sha2(F.concat(F.lit("manual-split-"), source, F.lit("-"), F.array_join(F.array_sort(F.array_distinct(keys)), "-")), 256), 1, 16))


def _family(x: Column) -> Column:
    return F.nullif(x, F.lit("standalone"))


def _next_merges(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """rows (session, family, at, ...) with `next`, the (seq, target) of the first merge of their family after at, null for none.

    Rows and merges are put in one order and read from behind, so none of a family's merges are gathered and none sent to the driver.
    """
    merge = F.struct("seq", "target")
    events = merges.select("session", c("source").alias("family"), c("seq").alias("_at"), merge.alias("_merge"))
    asked = rows.select("session", "family", c("at").alias("_at"), F.struct(*rows.columns).alias("_row"))
    # a merge at a row's own place isn't after it: at one place rows come first from behind
    behind = W.partitionBy("session", "family").orderBy(F.desc("_at"), F.col("_merge").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = asked.unionByName(events, allowMissingColumns=True).withColumn("next", F.last("_merge", ignorenulls=True).over(behind))
    return both.filter("_row is not null").select("_row.*", "next")


def merge_ends(stands: DataFrame) -> DataFrame:
    """(session, source, seq, target) of each standing merge, target being where its members are in the end.

    A merge is followed by the first later merge of its target. Each round doubles the way that is known.
    """
    edges = stands.filter("action = 'merge'").select("session", "source", "seq", "target")
    follows = _next_merges(edges.select("*", c("target").alias("family"), c("seq").alias("at")), edges)
    held = written(follows.select("session", "source", "seq", "target", c("next.seq").alias("next")), "merges")
    while not held.filter("next is not null").isEmpty():
        onward = held.select("session", c("seq").alias("next"), c("target").alias("far"), c("next").alias("further"))
        # both sides grow with the log, so neither is sent through the driver
        joined = held.join(onward.hint("merge"), ["session", "next"], "left")
        held = written(joined.select("session", "source", "seq", F.coalesce("far", "target").alias("target"), c("further").alias("next")), "merges")
    return held.drop("next")


def settled(members: DataFrame, log: DataFrame) -> DataFrame:
    """members (session, key, family_id) after the log; moved says whether an override that stands has carried the key."""
    stands = written(standing(log), "overrides")
    moves = stands.filter("action = 'move'").select("session", "key", "seq", _family(c("target")).alias("to"))
    made = F.when(c("target") == "standalone", F.lit(None).cast("string")).otherwise(split_id(c("source"), c("keys")))
    splits = stands.filter("action = 'split'").select("session", F.explode("keys").alias("key"), "seq", made.alias("to"))
    last = moves.unionByName(splits).groupBy("session", "key").agg(F.max("seq").alias("at"), F.max_by("to", "seq").alias("to"))
    placed = members.select("session", "key", _family(c("family_id")).alias("family_id")).join(last.hint("merge"), ["session", "key"], "left")
    placed = placed.select("session", "key", F.when(c("at").isNull(), c("family_id")).otherwise(c("to")).alias("family"), F.coalesce("at", F.lit(-1)).alias("at"))
    # of each family's merges the first after the key was placed there; keys without a family meet none
    joined = _next_merges(placed.filter("family is not null"), merge_ends(stands)).unionByName(placed.filter("family is null"), allowMissingColumns=True)
    end = c("next.target")
    return joined.select("session", "key", F.coalesce(end, "family").alias("family_id"), ((c("at") >= 0) | end.isNotNull()).alias("moved"))


def made_by_splits(log: DataFrame, suffix: str = " (splittet)") -> DataFrame:
    """(session, seq, family_id, name, reason, review_required) of the families that standing splits have made; name is the log's key column if it has one, else the source's id and a suffix."""
    new = standing(log).filter("action = 'split' and coalesce(target, 'new_family') <> 'standalone'")
    name = F.coalesce(F.nullif("key", F.lit("")), F.concat("source", F.lit(suffix)))
    return new.select("session", "seq", split_id(c("source"), c("keys")).alias("family_id"), name.alias("name"), F.concat(F.lit("Manuelt splittet fra "), "source").alias("reason"), F.lit(True).alias("review_required"))
