"""Requests over a limit in windows that start at a key's first hit, without a replay.

Every hit points to the first hit of its key that is not in the window it would start. The window starts are what the first
hit reaches along these pointers; they are marked in rounds that double the distance, so a key with many windows takes few
rounds. Hits of one millisecond are one row, so a window has no more rows than milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradesift.operators.ordered import with_last_marked
from tradesift.session import checkpointed


def _with_next(hits: DataFrame, length_ms: int) -> DataFrame:
    """(key, at_ms, next_ms): the first hit after the window that each hit would start; the latest hits come first here."""
    own = hits.select("key", (-F.col("at_ms")).alias("back"), F.lit(0).alias("kind"), "at_ms")
    asked = hits.select("key", (-F.col("at_ms") - length_ms).alias("back"), F.lit(1).alias("kind"), "at_ms")
    both = own.unionByName(asked)
    found = with_last_marked(both, ["key"], ["back", "kind"], {"_kind": "kind"}, F.col("kind") == 0, {"next_ms": "at_ms"})
    return found.where("kind = 1 AND next_ms IS NOT NULL").select("key", "at_ms", "next_ms")


def window_starts(hits: DataFrame, length_ms: int) -> DataFrame:
    """(key, at_ms) of the hits that start a window."""
    jumps = checkpointed(_with_next(hits, length_ms))
    starts = checkpointed(hits.groupBy("key").agg(F.min("at_ms").alias("at_ms")))
    while True:
        reached = starts.join(jumps, ["key", "at_ms"]).select("key", F.col("next_ms").alias("at_ms"))
        more = checkpointed(reached.join(starts, ["key", "at_ms"], "left_anti"))
        if more.isEmpty():
            return starts
        starts = checkpointed(starts.unionByName(more))
        further = jumps.select("key", F.col("at_ms").alias("next_ms"), F.col("next_ms").alias("_next"))
        jumps = checkpointed(jumps.join(further, ["key", "next_ms"]).select("key", "at_ms", F.col("_next").alias("next_ms")))


def limit_requests(requests: DataFrame, limit: int, length_ms: int) -> DataFrame:
    """(key, at_ms, hits, allowed, refused) per key and millisecond; a null key is a key of its own."""
    key = F.struct(F.col("key")).alias("key")
    hits = checkpointed(requests.where("at_ms IS NOT NULL").groupBy(key, "at_ms").agg(F.count(F.lit(1)).alias("hits")))
    marked = hits.join(window_starts(hits, length_ms).withColumn("_starts", F.lit(True)), ["key", "at_ms"], "left")
    placed = with_last_marked(marked, ["key"], ["at_ms"], {"_before": "at_ms"}, F.col("_starts").isNotNull(), {"_window": "at_ms"})
    window = F.when(F.col("_starts").isNotNull(), F.col("at_ms")).otherwise(F.col("_window"))
    earlier = Window.partitionBy("key", "_start").orderBy("at_ms").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn("_start", window).withColumn("_used", F.coalesce(F.sum("hits").over(earlier), F.lit(0)))
    allowed = F.least(F.col("hits"), F.greatest(F.lit(0), F.lit(limit) - F.col("_used")))
    return counted.select(F.col("key.key").alias("key"), "at_ms", "hits", allowed.alias("allowed"), (F.col("hits") - allowed).alias("refused"))
