"""Newest-wins merge, tombstones and their collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DELETE, VECTOR

ENTRY = ("kind", "value", "embedding")


def latest(log: DataFrame, entry: tuple[str, ...] = ENTRY) -> DataFrame:
    """The newest entry of each key, tombstones kept.

    Aggregated before the shuffle, so a key with many versions costs no more than
    another; a filter on the key reaches the scan below.
    """
    won = log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*entry), "seq").alias("won"))
    return won.select("key", "seq", *[F.col(f"won.{c}").alias(c) for c in entry])


def live(log: DataFrame, entry: tuple[str, ...] = ENTRY) -> DataFrame:
    """The newest entries that are no tombstones.  A tombstone goes only after it has won."""
    return latest(log, entry).where(F.col("kind") != DELETE)


def live_vectors(log: DataFrame) -> DataFrame:
    """(key, embedding) of the keys whose newest entry is a vector; a newer plain put removes a vector."""
    return latest(log).where(F.col("kind") == VECTOR).select("key", "seq", "embedding")


def get(log: DataFrame, key: Column, entry: tuple[str, ...] = ENTRY) -> DataFrame:
    return live(log, entry).where(F.col("key") == key)


def multi_get(log: DataFrame, keys: DataFrame, entry: tuple[str, ...] = ENTRY) -> DataFrame:
    """A row for each key asked for; nulls where it is absent.  The log is cut to those keys before the merge."""
    asked = keys.select("key").distinct()
    return keys.join(live(log.join(asked, "key", "left_semi"), entry), "key", "left")


def merge_runs(runs: list[DataFrame], entry: tuple[str, ...] = ENTRY) -> DataFrame:
    """One row a key over several runs, each with its sequence in seq; ascending by key."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return latest(out, entry).orderBy("key")


def compacted(log: DataFrame, bottom: bool = True, entry: tuple[str, ...] = ENTRY) -> DataFrame:
    """What a compaction writes: winners alone, without tombstones where nothing older is left below."""
    return live(log, entry) if bottom else latest(log, entry)


def pending_size() -> Column:
    """Bytes of newest entries, as an aggregate: each key once, and payloads that are no tombstone's."""
    payload = F.coalesce(F.length("value"), 4 * F.size("embedding"), F.lit(0))
    return F.sum(F.length("key") + F.when(F.col("kind") == DELETE, 0).otherwise(payload))


def reads_of(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """For each read (key, seq), the entry that was newest before it: one pass over each key's history in order."""
    both = writes.select("key", "seq", "kind", "value", F.lit(False).alias("read")).unionByName(reads.select("key", "seq", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("read")))
    before = Window.partitionBy("key").orderBy("seq", "read").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.last(F.when(~F.col("read"), F.struct("kind", "value")), ignorenulls=True).over(before)
    out = both.withColumn("newest", newest).where("read")
    return out.select("key", "seq", F.when(F.col("newest.kind") != DELETE, F.col("newest.value")).alias("value"))
