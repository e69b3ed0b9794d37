"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Each source is a queue of its documents in a fixed shuffled order, read up to
``epochs`` times.  A document's virtual finish time is the source's cumulative
words up to its end divided by the source's target, so all queues are served in
proportion to their targets.  The queues are merged by a global range sort on
that time and cut where the words served reach the budget.  As the targets sum
to the budget, every queue has had exactly its target at virtual time 1: that is
the cut.  A document over the cut is split there, its part after the cut unread.

Scale: a source's prefix sums go over (source, bucket of the shuffle hash), so a
source with a third of all rows is split over 4096 windows; only the
per-source table (one row a source) is ordered in a single task.

Edge cases: null text has no words; a null source is a source of its own, last
in order; repeated rows are documents of their own; zero-word documents take
nothing; an empty table gives an empty result; very long texts are counted whole, and
no other column's name clashes with those made here but for the ones in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
EPOCHS = 2


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to those and target: shares of budget x all sizes by weight, none above epochs x its size.

    Water filling in closed form: sources in order of the level at which their cap
    binds; the level is the first that no later cap undercuts.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * epochs)
    t = t.withColumn("binds_at", F.col("cap").cast("double") / F.col("weight"))
    rise = Window.orderBy("binds_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    t = t.withColumn("cap_before", F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    t = t.withColumn("weight_left", F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("all_size", F.sum("source_size").over(every))
    t = t.withColumn("level", (F.col("all_size") * F.lit(float(budget)) - F.col("cap_before")) / F.col("weight_left"))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("binds_at"), F.col("level"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce("level", F.col("cap").cast("double")) * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, keep: list[str], size: Column | None = None, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """The documents with their places in the mix: a row for each document and epoch.

    Columns: those of ``keep`` (``doc_id`` and ``source`` among them), size,
    source_size, target, epoch, taken (words served by the cut), finish (virtual
    finish time) and row_key (the document's place in its queue's shuffle).
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*keep, (word_count(F.col("text")) if size is None else size).alias("size"), F.xxhash64("text").alias("mix_text"), key.alias("mix_key"))
    # the source as a key without nulls: joins on it are plain, so they share the windows' shuffle
    rows = rows.withColumn("mix_bucket", F.substring("mix_key", 1, 3)).withColumn("mix_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    in_bucket = rows.groupBy("mix_source", "mix_bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    of = Window.partitionBy("mix_source")
    before = of.orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    in_bucket = in_bucket.withColumn("bucket_start", F.sum("bucket_size").over(before) - F.col("bucket_size"))
    sizes = in_bucket.groupBy("mix_source").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    there = targets(sizes, weights, budget, epochs).withColumn("mix_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    in_bucket = in_bucket.drop("source").join(there, "mix_source").select("mix_source", "mix_bucket", "bucket_start", "source_size", "target")
    shuffled = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "doc_id", "mix_text")
    upto = shuffled.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("mix_end", F.sum("size").over(upto)).withColumn("mix_no", F.row_number().over(shuffled))
    rows = rows.join(in_bucket, ["mix_source", "mix_bucket"])
    rows = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    end = F.col("bucket_start") + F.col("mix_end") + F.col("epoch") * F.col("source_size")
    rows = rows.withColumn("mix_finish", end)
    served = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.floor("target") - (F.col("mix_finish") - F.col("size"))))
    finish = F.when(F.col("target") > 0, F.col("mix_finish") / F.col("target"))
    row_key = F.struct("mix_source", "mix_bucket", "mix_no")
    return rows.select(*keep, "size", "source_size", "target", "epoch", served.alias("taken"), finish.alias("finish"), row_key.alias("row_key"))


def serving_order() -> list[Column]:
    return [F.col("finish"), F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("epoch"), F.col("row_key")]


def serve(mixed: DataFrame) -> DataFrame:
    """The merged queue cut at the total budget: mixed in ranges of virtual finish time (slot), with served, the words before a row, and taken cut to what the budget leaves.

    Each source has its target by virtual time 1, so rounding apart the cut is there.
    The running sum goes over the ranges' sums first, then within each range.
    """
    queue = cut(mixed.repartitionByRange(*serving_order()).withColumn("slot", F.spark_partition_id()), "queue")
    slots = queue.groupBy("slot").agg(F.sum("taken").alias("words"))  # a row a range
    before = slots.withColumn("before", F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).drop("words")
    sources = queue.groupBy("source").agg(F.first("target").alias("target"))
    budget = sources.agg(F.sum(F.floor("target"))).first()[0] or 0
    within = Window.partitionBy("slot").orderBy(*serving_order()).rowsBetween(Window.unboundedPreceding, 0)
    rows = queue.join(F.broadcast(before), "slot").withColumn("served", F.col("before") + F.sum("taken").over(within) - F.col("taken"))
    left = F.greatest(F.lit(0).cast("long"), F.lit(budget).cast("long") - F.col("served"))
    return rows.withColumn("taken", F.least(F.col("taken"), left)).drop("before")


def schedule(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows that the mix takes words of in serving order: range-sorted by virtual finish time."""
    served = mixed.where(F.col("taken") > 0)
    dealt = served.repartitionByRange(partitions, *serving_order()) if partitions else served.repartitionByRange(*serving_order())
    return dealt.sortWithinPartitions(*serving_order())


def op9_wfq_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, from the merged queue cut at the budget."""
    mixed = serve(mix(table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    mixed = mixed.groupBy("row_key").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS binds_at FROM w
), l AS (
  SELECT *, (CAST((sum(source_size) OVER ()) AS DOUBLE) * 1.5
    - CAST(sum(cap) OVER (ORDER BY binds_at, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY binds_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r
), m AS (SELECT max(level) AS level FROM l WHERE level <= binds_at),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), m.level * weight) AS target FROM r, m),
q AS (
  SELECT doc_id, d.source, size, source_size, target,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(least(size, greatest(0, CAST(floor(target) AS BIGINT) - start)) + least(size, greatest(0, CAST(floor(target) AS BIGINT) - start - source_size)) AS BIGINT) AS taken
FROM q
"""
