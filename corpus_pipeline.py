"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import minhash, mixing, packing, suffixes, toxicity
from tidelog.llm.common import SPACE, cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE = 5
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labels, scores under TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where(F.col("toxicity") < TOXIC).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates.

    A row is known by its id and text: rows that share an id and differ in text are
    documents of their own, rows equal in both are one.  A null id is an id as
    others, after all of them, so such rows go only for an equal or similar text.
    """
    by = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").isNull(), "text")
    rows = docs.select(COLUMNS).withColumn("row_key", by)
    classes = minhash.near_classes(rows.select(F.col("row_key").alias("doc_id"), "text"), SHINGLE).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = rows.select("row_key", "doc_id").distinct().join(classes, "row_key")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("one"))
    return rows.join(first.select("one.row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages of over 50 words (or of 400 bytes); texts of which nothing is left go.

    A character that a repeated range cuts through goes with it.
    """
    found = suffixes.passages(docs.select(COLUMNS))
    at = COLUMNS.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, in_words, in_bytes in zip(*(batch.column(i) for i in (at, len(COLUMNS), len(COLUMNS) + 1))):
                data = text.as_py().encode()
                texts.append(suffixes.without(data, suffixes.spans_of(data, in_words.as_py(), in_bytes.as_py())).decode("utf-8", "ignore"))
            kept = [*batch.columns[: len(COLUMNS)]]
            kept[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, names=COLUMNS)

    clean = F.col("in_words").isNull() & F.col("in_bytes").isNull()
    changed = found.where(~clean).mapInArrow(run, docs.select(COLUMNS).schema).where(F.length(F.trim("text")) > 0)
    changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)
    return found.where(clean).select(COLUMNS).unionByName(changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in serving order, once for each epoch that serves them; the one that the cut splits ends at it.

    The stage's files, by name, are in that order; a reader that needs it reads them so.
    """
    mixed = mixing.schedule(mixing.mix(docs, COLUMNS))
    # the words after the cut are the last part of a split with one part for each word before it
    lead = F.when(F.col("text").rlike("^" + SPACE), 1).otherwise(0)
    parts = F.split("text", SPACE, (F.col("taken") + 1 + lead).cast("int"))
    before = F.length("text") - F.length(F.element_at(parts, -1))
    text = F.when(F.col("taken") < F.col("size"), F.rtrim(F.substring(F.col("text"), F.lit(1), before))).otherwise(F.col("text"))
    return mixed.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of power-of-two length."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned scores, hash order and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
