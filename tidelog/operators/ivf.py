"""Approximate nearest neighbours over a partitioned index (inverted file).

Vectors are assigned to the nearest of a few centroids and written as a table
partitioned by cell; a query ranks the centroids and reads the nearest cells
alone, which Spark prunes by their folders.  Cells are widened until enough
neighbours are found or all are read, so the index never returns fewer than an
exact search would.  Rows of the log newer than the index are searched exactly,
and mask what the index holds for their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COSINE, INNER_PRODUCT, VECTOR
from . import knn
from .merge import latest


def train_centroids(vectors: DataFrame, cells: int, metric: str = COSINE, seed: int = 42, train_rows: int = 100_000, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids of a bounded sample, the train_rows least by a hash of the key."""
    sample = vectors.select("key", "embedding").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(train_rows).select("embedding").toPandas().embedding
    if not len(sample):
        return np.zeros((0, 0))
    x = np.stack([np.asarray(v, np.float64) for v in sample])
    if metric == COSINE:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = closest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def default_cells(vectors: int) -> int:
    """About the square root of the count of vectors: a probe then reads as many rows as there are centroids."""
    return max(1, min(4096, round(vectors**0.5)))


def default_probes(cells: int) -> int:
    """An eighth of the cells; data without clusters needs more for the same recall, which the caller can ask for."""
    return max(1, -(-cells // 8))


def ranked(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cells from nearest to farthest for each row."""
    return np.argsort(_away(x, centroids), axis=1, kind="stable")


def _away(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T


def closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest cell of each row, by slices of rows that keep distances few."""
    step = max(1, knn.TILE // len(centroids))
    return np.concatenate([_away(x[i : i + step], centroids).argmin(axis=1) for i in range(0, len(x), step)])


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = COSINE) -> DataFrame:
    """vectors with their cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, np.float64) for v in pdf.embedding])
                if metric == COSINE:
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pdf.assign(cell=closest(x, centroids).astype(np.int32))

    key_type = vectors.schema["key"].dataType.simpleString()
    return vectors.select("key", "seq", "embedding").mapInPandas(run, f"key {key_type}, seq long, embedding array<float>, cell int")


@dataclass
class IvfIndex:
    """A table partitioned by cell, its centroids, and the last sequence that it covers."""

    path: str
    centroids: np.ndarray
    metric: str
    indexed_seq: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, indexed_seq: int, metric: str = COSINE, cells: int = 0, seed: int = 42, train_rows: int = 100_000) -> IvfIndex:
        cells = cells or default_cells(vectors.count())
        centroids = train_centroids(vectors, cells, metric, seed, train_rows)
        if not len(centroids):
            assigned = vectors.select("key", "seq", "embedding", F.lit(0).alias("cell"))
        else:
            assigned = assign(vectors, centroids, metric)
        # a cell with many rows is dealt to several files
        assigned.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(8))).write.partitionBy("cell").parquet(path)
        return cls(path, centroids, metric, indexed_seq)

    def rows(self, spark, like: DataFrame) -> DataFrame:
        key_type = like.schema["key"].dataType.simpleString()
        return spark.read.schema(f"key {key_type}, seq long, embedding array<float>, cell int").parquet(self.path)

    def order(self, query) -> list[int]:
        q = np.asarray(query, np.float64)[None, :]
        if self.metric == COSINE:
            q = q / np.linalg.norm(q)
        if self.metric == INNER_PRODUCT:
            return np.argsort(-(q @ self.centroids.T)[0], kind="stable").tolist()
        return ranked(q, self.centroids)[0].tolist() if len(self.centroids) else [0]

    def search(self, log: DataFrame, query, k: int, probes: int = 0, predicate: Column | None = None) -> DataFrame:
        """(key, distance) of about the k nearest; log is the whole log, whose newer part is searched exactly."""
        spark = log.sparkSession
        newer = latest(log.where(F.col("seq") > self.indexed_seq))
        delta = newer.where(F.col("kind") == VECTOR).select("key", "embedding")
        cells = self.order(query)
        probes = min(len(cells), probes or default_probes(len(cells)))
        while True:
            base = self.rows(spark, log).where(F.col("cell").isin(cells[:probes])).join(newer.select("key"), "key", "left_anti").select("key", "embedding")
            found = knn.nearest(base.unionByName(delta), query, k, self.metric, predicate)
            if probes >= len(cells) or len(found.collect()) >= k:  # k rows at most
                return found
            probes = min(len(cells), probes * 2)


def probed(queries: DataFrame, centroids: np.ndarray, probes: int, metric: str) -> DataFrame:
    """(qid, query, cell): each query with the cells that it reads."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, knn.TILE // max(1, len(centroids)))
        for pdf in (whole.iloc[i : i + step] for whole in batches for i in range(0, len(whole), step)):
            if len(centroids):
                x = np.stack([np.asarray(v, np.float64) for v in pdf["query"]])
                if metric == COSINE:
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = (np.argsort(-(x @ centroids.T), axis=1, kind="stable") if metric == INNER_PRODUCT else ranked(x, centroids))[:, :probes]
                yield pdf.iloc[np.repeat(np.arange(len(pdf)), near.shape[1])].assign(cell=near.ravel().astype(np.int32))

    qid_type = queries.schema["qid"].dataType.simpleString()
    return queries.select("qid", "query").mapInPandas(probe, f"qid {qid_type}, query array<float>, cell int")


def ivf_join(index: IvfIndex, queries: DataFrame, k: int, probes: int, like: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, key, distance, rank) of many queries over a built index: blocks of each cell's vectors against blocks of the queries that read it, of the cells asked for alone; distances are rounded to digits before they are ranked."""
    spark = queries.sparkSession
    rows, asked = index.rows(spark, like), probed(queries, index.centroids, probes, index.metric)
    readers = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    held = rows.where(F.col("cell").isin(list(readers)))
    counts = {r.cell: (r.n, readers[r.cell]) for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = knn.blocked(held, asked, counts, index.centroids.shape[1] or 1, k, index.metric, digits)
    return knn.numbered(found, k)
