"""Exact nearest neighbours: one query, filtered, and many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance, prepare, prepared_distance, prepared_literal, vector_literal
from ..schema import COSINE, EUCLIDEAN_SQUARED, InvalidArgument

#: Bytes of query vectors that are sent to every task at once; bytes of a block of queries and of vectors, as doubles; distances of a tile; queries that are expressions.
QUERY_BYTES, BLOCK_BYTES, TILE, FEW = 250_000, 16_000_000, 2_000_000, 100
#: Pairs of vectors that are worth a task of their own, and as many tasks as these are made for; more where blocks would be too large.
TASK_PAIRS, TASKS = 20_000_000, 64


def nearest(vectors: DataFrame, query, k: int, metric: str = COSINE, predicate: Column | None = None, kind: str = "float") -> DataFrame:
    """(key, distance) of the k nearest to the query, a sequence of numbers, of the vectors that pass the predicate, ties by key; all of them where fewer pass."""
    rows = vectors if predicate is None else vectors.where(predicate)
    away = prepared_distance(prepare(F.col("embedding"), metric, kind), prepared_literal(query, metric, kind), metric, kind)
    return rows.select("key", away.alias("distance")).orderBy("distance", "key").limit(k)


def predicate_of(fn: Callable[[bytes], bool]) -> Column:
    """A Python test of keys as a predicate, evaluated in Arrow batches; give a Column where one can say it."""

    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bool(fn(bytes(k) if not isinstance(k, str) else k)))

    return passes(F.col("key"))


def _matrix(rows, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, and which of them have distances: of the others (zero, not finite) none is found."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    with np.errstate(all="ignore"):
        if metric == COSINE:
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        good = np.isfinite(x).all(axis=1)
    return (x if good.all() else x[good]), np.flatnonzero(good)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    d = q @ x.T
    if metric == EUCLIDEAN_SQUARED:
        d *= -2
        d += (q * q).sum(1)[:, None]
        d += (x * x).sum(1)[None, :]
        return d
    np.negative(d, out=d)
    if metric == COSINE:
        d += 1
    return d


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k least (d, j) of each i, and their ranks from 0."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    kept = rank < k
    return i[kept], j[kept], d[kept], rank[kept]


def _least(q: np.ndarray, x: np.ndarray, k: int, metric: str, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the k best rows of x for each row of q, and their places, -1 where there are fewer; the earlier of equal ones.

    Tiles of TILE distances are compared with the k-th best so far; only what is
    below it is rounded and sorted.
    """
    best, place = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    slack = 0 if digits is None else 10.0**-digits
    wide = min(4096, max(1, len(x)))
    tall = max(1, TILE // wide)
    for a in range(0, len(q), tall):
        rows = q[a : a + tall]
        top, at = best[a : a + tall], place[a : a + tall]  # views
        for b in range(0, len(x), wide):
            d = _distances(rows, x[b : b + wide], metric)
            bound = top[:, -1]
            if not b and k < d.shape[1]:
                bound = np.partition(d, k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero(d <= (bound + slack)[:, None])
            near = d[i, j] if digits is None else np.round(d[i, j], digits) + 0.0
            del d
            better = near < top[i, -1]  # what ties with the k-th comes later, and is left
            if not better.any():
                continue
            i, j, near = i[better], j[better] + b, near[better]
            some, nth = np.nonzero(np.isin(np.arange(len(rows)), i)[:, None] & (at >= 0))
            i, j, near, rank = _first(np.r_[some, i], np.r_[at[some, nth], j], np.r_[top[some, nth], near], k)
            top[i, rank], at[i, rank] = near, j
    return best, place


def _best(ids, asked: tuple[np.ndarray, np.ndarray], batches: Iterator[tuple], k: int, metric: str, digits: int | None) -> pd.DataFrame:
    """The k best of all batches (keys, vectors) for each query, ties by key."""
    q, which = asked
    top: pd.DataFrame | None = None
    for keys, vectors in batches:
        if not len(keys) or not len(q):
            continue
        x, good = _matrix(vectors, metric)
        keys = np.asarray(keys, dtype=object)[good]
        order = np.argsort(keys, kind="stable")
        best, place = _least(q, x[order], k, metric, digits)
        i, nth = np.nonzero(place >= 0)
        some = pd.DataFrame({"q": i, "key": pd.Series(keys[order][place[i, nth]], dtype=object), "distance": best[i, nth]})
        top = some if top is None else pd.concat([top, some]).sort_values(["q", "distance", "key"]).groupby("q").head(k)
    if top is None:
        return pd.DataFrame()
    whole = lambda values: pd.Series(values, dtype=object)
    return pd.DataFrame({"qid": whole(np.asarray(ids, dtype=object)[which[top.q.to_numpy()]]), "key": whole(top.key.to_numpy(object)), "distance": top.distance.to_numpy()})


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = COSINE, digits: int | None = None) -> DataFrame:
    """(qid, key, distance, rank): the k nearest of every query, ties by key; distances are rounded to digits before they are ranked.

    Each task keeps the k best of its own rows for each query of a block, by
    matrix products in tiles; a window over those few merges the tasks.  Queries of
    QUERY_BYTES in all, counted first, go to every task.  More are dealt into
    blocks by a hash, and so are the vectors; each pair of blocks is a task.
    """
    if k <= 0:
        raise InvalidArgument("k must be positive")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query")).alias("d")).first()
    if size.n * (size.d or 1) * 8 <= QUERY_BYTES:
        rows = queries.select("qid", "query").collect()
        ids, asked = [r.qid for r in rows], _matrix([r.query for r in rows] or np.zeros((1, 1)), metric)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = _best(ids, asked, ((pdf.key, pdf.embedding) for pdf in batches), k, metric, digits)
            if len(found):
                yield found

        found = vectors.select("key", "embedding").where(F.lit(bool(rows))).mapInPandas(scan, _found(vectors, queries))
    else:
        one = F.lit(0).alias("cell")
        found = blocked(vectors.select("key", "embedding", one), queries.select("qid", "query", one), {0: (vectors.count(), size.n)}, size.d, k, metric, digits)
    return numbered(found, k)


def _found(vectors: DataFrame, queries: DataFrame) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, key {vectors.schema['key'].dataType.simpleString()}, distance double"


def numbered(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def blocked(vectors: DataFrame, queries: DataFrame, counts: dict[int, tuple[int, int]], dim: int, k: int, metric: str, digits: int | None = None) -> DataFrame:
    """(qid, key, distance): the k best of each block of vectors for each query of the same cell, by pairs of blocks.

    counts has each cell's vectors and queries.  A cell has as many blocks of both
    as keep a block in BLOCK_BYTES, and more blocks of queries where there is work
    for more tasks.
    """
    block = max(1, BLOCK_BYTES // (8 * dim))
    share = max(TASK_PAIRS, sum(n * m for n, m in counts.values()) // TASKS)
    shape, first = [], 0  # of each cell: blocks of vectors, of queries, and the number of its first pair
    for c in range(max(counts, default=0) + 1):
        n, m = counts.get(c, (0, 0))
        b = max(1, -(-n // block))
        a = max(1, -(-m // block), min(m, -(-n * m // (b * share))))
        shape.append((b, a, first))
        first += a * b
    b, a, start = (F.get(F.array(*[F.lit(s[i]) for s in shape]), F.col("cell")) for i in range(3))
    own = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    left = queries.select("qid", "query", start.alias("s"), b.alias("b"), own("qid", a).alias("i"), every(b).alias("j")).select("qid", "query", F.expr("s + i * b + j").alias("pair"))
    right = vectors.select("key", "embedding", start.alias("s"), b.alias("b"), own("key", b).alias("j"), every(a).alias("i")).select("key", "embedding", F.expr("s + i * b + j").alias("pair"))

    def join(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame()
        return _best(q.qid, _matrix(q["query"], metric), iter([(v.key, v.embedding)]), k, metric, digits)

    # a number of partitions is given, as small tables that need much work would be merged into few
    tasks = min(2048, 2 * first)
    dealt = lambda rows: rows.repartition(tasks, "pair").groupBy("pair")
    return dealt(left).cogroup(dealt(right)).applyInPandas(join, _found(vectors, queries))


def knn_join_columns(vectors: DataFrame, queries: DataFrame, k: int, metric: str = COSINE, digits: int | None = None, kind: str = "double") -> DataFrame:
    """The same for a handful of queries (FEW at most), as expressions alone: queries are exploded beside each vector in the scan."""
    rows = queries.select("qid", "query").limit(FEW + 1).collect()
    if len(rows) > FEW:
        raise InvalidArgument(f"more than {FEW} queries; use knn_join")
    asked = F.array(*[F.struct(F.lit(r.qid).alias("qid"), vector_literal(r.query).alias("query")) for r in rows])
    away = distance(F.col("embedding"), F.col("q.query"), metric, kind)
    away = away if digits is None else F.round(away, digits) + 0.0
    return numbered(vectors.select("key", "embedding", F.explode(asked).alias("q")).select("key", "q.qid", away.alias("distance")), k)


def recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean share of the exact k nearest that were found; one row."""
    hits = exact.select("qid", "key").join(approximate.select("qid", "key").withColumn("hit", F.lit(1)), ["qid", "key"], "left")
    by = hits.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("r"))
    return by.agg(F.avg("r").alias("recall"))
