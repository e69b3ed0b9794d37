"""Embedding near-dedup: an exact metric range join over pivot cells.

Vectors are scaled to unit length, where cosine >= c is Euclidean distance <= eps,
eps = sqrt(2 - 2c).  Each distinct vector is native to the cell of its nearest
pivot.  A vector within eps of a native of another cell is, by the triangle
inequality, within eps of the hyperplane between both pivots; so each vector is
copied to the cells of smaller number whose hyperplane is that near, and every pair
meets in exactly one cell, that of its end with the smaller one.  Cells join
independently, in blocks of about ``BLOCK`` by ``BLOCK`` vectors as each cell's own
counts need, so a cell with a third of all vectors is many tasks.

How many pivots pay depends on the data: a sample tells, for numbers of pivots up to
the square root of the count of vectors, how many pairs would be compared and how
many copies sent, and the cheapest number is taken.  In data without clusters
pivots cannot tell 64 dimensions apart; one cell is cheapest then, and the join is
a comparison of all vectors in blocks, which no exact method avoids.

Equal vectors are one before the join and counted by their number.  A block keeps
counts and one label a vector, never its pairs.  Products are taken in single
precision; those near the bound are taken again in double precision.

Edge cases: null vectors, zero vectors and vectors with null or non-finite
components link with nothing.  Vectors of different lengths do not link; each
length has cells of its own, those beyond the ``LENGTHS`` most frequent lengths one
cell each.  Rows that repeat a vec_id are one vector if their embeddings are equal.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .components import components

COSINE = 0.95
BLOCK = 8192
#: Vectors of a length from which pivots are drawn, and lengths that have pivots.
SAMPLE, LENGTHS = 4096, 16
#: What a compared pair, a copy sent and a distance to a pivot cost, in about nanoseconds.
PAIR, COPY, PIVOT = 8.0, 4000.0, 20.0
#: Rounding of single precision products of unit vectors, with room.
SLACK = 1e-4


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)  # neither squares nor their sum leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample, each the farthest from those before it."""
    chosen = [0]
    far = 2 - 2 * sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * sample @ sample[chosen[-1]])
    return sample[chosen]


def cells_of(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and whether it is copied to each cell."""
    squares = np.maximum(0, 2 - 2 * x @ pivots.T)
    home = squares.argmin(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (squares - squares[np.arange(len(x)), home][:, None]) / (2 * apart[home])
    near = np.nan_to_num(plane, nan=0.0, posinf=0.0) <= eps
    return home, near & (np.arange(len(pivots))[None, :] < home[:, None])


def choose_pivots(sample: np.ndarray, n: int, eps: float) -> np.ndarray:
    """The pivots with which a join of n vectors like the sample costs least."""
    most = int(min(len(sample) / 4, n**0.5))
    order = farthest_first(sample, max(1, most))
    best, least, count = order[:1], float("inf"), 1
    while count <= max(1, len(order)):
        home, away = cells_of(sample, order[:count], eps)
        own, other = np.bincount(home, minlength=count) / len(sample) * n, away.mean(0) * n
        blocks, others = np.ceil(own / BLOCK), np.ceil(other / BLOCK)
        cost = PAIR * (own * own / 2 + own * other).sum() + COPY * (own * (blocks + others) + other * blocks).sum() + PIVOT * n * count
        if cost < least:
            best, least = order[:count], cost
        count *= 2
    return best


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit vectors of two blocks link, in double precision where single precision cannot tell."""
    close = x.astype(np.float32) @ y.astype(np.float32).T
    hit = close >= cosine + SLACK
    i, j = np.nonzero(~hit & (close >= cosine - SLACK))
    for a in range(0, len(i), 1 << 16):
        p, q = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
        hit[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
    return hit


def block_links(a: pd.DataFrame, b: pd.DataFrame | None, cosine: float) -> pd.DataFrame:
    """Links of the vectors of two blocks with each other (of one with itself, b None), and the least number that each reaches."""
    x = unit(a.vector)
    y = x if b is None else unit(b.vector)
    ra, na = a.rep.to_numpy(), a.copies.to_numpy()
    rb, nb = (ra, na) if b is None else (b.rep.to_numpy(), b.copies.to_numpy())
    links_a, links_b = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(ra), 512):
        hit = linked(x[s : s + 512], y, cosine)
        if b is None:
            hit[np.arange(len(hit)), s + np.arange(len(hit))] = False
        some, there = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if len(some):
            hit = hit[np.ix_(some, there)]
            links_a[s + some] = hit @ nb[there]
            links_b[there] += na[s + some] @ hit
            parts.append((s + some, there, np.packbits(hit, axis=1)))
    la, lb = ra.copy(), rb.copy()
    if b is None:
        lb = la
    changed = bool(parts)
    while changed:
        changed = False
        for rows, there, bits in parts:
            hit = np.unpackbits(bits, axis=1, count=len(there)).astype(bool)
            low = np.minimum(la[rows], np.where(hit, lb[there][None, :], np.iinfo(np.int64).max).min(1))
            high = np.minimum(lb[there], np.where(hit, low[:, None], np.iinfo(np.int64).max).min(0))
            if (low != la[rows]).any() or (high != lb[there]).any():
                la[rows] = low
                lb[there] = np.minimum(lb[there], high)
                changed = True
    out = pd.DataFrame({"rep": ra, "links": links_a, "label": la})
    if b is not None:
        out = pd.concat([out, pd.DataFrame({"rep": rb, "links": links_b, "label": lb})])
    return out[(out.links > 0) | (out.rep != out.label)]


def joined(classes: DataFrame, cosine: float) -> DataFrame:
    """(vector, rep, copies, dim) of distinct vectors to rep, links, label of those with links."""
    sizes = classes.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(LENGTHS).collect()
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    pivots: dict[int, np.ndarray] = {}
    for r in sizes:
        if r["count"] > BLOCK:  # else one cell of one block
            some = classes.where(F.col("dim") == r.dim).select("vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).collect()
            pivots[r.dim] = choose_pivots(unit([v.vector for v in some]), r["count"], eps)
    held = classes.sparkSession.sparkContext.broadcast(pivots)
    element = classes.schema["vector"].dataType.simpleString()

    def house(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                if dim not in held.value or len(held.value[dim]) == 1:
                    yield own.assign(home=np.int32(0), away=[[]] * len(own))
                    continue
                home, near = cells_of(unit(own.vector), held.value[dim], eps)
                yield own.assign(home=home.astype(np.int32), away=[np.flatnonzero(x).tolist() for x in near])

    housed = cut(classes.mapInPandas(house, f"vector {element}, rep long, copies long, dim int, home int, away array<int>"), "cells")
    blocks = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / BLOCK).cast("int")
    own = housed.groupBy("dim", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("own"))
    away = housed.select("dim", F.explode("away").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("other"))
    # a row for each pivot (and rare length); cells without natives have nothing to join
    cells = cut(own.join(away, ["dim", "cell"], "left").select("dim", "cell", blocks("own").alias("own"), blocks("other").alias("other")), "blocks")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    task = lambda kind, p, q, first: F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"), first.alias("first"))
    i, f = F.col("i"), F.col("f")
    natives = housed.withColumn("cell", F.col("home")).join(cells, ["dim", "cell"]).withColumn("i", at("own"))
    selves = F.transform(upto("own"), lambda j: task(0, F.least(i, j), F.greatest(i, j), i <= j))
    others = F.transform(upto("other"), lambda j: task(1, i, j, F.lit(True)))
    copies = housed.withColumn("cell", F.explode("away")).join(cells, ["dim", "cell"]).withColumn("f", at("other"))
    against = F.transform(upto("own"), lambda j: task(1, j, f, F.lit(False)))
    keep = ["dim", "cell", "rep", "copies", "vector"]
    dealt = natives.select(*keep, F.explode(F.concat(selves, others)).alias("t")).union(copies.select(*keep, F.explode(against).alias("t"))).select(*keep, "t.*")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["first"]], pdf[~pdf["first"]]
        if not len(a) or pdf.kind.iloc[0] == 1 and not len(b):
            return pd.DataFrame({"rep": [], "links": [], "label": []})
        if pdf.kind.iloc[0] == 0 and pdf.p.iloc[0] == pdf.q.iloc[0]:
            return block_links(a, None, cosine)
        return block_links(a, b, cosine) if len(b) else pd.DataFrame({"rep": [], "links": [], "label": []})

    return cut(dealt.groupBy("dim", "cell", "kind", "p", "q").applyInPandas(join, "rep long, links long, label long"), "links")


def near_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding) to vec_id, n_links, component_id for every row."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    small_batches(vectors)
    rows = vectors.select("vec_id", F.when(usable, x).alias("vector"), usable.alias("usable"))
    classes = rows.where("usable").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first(F.size("vector")).alias("dim"))
    classes = cut(classes, "classes")
    found = joined(classes, cosine)
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    known = classes.join(counted, "rep", "left").join(edges, F.col("rep") == F.col("vertex"), "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, "vector", "left")
    own = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("links")).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"))


def op1_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    got = near_links(table(spark, sf_dir, "embeddings"))
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
