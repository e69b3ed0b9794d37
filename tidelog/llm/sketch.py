"""Document fingerprints: bottom-k sketches of shingle hashes (DataFrame operations only).

A document's fingerprint is the ``K`` smallest of the distinct 64-bit hashes of
its shingles of five words (a shorter text is one shingle; no words, none), in
ascending order, as 16 hexadecimal digits each.  Sketches are mergeable: the
sketch of a union is the K smallest of both sketches' values.  A sketch with
fewer than K values holds the whole set, and every estimate on it is exact.

Edge cases: null text is the empty text, with an empty fingerprint; two empty
fingerprints are alike (1.0), an empty and another are not (0.0).  Repeated rows
are documents of their own; ties in doc_id are put in order of the text's hash, and
null ids come last, after all others.  An empty table gives an empty result; very
long texts are sketched whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words_of

K = 256
SHINGLE = 5
#: Largest count of doc_id ranges, so of rows in the table of range edges; rows of a range until then; edges of a page of the search.
MOST_RANGES = 16384
ROWS_A_RANGE = 2000
PAGE = 128


def sketch(words: Column, k: int = K, n: int = SHINGLE) -> Column:
    """Bottom-k sketch of an array of words, as a sorted array of hashes."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    hashes = F.when(F.size(words) >= n, each).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimate of the distinct shingles behind a sketch; exact below k."""
    span = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / span)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A or B|: of the k smallest of the union, the part in both."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A|."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def digits(s: Column) -> Column:
    """Sketch to its fingerprint string."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def undigits(s: Column) -> Column:
    """Fingerprint string to its sketch."""
    cell = lambda i: F.substring(s, i * 16 + 1, F.lit(16))
    value = lambda c: F.conv(c, 16, -10).cast("bigint")
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(0), (F.length(s) / 16).cast("int") - 1), lambda i: value(cell(i)))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text) to doc_id, sketch, fingerprint, n_shingles: one narrow stage."""
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))  # a column of its own: the sketch's lambda refers to it at every place
    out = words.select("doc_id", sketch(F.col("words"), k).alias("sketch"))
    return out.select("doc_id", "sketch", digits(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


def ranges_of(rows: DataFrame, n: int) -> Column:
    """Number of the range of each row in ascending order of (doc_id, text_hash): about n ranges of as many rows each.

    The edges are quantiles of doc_id, so clustered ids and single far ones make no
    range larger; an id that fills several ranges is dealt over them by the hash.
    """
    edges = rows.agg(F.approx_percentile("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else []
    if not edges:
        return F.lit(0)
    # a search in two steps: every PAGE-th edge, then the page that follows
    pages = F.lit([edges[i] for i in range(0, len(edges), PAGE)])
    every = F.lit(list(edges))

    def below(less) -> Column:
        page = F.size(F.filter(pages, less))
        first = F.greatest(F.lit(0), page - 1) * PAGE
        return first + F.size(F.filter(F.slice(every, first + 1, F.lit(PAGE)), less))

    # equal edges may go on over more pages
    low, high = below(lambda e: e < F.col("doc_id")), below(lambda e: e <= F.col("doc_id"))
    share = (F.col("text_hash").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return (low + F.least(F.floor(share * (high - low + 1)), high - low)).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text: the text of the next document in descending doc_id; the first's after the last.

    Rows are dealt by ranges of equal counts, so texts move once and no task holds
    more than a range.  Each range also gets a copy of the row that follows it.
    """
    none = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), F.col("doc_id").alias("own_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    n = rows.count()
    rows = rows.withColumn("range_no", ranges_of(rows, max(1, min(MOST_RANGES, -(-n // ROWS_A_RANGE)))))
    # the first row of each range in descending order: as many as ranges, so a bounded table
    edges = rows.groupBy("range_no").agg(F.max(F.struct(F.col("doc_id").alias("e_id"), F.col("text_hash").alias("e_hash"))).alias("e")).select(F.col("range_no").alias("e_range"), "e.*")
    down = Window.orderBy(F.col("e_range").desc())
    edges = edges.withColumn("for_range", F.coalesce(F.lag("e_range").over(down), F.min("e_range").over(Window.partitionBy())))
    edge_rows = rows.join(F.broadcast(edges), (F.col("range_no") == F.col("e_range")) & (F.col("doc_id") == F.col("e_id")) & (F.col("text_hash") == F.col("e_hash"))).dropDuplicates(["range_no"])
    edge_rows = edge_rows.select("doc_id", "own_id", "text", "text_hash", F.col("for_range").alias("range_no"), F.lit(1).alias("edge"))
    all_rows = rows.withColumn("edge", F.lit(0)).unionByName(edge_rows)
    order = Window.partitionBy("range_no").orderBy("edge", F.col("doc_id").desc(), F.col("text_hash").desc(), F.col("text").desc())
    return all_rows.withColumn("next_text", F.lead("text").over(order)).where("edge = 0").select(F.col("own_id").alias("doc_id"), "text", "next_text")


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likeness to the edited and to the next text."""
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.length("text").cast("long"))
    moved = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[words_of(F.col(c)).alias(c) for c in ("text", "edited", "next_text")])
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *[sketch(F.col(c)).alias(c) for c in ("text", "edited", "next_text")])
    return rows.select("doc_id", "n_chars", "edited_sha256", digits(F.col("text")).alias("fingerprint"), digits(F.col("edited")).alias("edited_fingerprint"), resemblance(F.col("text"), F.col("edited")).alias("near_edited"), resemblance(F.col("text"), F.col("next_text")).alias("near_next"))
