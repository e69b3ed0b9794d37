"""MinHash near-dedup with b-bit signatures.

A document is the set of its ``SHINGLE``-word shingles over lower-cased ASCII
words; a shorter text is one shingle, a text without words the empty set, which
links with nothing.  ``HASHES`` minima are taken; ``BANDS`` bands of whole minima
generate candidates, and the low ``BITS`` bits of each minimum, packed, estimate
their similarity: the share E of equal cells is J + (1 - J) / 2^b in expectation,
so J = (E - 2^-b) / (1 - 2^-b).  Candidates whose estimate is over ``MARGIN``
standard deviations below the bound are dropped; the rest are confirmed on the
full sets, taken again from the texts.

Equal sets are one class before anything else.  Classes that share a band meet in
its bucket, which is not expanded into pairs: each meets the bucket's first.
Rounds then confirm only pairs whose ends are not yet connected, as a link within
a component changes nothing; last, members of a bucket that ended in different
components meet each other, as far as their signatures allow: as pairs in buckets
of at most ``SMALL``, in larger ones as blocks that return no more than a link for
two components.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8.

Edge cases: null text is the empty text; repeated rows, as all copies, are one
class; rows that repeat a doc_id are one document.  An empty table gives an empty
result; very long texts are hashed in parts of ``PART`` shingles and compared whole;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .components import components

HASHES, BANDS, BITS = 128, 32, 2
PERCENT = 80
MARGIN = 6.0
CACHED_WORDS = 100_000
#: Members of a bucket whose pairs are listed, and of a block of a larger one.
SMALL, BLOCK = 32, 2048
#: Shingles of all members of a block, about.
BLOCK_SHINGLES = 2_000_000
#: Distinct shingles hashed at once; a longer document is taken in parts.
PART = 1 << 16

_ODD = np.random.default_rng(20240229).integers(0, 2**63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def shingles(self, text: str | None, n: int) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self) > CACHED_WORDS:
            self.clear()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = min(n, len(words))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = mix(out + h[i : len(h) - size + 1 + i])
        return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of hashes."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), PART // 16):
        part = s[None, a : a + PART // 16] * _ODD[0][:, None] + _ODD[1][:, None]
        part ^= part >> np.uint64(32)
        part *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, part.min(1))
    return low


def signer(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        cells = 64 // BITS
        shifts = (np.arange(cells, dtype=np.uint64) * np.uint64(BITS))[None, :]
        for pdf in batches:
            n, key1, key2, sig, bands = [], [], [], [], []
            for text in pdf.pop("text"):
                s = words.shingles(text, shingle)
                n.append(len(s))
                key1.append(int(mix(s + np.uint64(0x9E37)).sum(dtype=np.uint64).astype(np.int64)))
                key2.append(int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).astype(np.int64)))
                if not len(s):
                    sig.append(None), bands.append(None)
                    continue
                low = signature(s)
                packed = ((low >> np.uint64(32)) & np.uint64((1 << BITS) - 1)).reshape(-1, cells) << shifts
                sig.append(np.bitwise_or.reduce(packed, axis=1).astype(np.int64))
                rows = low.reshape(BANDS, -1)
                h = np.arange(1, BANDS + 1, dtype=np.uint64)
                for c in range(rows.shape[1]):
                    h = mix(h + rows[:, c])
                bands.append(h.astype(np.int64))
            yield pdf.assign(n=n, key1=key1, key2=key2, sig=sig, bands=bands)

    return run


def sign(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text) to doc_id, n (set size), key1 and key2 (fingerprint of the whole set), sig (packed bits), bands."""
    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(signer(shingle), "doc_id long, n long, key1 long, key2 long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement of b-bit cells."""
    same = F.lit(0)
    low = sum(1 << (i * BITS) for i in range(64 // BITS))
    low = low - 2**64 if low >= 2**63 else low
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        differs = x
        for s in range(1, BITS):
            differs = differs.bitwiseOR(F.shiftrightunsigned(x, s))
        same = same + F.lit(64 // BITS) - F.bit_count(differs.bitwiseAND(F.lit(low)))
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def lowest(percent: int) -> float:
    """Least estimate of a pair at the bound, MARGIN standard deviations below it."""
    chance = 2.0**-BITS
    j = percent / 100
    e = j + (1 - j) * chance
    return j - MARGIN * (e * (1 - e) / HASHES) ** 0.5 / (1 - chance)


def confirmer(shingle: int, percent: int):
    def words_of(text: str | None) -> set:
        words = (text or "").encode().lower().split()
        if len(words) < shingle:
            return {tuple(words)} if words else set()
        return set(zip(*(words[i:] for i in range(shingle))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first = None, set()
        for pdf in batches:
            keep = []
            for a, text_a, text_b in zip(pdf.a, pdf.text_a, pdf.text_b):
                if a != last:
                    last, first = a, words_of(text_a)
                b = words_of(text_b)
                both = len(first & b)
                keep.append(both > 0 and 100 * both >= percent * (len(first) + len(b) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of all pairs of two blocks of packed signatures."""
    same = np.zeros((len(a), len(b)), np.int32)
    low = np.uint64(sum(1 << (i * BITS) for i in range(64 // BITS)))
    for i in range(a.shape[1]):
        x = a[:, None, i] ^ b[None, :, i]
        differs = x.copy()
        for s in range(1, BITS):
            differs |= x >> np.uint64(s)
        same += 64 // BITS - np.bitwise_count(differs & low)
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def block_pairs(pdf: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame, pd.DataFrame]]:
    """Places of the pairs of a block that may link: in different components, similar by signature, and with no earlier band in common."""
    a, b = pdf[pdf.left], pdf[~pdf.left]
    if not len(a) or not len(b):
        return
    sig_a, sig_b = (np.stack(x.sig.to_list()).astype(np.int64).view(np.uint64) for x in (a, b))
    band_a, band_b = (np.stack(x.bands.to_list()) for x in (a, b))
    k = int(np.flatnonzero(band_a[0] == pdf.band.iloc[0])[0])
    main = pdf.main.iloc[0]
    for s in range(0, len(a), 128):
        own = slice(s, s + 128)
        ok = similar(sig_a[own], sig_b) >= lowest(percent)
        ok &= a.component.to_numpy()[own, None] != b.component.to_numpy()[None, :]
        # two strays meet once
        ok &= (b.component.to_numpy() == main)[None, :] | (a.doc_id.to_numpy()[own, None] < b.doc_id.to_numpy()[None, :])
        i, j = np.nonzero(ok)
        if len(i):
            first = (band_a[s + i, :k] != band_b[j, :k]).all(1)
            i, j = i[first], j[first]
        if len(i):
            yield s + i, j, a, b


def large_links(rest: DataFrame, signed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links across the components of large buckets, by blocks of them.

    Members outside the component of the bucket's first meet all of the bucket.
    A block compares signatures and says which of its members have a possible
    partner; those come back with their texts, and the block compares the full
    sets, by shingle hashes.  It returns a link for each pair of components that
    it finds linked, never its pairs; the caller confirms these on the texts.
    """
    stray = F.col("component") != F.col("main")
    rest = rest.join(signed.select("doc_id", "bands", "n").dropDuplicates(["doc_id"]), "doc_id")
    sizes = rest.groupBy("band").agg(F.sum(stray.cast("int")).alias("strays"), F.sum(F.when(stray, F.col("n"))).alias("stray_n"), F.sum("n").alias("all_n"))
    # blocks of so many members, and of so many shingles
    blocks = lambda c, n: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(n) / BLOCK_SHINGLES)).cast("int")
    rows = rest.join(sizes, "band")
    rows = rows.select("band", "doc_id", "sig", "bands", "component", "main", stray.alias("stray"), blocks("strays", "stray_n").alias("ni"), blocks("size", "all_n").alias("nj"), F.xxhash64("doc_id").alias("h"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    plain = ["band", "doc_id", "sig", "bands", "component", "main"]
    left = rows.where("stray").select(*plain, F.lit(True).alias("left"), F.pmod("h", "ni").cast("int").alias("i"), F.explode(upto("nj")).alias("j"))
    right = rows.select(*plain, F.lit(False).alias("left"), F.explode(upto("ni")).alias("i"), F.pmod("h", "nj").cast("int").alias("j"))
    dealt = cut(left.union(right), "blocks")

    def possible(pdf: pd.DataFrame) -> pd.DataFrame:
        use_a, use_b = set(), set()
        for i, j, a, b in block_pairs(pdf, percent):
            use_a.update(a.doc_id.to_numpy()[i].tolist())
            use_b.update(b.doc_id.to_numpy()[j].tolist())
        keep = [d in (use_a if left else use_b) for d, left in zip(pdf.doc_id, pdf.left)]
        return pdf.loc[keep]

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        words, sets, label, out = Words(), {}, {}, []

        def root(c: int) -> int:
            while label.get(c, c) != c:
                c = label[c]
            return c

        def of(doc_id: int, text: str) -> np.ndarray:
            if doc_id not in sets:
                sets[doc_id] = words.shingles(text, shingle)
            return sets[doc_id]

        for i, j, a, b in block_pairs(pdf, percent):
            (ids_a, texts_a, in_a), (ids_b, texts_b, in_b) = ((x.doc_id.to_list(), x.text.to_list(), x.component.to_list()) for x in (a, b))
            for p, q in zip(i.tolist(), j.tolist()):
                ra, rb = root(in_a[p]), root(in_b[q])
                if ra == rb:
                    continue
                own, other = of(ids_a[p], texts_a[p]), of(ids_b[q], texts_b[q])
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and 100 * both >= percent * (len(own) + len(other) - both):
                    out.append((ids_a[p], ids_b[q]))
                    label[max(ra, rb)] = min(ra, rb)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    key = ["band", "i", "j"]
    few = cut(dealt.groupBy(*key).applyInPandas(possible, dealt.schema), "possible")
    return cut(few.join(texts, "doc_id").groupBy(*key).applyInPandas(confirm, "a long, b long"), "confirmed")


def near_classes(docs: DataFrame, shingle: int, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id for every row."""
    signed = cut(sign(docs, shingle), "signed")
    classes = signed.groupBy("n", "key1", "key2").agg(F.min("doc_id").alias("rep"))
    member = signed.select("doc_id", "n", "key1", "key2").join(classes, ["n", "key1", "key2"]).select("doc_id", "n", "rep")
    reps = signed.join(classes.where("n > 0").select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    entries = cut(reps.select("doc_id", "sig", F.explode("bands").alias("band")), "bands")
    buckets = entries.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("band", "a")
    full = cut(entries.join(buckets, "band"), "buckets")  # the rows of buckets with two classes or more
    firsts = full.where("doc_id = a").select("a", F.col("sig").alias("sig_a")).distinct()
    fits = lambda x, y: estimate(F.col(x), F.col(y)) >= lowest(percent)
    pairs = full.where("doc_id <> a").groupBy("a", F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.first("sig").alias("sig_b"))
    pairs = cut(pairs.join(firsts, "a").where(fits("sig_a", "sig_b")).select("a", "b", "shared"), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(full.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = cut(texts, "texts")

    def confirmed(some: DataFrame) -> DataFrame:
        b = some.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
        both = b.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
        return cut(both.select("a", "b", "text_a", "text_b").mapInPandas(confirmer(shingle, percent), "a long, b long"), "confirmed")

    def apart(some: DataFrame, stars: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        of = stars.select(F.col("vertex"), F.col("component"))
        some = some.join(of.withColumnsRenamed({"vertex": "a", "component": "ca"}), "a", "left").join(of.withColumnsRenamed({"vertex": "b", "component": "cb"}), "b", "left")
        return some.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    # each class with the first of the bucket that it shares most often, then with the others
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = confirmed(best.select("a", "b"))
    stars = components(links)
    more = confirmed(apart(pairs.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti"), stars))
    links = links.union(more)
    stars = components(links)
    # members of one bucket in different components: all pairs of a small bucket, blocks of a large one
    placed = full.join(stars, F.col("doc_id") == F.col("vertex"), "left").select("band", "doc_id", "sig", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("x"), F.max("component").alias("y"), F.min_by("component", "doc_id").alias("main")).where("x <> y").select("band", "size", "main")
    rest = cut(placed.join(mixed, "band"), "mixed")
    small = rest.where(F.col("size") <= SMALL)
    other = small.select("band", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "sig", "component")])
    cross = small.join(other, "band").where((F.col("doc_id") < F.col("doc_id_b")) & (F.col("component") != F.col("component_b")) & fits("sig", "sig_b"))
    cross = cross.select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b")).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    links = links.union(confirmed(cut(cross.union(large_links(rest.where(F.col("size") > SMALL), signed, texts, shingle, percent)).distinct(), "cross")))
    stars = components(links)
    out = member.join(stars, F.col("rep") == F.col("vertex"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents on two-word shingles at 0.8."""
    got = near_classes(table(spark, sf_dir, "documents"), shingle=2)
    return got.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c ON c.a = doc_id LEFT JOIN n USING (doc_id)
"""
