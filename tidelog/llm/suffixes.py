"""Suffix-array dedup with a logarithmic family of indexes.

A symbol (a byte, or a word) of a text is repeated where a string of ``length``
symbols that covers it also starts somewhere else; matches never cross documents.
Several searches (of bytes and of words) share one index and its passes.

The suffix arrays are sparse: of a text's suffixes those are kept that start at an
anchor, the leftmost least-hashed string of ``gram`` symbols of some window of
``length`` symbols.  Equal windows have equal anchors at equal places, so every
long match runs through suffixes that agree in their first ``gram`` symbols, which
are neighbours in a suffix array; the windows of an anchor in a row are its
context.  A suffix is ordered by a 64-bit fingerprint of its first ``gram`` symbols
(h); only agreement matters, not alphabetical order.

``LogIndex`` is the index family, in tables of the shared folder.  A new batch of
documents gets its suffix array, which is merge-scanned against all levels: what h
the batch shares with itself or with a level is a seed of a match.  Then the array
becomes a level, and levels of equal size (less than half as large again) are merged
into one, so n batches make log n levels and each suffix moves log n times.

Seeds are extended to matches, contexts being known by a fingerprint (c) too: a
context that occurs twice has only repeated windows.  Contexts that differ but share their anchor are cut by the anchor's place
in the window into ``SLICES`` slices.  All windows of a slice share a core; slices
with equal symbols are repeated whole, and only where slices with the same core
differ are their single windows compared, by two fingerprints, one slice of each
kind.  All of that is grouped by fingerprints of content, with partial sums before
each shuffle, so a passage in a third of all documents is no task of its own.

Edge cases: null and empty texts have nothing removed; texts shorter than length
symbols neither; an empty table gives an empty result; repeated rows count as texts
of their own, so each removes the other; very long texts are taken in chunks of
``CHUNK`` symbols, with what overlaps; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, size_of, small_batches, table

LENGTH = 400
GRAM = 64
#: Words of a passage (a repeat of over 50 words), and of its anchors.
WORDS, WORD_GRAM = 51, 10
#: Window starts handled at once; with the length more symbols they must be under 2^20.
CHUNK = 1 << 17
#: Slices of a context's windows.
SLICES = 8
#: Batches that the queries add to the index.
BATCHES = 4
CACHED_WORDS = 100_000

U = np.uint64
_RNG = np.random.default_rng(400)
_BYTES = _RNG.integers(0, 2**63, (2, 256), dtype=U) * U(2) + U(1)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(U(1), np.full(n - 1, base, U)))


@functools.lru_cache(4)
def _tables(which: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    base = _BASE[which]
    return _powers(base, 1 << bits), _powers(pow(base, -1, 2**64), 1 << bits)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Bytes:
    """A text as its UTF-8 bytes."""

    dtype = np.uint8
    least = 1

    def of(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode(), np.uint8)


class Words(dict):
    """A text as hashes of its words; word -> hash, filled as words come."""

    dtype = np.uint64
    least = 2

    def __missing__(self, word: bytes) -> int:
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, text: str) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = text.encode().split()
        return np.fromiter(map(self.__getitem__, words), U, len(words))


class Rolling:
    """Fingerprints of the substrings of an array of symbols, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _tables(which, max(16, int(len(data)).bit_length()))
        values = _BYTES[which][data] if data.dtype == np.uint8 else mix(data + _BYTES[which][0])
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(values * up[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def least_before(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(U).max, U)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, last: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of data.

    last: for each window start whether its window is whole in its document.
    Returns, for each anchor: first window start, count of windows, offset of the
    anchor from the first start, hash of the anchor, hash of its context.
    """
    roll = Rolling(data)
    hashes = roll.all(gram)
    low = least_before((hashes & ~U((1 << 20) - 1)) | np.arange(len(hashes), dtype=U), length - gram + 1)
    at = (low & U((1 << 20) - 1)).astype(np.int64)
    able = np.flatnonzero(last[: len(at)])
    if not len(able):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U), z.astype(U)
    new = np.flatnonzero(np.append(True, (np.diff(able) != 1) | (np.diff(at[able]) != 0)))
    start = able[new]
    count = np.diff(np.append(new, len(able)))
    anchor = at[start]
    context = roll.of(start, start + count - 1 + length)
    context = mix(context + (anchor - start).astype(U) * U(0x2545F4914F6CDD1D) + count.astype(U) * U(0x9E6C63D0876A9A47))
    return start, count, anchor - start, hashes[anchor], context


@dataclass(frozen=True)
class Search:
    """Which strings are repeats: of so many symbols of a view; across: only what two documents have, not what one repeats.

    few_words: only in texts with a window of length bytes that may hold fewer whole words than that.
    """

    view: type
    length: int
    gram: int
    across: bool = False
    few_words: int = 0

    def symbols(self, view, text: str) -> np.ndarray:
        none = np.zeros(0, self.view.dtype)
        if self.few_words and not wide(text.encode(), self.few_words, self.length):
            return none
        found = view.of(text)
        return found if len(found) >= self.length else none


def anchorer(searches: list[Search]):
    """(doc_id, text_hash, text) to the suffixes at anchors; v is the number of the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = [x.view() for x in searches]
        for batch in batches:
            for v, (search, view) in enumerate(zip(searches, views)):
                texts = [search.symbols(view, t.as_py()) for t in batch.column(2)]
                able = [i for i, t in enumerate(texts) if len(t)]
                if not able:
                    continue
                sizes = np.array([len(texts[i]) for i in able], np.int64)
                flat = np.concatenate([texts[i] for i in able])
                del texts
                length, ends = search.length, np.cumsum(sizes)
                for a in range(0, len(flat), CHUNK):
                    b = min(len(flat), a + CHUNK)
                    doc = np.searchsorted(ends, np.arange(a, b), "right")
                    whole = np.arange(a, b) + length <= ends[doc]
                    data = flat[a : min(len(flat), b + length - 1)]
                    if len(data) < length:
                        continue
                    start, count, lead, h, c = anchors_of(data, whole, length, search.gram)
                    # runs never cross documents: the last starts of a document are not whole
                    own = doc[start]
                    rows = pa.array(np.array(able, np.int64)[own])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(own), v, np.int8)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(a + start - (ends - sizes)[own]), pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32))],
                        names=["doc_id", "text_hash", "v", "h", "c", "p", "n", "lead"],
                    )

    return run


SUFFIXES = "doc_id long, text_hash long, v byte, h long, c long, p long, n int, lead int"
#: Where a context is: its document, the first window's place, the count of windows and the anchor's place in the first.
PLACE = ["doc_id", "text_hash", "p", "n", "lead"]
#: How often something occurs, and the least and greatest document with it.
SUMS = ["times", "lo", "hi"]


def counted(rows: DataFrame, searches: list[Search]) -> DataFrame:
    """rows with the columns that together() sums; documents only count where the search asks for two of them."""
    across = [v for v, x in enumerate(searches) if x.across]
    who = F.when(F.col("v").isin(across), F.xxhash64("doc_id", "text_hash")).otherwise(F.lit(0).cast("long"))
    return rows.withColumns({"times": F.lit(1).cast("long"), "lo": who, "hi": who})


def together() -> list[Column]:
    return [F.sum("times").alias("times"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]


def any_of(columns: list[str]) -> list[Column]:
    """Those columns of one row of each group, whichever: plain values, so groups are hashed and not sorted."""
    return [F.first(c).alias(c) for c in columns]


def company(searches: list[Search]) -> Column:
    """Whether what the sums stand for is repeated, by what search v counts."""
    across = [v for v, x in enumerate(searches) if x.across]
    return F.when(F.col("v").isin(across), F.col("lo") != F.col("hi")).otherwise(F.col("times") > 1)


class Level:
    """A suffix array: a table in the shared folder, sorted within its parts, and its size in bytes."""

    def __init__(self, rows: DataFrame):
        self.rows = cut(rows.sortWithinPartitions("h"), "level")
        self.size = size_of(self.rows)


class LogIndex:
    """Family of suffix arrays in levels of doubling size, of the suffixes at anchors by their first symbols (h)."""

    def __init__(self, searches: list[Search]):
        self.levels: list[Level] = []
        self.seeds: list[DataFrame] = []
        self.searches, self.company = searches, company(searches)

    def add(self, suffixes: DataFrame) -> None:
        """Add a batch of documents by the suffixes at their anchors."""
        batch = Level(counted(suffixes, self.searches).groupBy("h", "v").agg(*together()))
        # the merge-scan: one pass over the batch and all levels
        both = batch.rows.withColumn("new", F.lit(True))
        for level in self.levels:
            both = both.union(level.rows.withColumn("new", F.lit(False)))
        shared = both.groupBy("h", "v").agg(*together(), F.max("new").alias("new"))
        self.seeds.append(cut(shared.where(F.col("new") & self.company).select("h", "v"), "seeds"))
        while self.levels and 2 * self.levels[-1].size < 3 * batch.size:
            old = self.levels.pop()
            merged = Level(old.rows.union(batch.rows).groupBy("h", "v").agg(*together()))
            forget(old.rows, batch.rows)
            batch = merged
        self.levels.append(batch)

    def matched(self, suffixes: DataFrame) -> DataFrame:
        """The suffixes (of all batches) that some scan found company of."""
        seeds = cut(functools.reduce(DataFrame.union, self.seeds).distinct(), "matches")
        return suffixes.join(seeds, ["h", "v"], "left_semi")

    def close(self) -> None:
        forget(*[x.rows for x in self.levels], *self.seeds)


def cutter(searches: list[Search]):
    """Contexts of a document's anchors: (text, wanted) to the context's symbols with what is known of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views = [x.view() for x in searches]
        for pdf in batches:
            out: dict[str, list] = {k: [] for k in HELD}
            for text, wanted in zip(pdf.text, pdf.wanted):
                data: dict[int, np.ndarray] = {}
                for w in wanted:
                    v = w["v"]
                    if v not in data:
                        data[v] = views[v].of(text)
                    for k in HELD[:-1]:
                        out[k].append(w[k])
                    out["context"].append(data[v][w["p"] : w["p"] + w["n"] - 1 + searches[v].length].tobytes())
            yield pd.DataFrame(out)

    return run


HELD = ["h", "c", "v", "lead", *SUMS, "whole", "context"]


def joined(contexts: list[bytes], dtype: type, most: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of contexts of about so many symbols: which, the symbols and the sizes."""
    a, width = 0, np.dtype(dtype).itemsize
    while a < len(contexts):
        b, size = a, 0
        while b < len(contexts) and (b == a or size + len(contexts[b]) <= most * width):
            size += len(contexts[b])
            b += 1
        yield slice(a, b), np.frombuffer(b"".join(contexts[a:b]), dtype), np.array([len(x) // width for x in contexts[a:b]], np.int64)
        a = b


def of_search(batch: pa.RecordBatch, count: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by their search."""
    v = batch.column("v").to_numpy(zero_copy_only=False)
    for i in range(count):
        at = np.flatnonzero(v == i)
        if len(at):
            yield i, batch.take(pa.array(at))


def slicer(searches: list[Search]):
    """Contexts to slices: first and last window (a, b), fingerprints of the core and of the whole content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, rows in of_search(batch, len(searches)):
                length, wide_of = searches[v].length, -(-(searches[v].length - searches[v].gram + 1) // SLICES)
                h, lead = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("h", "lead"))
                for own, data, sizes in joined(rows.column("context").to_pylist(), searches[v].view.dtype):
                    high = lead[own].astype(np.int64)
                    low = high - (sizes - length)
                    many = high // wide_of - low // wide_of + 1
                    row = np.repeat(np.arange(len(sizes)), many)
                    j = low[row] // wide_of + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    o1, o2 = np.maximum(j * wide_of, low[row]), np.minimum(j * wide_of + wide_of - 1, high[row])
                    at = (np.cumsum(sizes) - sizes)[row] + high[row]  # the anchors
                    roll = Rolling(data)
                    core = mix(roll.of(at - j * wide_of, at - j * wide_of - wide_of + 1 + length) + mix(h[own][row].view(U) + j.astype(U)))
                    content = mix(roll.of(at - o2, at - o1 + length) + mix(core + (o1 * length + o2).astype(U)))
                    from_row = pa.array(own.start + row)
                    known = [rows.column(k).take(from_row) for k in HELD if k not in ("lead", "context")]
                    yield pa.RecordBatch.from_arrays(
                        [*known, pa.array((high[row] - o2).astype(np.int32)), pa.array((high[row] - o1).astype(np.int32)), pa.array(core.view(np.int64)), pa.array(content.view(np.int64))],
                        names=[*[k for k in HELD if k not in ("lead", "context")], "a", "b", "core", "content"],
                    )

    return run


def splitter(searches: list[Search]):
    """Windows a to b of contexts as two fingerprints (f, s), with the window's place after a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, rows in of_search(batch, len(searches)):
                a, b = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
                for own, data, sizes in joined(rows.column("context").to_pylist(), searches[v].view.dtype):
                    many = (b[own] - a[own] + 1).astype(np.int64)
                    row = np.repeat(np.arange(len(sizes)), many)
                    offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    start = (np.cumsum(sizes) - sizes)[row] + a[own][row] + offset
                    f, s = (Rolling(data, i).of(start, start + searches[v].length).view(np.int64) for i in (0, 1))
                    known = [rows.column(k).take(pa.array(own.start + row)) for k in WINDOW]
                    yield pa.RecordBatch.from_arrays([*known, pa.array(f), pa.array(s), pa.array(offset.astype(np.int32))], names=[*WINDOW, "f", "s", "offset"])

    return run


WINDOW = ["core", "content", "v", *SUMS, "equal"]
_TYPES = {"h": "long", "c": "long", "v": "byte", "lead": "int", "times": "long", "lo": "long", "hi": "long", "whole": "boolean", "context": "binary", "core": "long", "content": "long", "equal": "boolean", "a": "int", "b": "int", "f": "long", "s": "long", "offset": "int"}


def typed(names: list[str]) -> str:
    return ", ".join(f"{k} {_TYPES[k]}" for k in names)


def extended(searches: list[Search], matched: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, c, v, runs): the repeated windows of the contexts of matched suffixes, as runs [a, b] of window numbers."""
    repeated = company(searches)
    runs = lambda a, b: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    contexts = cut(counted(matched, searches).groupBy("h", "c", "v").agg(*together(), *any_of(PLACE)), "contexts")
    whole = contexts.where(repeated).select("h", "c", "v", runs(F.lit(0), F.col("n") - 1).alias("runs"))
    # one context of each kind, where an anchor has several
    several = contexts.groupBy("h", "v").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h", "v")
    wanted = contexts.join(several, ["h", "v"], "left_semi").withColumn("whole", repeated)
    wanted = wanted.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_list(F.struct(*HELD[:-1], "p", "n")).alias("wanted"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    held = cut(texts.join(wanted, same).select("text", "wanted").mapInPandas(cutter(searches), typed(HELD)), "held")
    slices = cut(held.mapInArrow(slicer(searches), typed([*[k for k in HELD if k not in ("lead", "context")], "a", "b", "core", "content"])), "slices")
    # slices with equal symbols are repeated whole
    contents = slices.groupBy("core", "content", "v").agg(*together(), *any_of(["h", "c", "a", "b"]))
    contents = cut(contents.withColumn("equal", repeated), "contents")
    # of cores whose slices differ one slice of each content, by single windows
    differ = contents.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    reps = contents.join(differ, "core", "left_semi").select("h", "c", "a", "b", *WINDOW)
    windows = held.select("h", "c", "context").join(reps, ["h", "c"]).select("context", "a", "b", *WINDOW)
    windows = cut(windows.mapInArrow(splitter(searches), typed([*WINDOW, "f", "s", "offset"])), "windows")
    forget(held)
    twice = windows.groupBy("f", "s", "v").agg(*together()).where(repeated).select("f", "s", "v")
    offsets = windows.where("not equal").join(twice, ["f", "s", "v"], "left_semi").groupBy("core", "content").agg(F.collect_list("offset").alias("offsets"))  # a slice has so many windows at most
    marks = contents.where("equal").select("core", "content", F.lit(None).cast("array<int>").alias("offsets")).union(offsets)
    place = lambda o: F.struct((F.col("a") + o).alias("a"), (F.col("a") + o).alias("b"))
    found = slices.where("not whole").select("core", "content", "h", "c", "v", "a", "b").join(marks, ["core", "content"])
    found = found.select("h", "c", "v", F.coalesce(F.transform("offsets", place), runs(F.col("a"), F.col("b"))).alias("runs"))
    out = cut(whole.union(found).groupBy("h", "c", "v").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    forget(contexts, slices, contents, windows)
    return out


def repeated(docs: DataFrame, searches: list[Search], batches: int = BATCHES) -> DataFrame:
    """(doc_id, text, ...) with text_hash and spans_0, spans_1 ... of the searches: the repeated ranges [a, b) of symbols in order, which may overlap (see merged); null where none is."""
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    least = min(x.view.least * x.length - x.view.least + 1 for x in searches)
    texts = keyed.where(F.octet_length("text") >= least).select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", "text")
    small_batches(docs)
    number = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    index, tables = LogIndex(searches), []
    for b in range(batches):
        tables.append(cut(texts.where(number == b).mapInArrow(anchorer(searches), SUFFIXES), "suffixes"))
        index.add(tables[-1])
    matched = cut(index.matched(functools.reduce(DataFrame.union, tables)), "matched")
    index.close()
    forget(*tables)
    found = extended(searches, matched, texts)
    length = F.element_at(F.array(*[F.lit(x.length) for x in searches]), F.col("v") + 1)
    ranges = F.transform("runs", lambda r: F.struct((F.col("p") + r["a"]).alias("a"), (F.col("p") + r["b"] + length).alias("b")))
    marked = matched.join(found, ["h", "c", "v"]).select("doc_id", "text_hash", "v", ranges.alias("spans"))
    spans = [F.array_sort(F.flatten(F.collect_list(F.when(F.col("v") == v, F.col("spans"))))) for v in range(len(searches))]
    marked = marked.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(*[F.when(F.size(x) > 0, x).alias(f"spans_{v}") for v, x in enumerate(spans)])
    marked = cut(marked, "marked")
    forget(matched, found)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    return keyed.join(marked, same, "left").drop("d", "t")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, view: type = Bytes, across: bool = False, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text, ...) with text_hash and spans, of one search."""
    search = Search(view, length, min(gram, max(1, length // 2)), across)
    return repeated(docs, [search], batches).withColumnRenamed("spans_0", "spans")


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data."""
    d = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(d) + 2, np.int8)
    inside[1:-1] = ~((d == 32) | ((d >= 9) & (d <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def wide(data: bytes, words: int, length: int) -> bool:
    """Whether some window of length bytes may hold fewer whole words than that."""
    start, end = word_bounds(data)
    last = np.minimum(np.arange(len(start) + 1) + words + 1, len(start))
    return bool((np.append(start, len(data))[last] - np.append(0, end)).max() >= length)


def passages(docs: DataFrame, words: int = WORDS, length: int = LENGTH) -> DataFrame:
    """docs with in_words and in_bytes, for spans_of: ranges of words that repeat for so many words, and of bytes that repeat for length bytes; null where nothing does.

    A string of length bytes with fewer words is only in texts that have such a
    window, so the texts' bytes are compared among these alone.
    """
    found = repeated(docs, [Search(Words, words, WORD_GRAM), Search(Bytes, length, GRAM, few_words=words)])
    return found.drop("text_hash").withColumnsRenamed({"spans_0": "in_words", "spans_1": "in_bytes"})


def spans_of(data: bytes, in_words, in_bytes) -> list[tuple[int, int]]:
    """The byte ranges of data that passages() found; the space behind words goes with them."""
    start = np.append(word_bounds(data)[0], len(data))
    found = [(int(start[a]), int(start[b])) for a, b in merged(in_words)] + merged(in_bytes)
    return merged([{"a": a, "b": b} for a, b in sorted(found)])


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of sorted byte ranges."""
    out: list[list[int]] = []
    for x in () if spans is None else spans:
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def op2_log_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without its bytes that repeat for 400 bytes.

    n_passage_words and n_passages follow: the words that strings of 51 words cover
    which also start in another text or another document, and their maximal runs.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated(docs, [Search(Bytes, LENGTH, GRAM), Search(Words, WORDS, WORD_GRAM, across=True)])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, spans, passages in zip(pdf.text, pdf.spans_0, pdf.spans_1):
                data, gone, words = (text or "").encode(), merged(spans), merged(passages)
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(data, gone)).hexdigest(), sum(b - a for a, b in words), len(words)))
            yield pd.DataFrame({"doc_id": pdf.doc_id, **{k: [r[i] for r in rows] for i, k in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages"))}})

    return found.select("doc_id", "text", "spans_0", "spans_1").mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, p, md5(b[p:p + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d)
), r AS (
  SELECT h FROM w GROUP BY h HAVING count(*) > 1
), m AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM w WHERE h IN (SELECT h FROM r)
), i AS (
  SELECT doc_id, p, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM m
), s AS (
  SELECT doc_id, min(p) AS a, max(p) + 399 AS z FROM i GROUP BY doc_id, run
), k AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS before FROM s
), kept AS (
  SELECT d.doc_id, string_agg(hex(b[k.before:k.a - 1]), '' ORDER BY k.a) || hex(any_value(b)[max(k.z) + 1:octet_length(any_value(b))]) AS rest,
    sum(k.z - k.a + 1) AS n_removed, count(*) AS n_spans
  FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
), t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents
), v AS (
  SELECT doc_id, p, md5(array_to_string(x[p:p + 50], ' ')) AS h FROM (SELECT doc_id, x, unnest(range(1, len(x) - 49)) AS p FROM t)
), u AS (
  SELECT h FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1
), y AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM v WHERE h IN (SELECT h FROM u)
), z AS (
  SELECT doc_id, sum(CASE WHEN step <= 51 THEN step ELSE 51 END) AS n_passage_words, sum(CASE WHEN step <= 51 THEN 0 ELSE 1 END) AS n_passages FROM y GROUP BY doc_id
)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN rest IS NULL THEN b ELSE unhex(rest) END) AS kept_sha256,
  CAST(coalesce(n_passage_words, 0) AS BIGINT) AS n_passage_words, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""
