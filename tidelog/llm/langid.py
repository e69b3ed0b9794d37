"""Language identification by prediction by partial matching.

For each language, byte contexts of up to ``ORDER`` bytes hold the counts of the
bytes that followed them.  A byte costs -log2 of its probability in the longest
context that the statistics know: n / (N + T) where it was seen after that
context (N occurrences, T distinct followers), else the escape T / (N + T) and
its cost in the context one byte shorter; below order 0 all 256 bytes are alike.
The statistics are frozen after training.  The language with the shortest exact
code for the whole text is predicted; score is its posterior under equal priors.

Training counts the contexts of a bounded sample (``PER_LANGUAGE`` documents of
each language in order of a hash of doc_id, texts over ``LONGEST_SAMPLE``
characters left out), on the executors; the model is bounded as the sample is.
Scoring is one narrow stage over every whole text, as numpy look-ups of all positions.

Edge cases: null texts and those without a letter are ``und`` with score 0.0, and
so is everything where no language was learned.  Ties go to the first name.  An empty
table gives an empty result; very long texts are scored whole, ``BLOCK`` positions at
a time; repeated rows are scored each; columns are kept as ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remainder, small_batches, table

ORDER = 4
PER_LANGUAGE = 400
LONGEST_SAMPLE = 200_000
#: Positions scored at once.
BLOCK = 1 << 19


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """Keys of all byte strings of a length, by their last position: length in the high bits, then the bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.full(n, length, np.int64)
    for i in range(length):
        key = (key << 8) | data[i : i + n]
    return key


def count(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, text) to (lang, gram, n): all byte strings of up to order + 1 bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang").text:
                keys = [k for t in texts for length in range(1, order + 2) if len(k := grams(np.frombuffer(t.encode(), np.uint8).astype(np.int64), length))]
                if keys:
                    gram, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    return docs.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Open-addressed hash table of int64 keys (positive) to their places in the list."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(len(keys)).bit_length() + 1)
        size = 1 << self.bits
        self.keys = np.zeros(size, np.int64)
        self.at = np.full(size, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        home = self.home(keys)
        while len(left):
            slot = (home[left] + step) & (size - 1)
            free = self.keys[slot] == 0
            some = np.flatnonzero(free)
            _, first = np.unique(slot[some], return_index=True)
            some = some[first]
            self.keys[slot[some]] = keys[left[some]]
            self.at[slot[some]] = left[some]
            left = np.delete(left, some)
            step += 1
        self.steps = step

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where absent."""
        slot = self.home(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.at[slot], -1)
        left = np.flatnonzero((got != keys) & (got != 0))
        step = 0
        while len(left) and step < self.steps:
            step += 1
            s = (slot[left] + step) & (len(self.keys) - 1)
            got = self.keys[s]
            same = got == keys[left]
            out[left[same]] = self.at[s[same]]
            left = left[~same & (got != 0)]
        return out


def model_of(counts: pd.DataFrame, order: int = ORDER) -> dict | None:
    """Frozen costs: for each known byte string, the bits of its last byte after the others, and the bits of an escape from it as a context."""
    if not len(counts):
        return None
    langs = sorted(counts.lang.unique())
    keys = np.unique(counts.gram.to_numpy())
    n = np.zeros((len(keys), len(langs)))
    for j, lang in enumerate(langs):
        own = counts[counts.lang == lang]
        n[np.searchsorted(keys, own.gram.to_numpy()), j] = own.n.to_numpy()
    length = np.zeros(len(keys), np.int64)
    for d in range(1, order + 2):
        length[(keys >> (8 * d)) == d] = d
    byte = keys & 0xFF

    def place(k: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, at, -1)

    bits = np.zeros_like(n)
    escape = np.zeros_like(n)
    below = np.zeros((len(langs),))
    for d in range(1, order + 2):
        rows = np.flatnonzero(length == d)
        body = keys[rows] & ((1 << (8 * d)) - 1)
        if d == 1:
            group, groups, context = np.zeros(len(rows), np.int64), 1, None
            shorter = np.full((len(rows), len(langs)), 8.0)
        else:
            context, group = np.unique((body >> 8) | ((d - 1) << (8 * (d - 1))), return_inverse=True)
            groups = len(context)
            # the same byte after a context one byte shorter: known, as every tail of a known string is
            shorter = bits[place((body & ((1 << (8 * (d - 1))) - 1)) | ((d - 1) << (8 * (d - 1))))]
        total, kinds = np.zeros((groups, len(langs))), np.zeros((groups, len(langs)))
        np.add.at(total, group, n[rows])
        np.add.at(kinds, group, n[rows] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            seen = -np.log2(n[rows] / (total + kinds)[group])
        bits[rows] = np.where(n[rows] > 0, seen, out[group] + shorter)
        if d == 1:
            below = out[0]
        else:
            at = place(context)
            escape[at[at >= 0]] = out[at >= 0]
    return {"langs": langs, "keys": keys, "bits": bits.astype(np.float32), "escape": escape.astype(np.float32), "below": below, "order": order}


class Coder:
    def __init__(self, model: dict):
        self.m, self.table = model, Table(model["keys"])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language's code; texts are not empty."""
        order, langs = self.m["order"], len(self.m["langs"])
        out = np.zeros((len(texts), langs))
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        within = np.arange(len(data)) - np.repeat(first, sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for a in range(0, len(data), BLOCK):
            b = min(len(data), a + BLOCK)
            cost = np.zeros((b - a, langs), np.float32)
            left = np.arange(a, b)
            for d in range(order, -1, -1):
                able = within[left] >= d
                pos, rest = left[able], left[~able]
                body = np.zeros(len(pos), np.int64)
                for i in range(d, 0, -1):
                    body = (body << 8) | data[pos - i]
                key = body | (d << (8 * d))
                full = (body << 8) | data[pos] | ((d + 1) << (8 * (d + 1)))
                at = self.table.find(full)
                hit = at >= 0
                cost[pos[hit] - a] += self.m["bits"][at[hit]]
                missed = pos[~hit]
                if d:
                    context = self.table.find(key[~hit])
                    known = context >= 0
                    cost[missed[known] - a] += self.m["escape"][context[known]]
                else:
                    cost[missed - a] += (self.m["below"] + 8.0).astype(np.float32)
                left = np.concatenate([missed, rest])
            own = owner[a:b]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[starts]] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, order: int = ORDER) -> dict | None:
    """Statistics of a bounded sample of the documents with a lang and a text."""
    able = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= LONGEST_SAMPLE))
    small_batches(docs)
    # of each language the hashes under a bound that holds the wanted number with room, so no task ranks all of one
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    room = F.lit(per_language + 10 * per_language**0.5 + 100) / F.count(F.lit(1))
    bounds = able.groupBy("lang").agg((room * (1 << 30)).alias("bound"))  # a row a language
    near = able.select("doc_id", "lang").join(F.broadcast(bounds), "lang").where(place < F.col("bound"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = near.withColumn("rn", F.row_number().over(by_hash)).where(F.col("rn") <= per_language).select("doc_id").distinct()
    sample = able.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").select("lang", "text")
    return model_of(count(sample, order).toPandas(), order)  # as many strings as the sample has bytes, at most order + 1 times


def identify(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The kept columns with lang_pred, lang_score and code_bits (of the whole text in the best language)."""
    shape = docs.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double").add("code_bits", "double")
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(held.value) if held.value else None
        for pdf in batches:
            texts = list(pdf.pop("__text"))
            name, sure, bits = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            able = [i for i, t in enumerate(texts) if coder and t and any(map(str.isalpha, t))]
            while able:
                some, size = [], 0
                while able and (not some or size < 4 * BLOCK):
                    some.append(able.pop())
                    size += len(texts[some[-1]])
                lengths = coder.lengths([texts[i].encode() for i in some])
                best = lengths.argmin(1)
                least = lengths[np.arange(len(some)), best]
                odds = 1 / np.exp2(np.minimum(0, least[:, None] - lengths)).sum(1)
                for i, j, p, v in zip(some, best, odds, least):
                    name[i], sure[i], bits[i] = coder.m["langs"][j], float(p), float(v)
            yield pdf.assign(lang_pred=name, lang_score=sure, code_bits=bits)

    return docs.select(*keep, F.col("text").alias("__text")).mapInPandas(run, shape)


def op5_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all whole texts, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(remainder(F.col("doc_id"), 5) != 0))
    got = identify(docs, model, ["doc_id"])
    return got.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
