"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability, the logistic
of the summed weights of its words and of their first four and five letters; the
document's is the noisy-or of its sentences', 1 - prod(1 - p).  A sentence adds
what its words add to the bias, so one without weighted words adds nothing however
many there are; a document-level noise term, fitted along and left out of scores,
stands for toxic labels that no sentence accounts for.  Only document
labels are known in training; the noisy-or's gradient finds the sentences that
account for them, so the same weights then locate the offending sentences.

The model is fitted on a bounded sample of labelled documents (``PER_LABEL`` of
label 0 and of label 1, in order of a hash of doc_id, whatever their length); each
label counts by its share of all labels, not of the sample, and equal texts are
one with their mean label.  The texts of the sample stay on the executors: these
count the features, then send each text's bag of chosen features to the fit.
Every whole text is scored, in one narrow stage.

Edge cases: null or wordless texts have score 0.0 and no offending sentence;
without labelled documents of both kinds every score is 0.0.  Rows of labels
with a null toxic are not learned from.  An empty table gives an empty result;
repeated rows are scored each; very long texts are learned from and scored whole;
columns are kept as ``keep`` names them, but for the four that score() adds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remainder, small_batches, table

PER_LABEL = (8000, 3000)
BITS = 18
#: Gradient steps over all bags, their rate, and the weights' lasso.
STEPS, RATE, LASSO = 600, 0.3, 1e-5
#: Features let in by chance, on average, at most.
FALSE_FEATURES = 3
THRESHOLD = 0.3
CACHED_WORDS = 100_000
SENTENCE_END = re.compile(r"[.!?\n]+")


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence that has words."""
    at = 0
    low = text.lower() if len(text.lower()) == len(text) else text
    for stop in SENTENCE_END.finditer(low):
        if words := low[at : stop.start()].split():
            yield at, stop.end(), words
        at = stop.end()
    if words := low[at:].split():
        yield at, len(low), words


def features(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    return [zlib.crc32(f"{kind}{part}".encode("utf-8", "replace")) & mask for kind, part in (("w", word), ("4", word[:4]), ("5", word[:5]))]


def feature_counts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text, toxic) to (feature, seen, bad): distinct texts with a feature, and their summed labels."""
    memo: dict[str, list[int]] = {}
    seen, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for pdf in rows:
        for text, label in zip(pdf.text, pdf.toxic):
            ids: set[int] = set()
            for _, _, words in sentences(text):
                for w in set(words):
                    if (f := memo.get(w)) is None:
                        if len(memo) > CACHED_WORDS:
                            memo.clear()
                        f = memo[w] = features(w)
                    ids.update(f)
            own = np.fromiter(ids, np.int64, len(ids))
            seen[own] += 1
            bad[own] += label
    at = np.flatnonzero(seen)
    yield pd.DataFrame({"feature": at, "seen": seen[at], "bad": bad[at]})


def choose(feature: np.ndarray, seen: np.ndarray, bad: np.ndarray, base: float) -> np.ndarray:
    """Features that occur in toxic texts more often than chance allows: Chernoff's bound on the binomial tail, divided among all features."""
    base = min(max(base, 1e-3), 1 - 1e-3)
    share = np.clip(bad / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    surprise = seen * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    return np.sort(feature[(share > base) & (surprise > math.log(max(2, (seen > 1).sum()) / FALSE_FEATURES))])


def bagger(chosen: np.ndarray):
    """(text, toxic) to a bag: label, and the sentence and the place in chosen of each chosen feature; texts without any as sums of their labels."""
    place = {f: i for i, f in enumerate(chosen.tolist())}

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, list[int]] = {}
        for pdf in rows:
            out, plain = [], []
            for text, label in zip(pdf.text, pdf.toxic):
                sentence, at = [], []
                for i, (_, _, words) in enumerate(sentences(text)):
                    for w in words:
                        if (f := memo.get(w)) is None:
                            if len(memo) > CACHED_WORDS:
                                memo.clear()
                            f = memo[w] = [place[x] for x in features(w) if x in place]
                        sentence += [i] * len(f)
                        at += f
                if at:
                    out.append((float(label), 1, sentence, at))
                else:
                    plain.append(float(label))
            for label in sorted(set(plain)):
                out.append((label, plain.count(label), [], []))
            yield pd.DataFrame(out, columns=["label", "n", "sentence", "at"])

    return run


def gradients(w: np.ndarray, bias: float, noise: float, y: np.ndarray, counts: np.ndarray, bag: np.ndarray, sentence: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Negative log likelihood of the labels under the noisy-or, and its gradient by weights, bias and noise.

    A sentence (a number; bag has the bag of each sentence) has the logit bias +
    the weights of its features; entries (sentence, at) name them.  A bag's
    label is false with probability (1 - noise) * prod((1 - p) / (1 - p of bias
    alone)).  y may be a share: the mean label of equal texts.
    """
    z = np.bincount(sentence, w[at], len(bag)) + bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    base_p, false = 1 / (1 + math.exp(-bias)), 1 / (1 + math.exp(-noise))
    clean = math.log1p(-false) - np.bincount(bag, np.logaddexp(0, z) - np.logaddexp(0, bias), len(y))
    clean = np.minimum(clean, -1e-12)
    none = np.exp(clean)
    toxic = -np.expm1(clean)
    total = counts.sum()
    loss = -(counts * ((1 - y) * clean + y * np.log(toxic))).sum() / total
    of = counts * ((1 - y) - y * none / toxic) / total
    by = of[bag]
    return np.bincount(at, (by * p)[sentence], len(w)), float((by * (p - base_p)).sum()), float(of.sum() * false), float(loss)


def fit(bags: pd.DataFrame, n: int, shares: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """Weights of n features and the bias by AdaGrad on the noisy-or likelihood of document labels, with a noise term.

    shares: how many labelled documents each document of label 0 and of label 1 stands for.
    Weights are not negative: a sentence offends by what it says.
    """
    y = bags.label.to_numpy(np.float64)
    counts = bags.n.to_numpy(np.float64) * (y * shares[1] + (1 - y) * shares[0])
    sizes = np.array([len(x) for x in bags["at"]], np.int64)
    owner = np.repeat(np.arange(len(bags)), sizes)
    flat = lambda c: np.concatenate([np.asarray(x, np.int64) for x in bags[c]]) if len(bags) else np.zeros(0, np.int64)
    at = flat("at").astype(np.int64)
    key, sentence = np.unique(owner << 32 | flat("sentence").astype(np.int64), return_inverse=True)
    bag = key >> 32
    w, bias, noise = np.full(n, 1.0), -6.0, -4.0
    g2, b2, n2 = np.full(n, 1e-12), 1e-10, 1e-10
    for _ in range(STEPS):
        grad, gb, gn, _ = gradients(w, bias, noise, y, counts, bag, sentence, at)
        grad = grad + LASSO * (w > 0)
        g2 += grad * grad
        w = np.maximum(0, w - RATE * grad / np.sqrt(g2))
        b2 += gb * gb
        bias -= RATE * gb / math.sqrt(b2)
        n2 += gn * gn
        noise -= RATE * gn / math.sqrt(n2)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = PER_LABEL) -> tuple[np.ndarray, float] | None:
    """Fit on at most per_label[label] documents of each label.

    Texts stay on the executors, which count features and then reduce each text to
    its bag of chosen features; one task fits these bags and returns the weights.
    """
    marked = labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    there = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    shares = tuple(max(1.0, there.get(value, 0) / per_label[value]) for value in (0, 1))
    chosen = None
    for value in (0, 1):
        # the hashes under a bound that holds the wanted number with room, so no task sorts all labels
        room = (per_label[value] + 10 * math.sqrt(per_label[value]) + 100) / max(1, there.get(value, 0))
        part = marked.where(F.col("toxic") == value)
        if room < 1:
            part = part.where(F.pmod(order, F.lit(1 << 30)) < int(room * (1 << 30)))
        part = part.orderBy(order, "doc_id").limit(per_label[value])
        chosen = part if chosen is None else chosen.union(part)
    sample = docs.where(F.length("text") >= 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # equal texts are one, with their mean label
    keyed = sample.select("text", F.xxhash64("text").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b"), "toxic")
    sample = cut(keyed.groupBy("a", "b").agg(F.first("text").alias("text"), F.avg("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    size, bad = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not size or not 0 < bad < size:
        return None
    small_batches(sample)
    counted = sample.mapInPandas(feature_counts, "feature long, seen double, bad double").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).toPandas()  # 2^BITS rows at most
    kept = choose(*(counted[c].to_numpy() for c in ("feature", "seen", "bad")), bad / size)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort(([len(x) for x in pdf["at"]], [zlib.crc32(np.asarray(x, np.int64).tobytes()) for x in pdf["at"]], pdf.label))]
        w, b = fit(pdf, len(kept), shares)
        return pd.DataFrame({"weights": [w.astype("<f8").tobytes()], "bias": [b]})

    bags = sample.mapInPandas(bagger(kept), "label double, n long, sentence array<int>, at array<int>")
    got = bags.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(one, "weights binary, bias double").first()
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = np.frombuffer(got.weights, "<f8")
    return weights, got.bias


class Scorer(dict):
    """word -> summed weight of its features, filled as words come."""

    def __init__(self, model):
        self.weights, self.bias = model
        self.least = math.log1p(math.exp(self.bias))

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        v = self[word] = float(sum(self.weights[f] for f in features(word)))
        return v

    def score(self, text: str | None) -> tuple[float, int, int, float]:
        """Noisy-or score, and start, end and probability of the worst sentence."""
        total, worst = 0.0, (-1e9, 0, 0)
        for start, end, words in sentences(text or ""):
            z = self.bias + sum(map(self.__getitem__, words))
            if z > self.bias:
                total += (math.log1p(math.exp(z)) if z < 30 else z) - self.least
            if z > worst[0]:
                worst = (z, start, end)
        return -math.expm1(-total), worst[1], worst[2], 1 / (1 + math.exp(-max(-700.0, worst[0])))


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """The kept columns with toxicity, worst_start, worst_end and worst_toxicity of the worst sentence."""
    shape = docs.select(*keep).schema.add("toxicity", "double").add("worst_start", "long").add("worst_end", "long").add("worst_toxicity", "double")
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value) if held.value else None
        for pdf in batches:
            got = [scorer.score(t) if scorer is not None and t else (0.0, 0, 0, 0.0) for t in pdf.pop("__text")]  # an empty Scorer is false
            for i, c in enumerate(("toxicity", "worst_start", "worst_end", "worst_toxicity")):
                pdf[c] = [g[i] for g in got]
            yield pdf

    return docs.select(*keep, F.col("text").alias("__text")).mapInPandas(run, shape)


def op4_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all whole texts, learned from labels outside fold 2 of 4, with the place (in characters) and the probability of the worst sentence."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    scored = score(docs, model, ["doc_id"])
    held_out, predicted = remainder(F.col("doc_id"), 4) == 2, (F.col("toxicity") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"), "worst_start", "worst_end", "worst_toxicity")
