"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(part | class, history) * P(token | class, part).
The ``SINGLES`` most frequent tokens (the end token among them) are classes of their
own; every other token is in one of ``SPELLINGS`` classes by the hash of its last two
bytes, and in one of the class's ``PARTS`` parts by four bits of its own hash.  Both
softmaxes have hashed features.  The class's are the last token, the two before it
skipping the ones between, and the last two together, each in ``ROWS`` rows of
weights; the part's are the class alone, and with it the last token and the last two
together, in rows that grow with the vocabulary up to ``MOST_ROWS``.  Within a part a
token has its share of the part's training count; unseen tokens share the part's
Good-Turing mass, its share of tokens that occurred once.  So the model is a proper
distribution over known tokens and one unknown token a part.

Token counts cover all training documents and stay distributed.  Only the
``FREQUENT`` most frequent are broadcast (16 bytes each); rarer tokens leave the
scan as (hash, count in the document) and are joined with the counts.  Training
passes once over all training documents, in ``ROUNDS`` disjoint parts: each task
takes AdaGrad steps from the current weights over its share, and the tasks'
weights are averaged by their tokens before the next part, ``FAN`` tasks at a time.
A task has ``TASK_TOKENS`` tokens at most, about, so a lost executor costs minutes at
any size, and weights move once for each task.

Edge cases: null and empty texts are the end token alone; without training
documents N and V are 0 and every token is unknown; an empty table gives an empty
result; repeated rows are scored each; very long texts are scored whole, and extra
columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean, cut, remainder, small_batches, table

SINGLES, SPELLINGS, PARTS = 64, 32, 16
CLASSES = SINGLES + SPELLINGS
#: Rows of weights of each class feature; features of a class; features of a part beside the class; least and most rows of each of those.
ROWS = 1 << 13
SLOTS = 4
PART_SLOTS = 2
LEAST_ROWS, MOST_ROWS = 1 << 10, 1 << 16
FREQUENT = 200_000
ROUNDS = 3
STEP = 2048
RATE = 0.2
#: Uses of a row in a step that are added for all rows at once; further ones, of few rows, are summed by a product of matrices.  Tables of so few rows are summed whole.
USES, FEW_ROWS = 10, 64
#: Distinct tokens that a task counts before it hands them on, in batches of a quarter of that.
COUNTED = 150_000
TASK_TOKENS, FAN = 100_000_000, 64
#: A token that is no word: it holds a space.
END = b" end"


#: Lower-case bytes, and bytes that separate words.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Longer words are hashed one by one.
LONG = 64
MIX, LAST_MIX = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93


def token_hash(word: bytes) -> int:
    """A hash of 64 bits, eight bytes at a time, what hashes() has for many words; fewer are ended by a byte that no text has, so words of at most eight bytes never share one."""
    if len(word) > LONG:
        v = xxhash.xxh3_64_intdigest(word)
    else:
        v, mask = 0, (1 << 64) - 1
        for i in range(0, len(word), 8):
            v = (v ^ int.from_bytes((word[i:] + b"\xff")[:8], "little")) * MIX & mask
            v ^= v >> 32
        v = v * LAST_MIX & mask
        v ^= v >> 29
    return v - (1 << 64) if v >= 1 << 63 else v


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """token_hash() of the words of those places and sizes in data, which has eight bytes more after the last."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    keep = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    end = np.array([*(255 << 8 * i for i in range(8)), 0], np.uint64)
    v = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size <= LONG)
    done = 0
    while len(some):
        every = len(some) == len(v)
        at, left = (start, size) if every else (start[some], size[some])
        x = eight[at + done]
        held = np.minimum(left - done, 8)
        x &= keep[held]
        x |= end[held]
        x ^= v if every else v[some]
        x *= np.uint64(MIX)
        x ^= x >> np.uint64(32)
        if every:
            v = x
        else:
            v[some] = x
        done += 8
        some = some[left > done]
    v *= np.uint64(LAST_MIX)
    v ^= v >> np.uint64(29)
    for i in np.flatnonzero(size > LONG):
        v[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return v.view(np.int64)


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLINGS


@functools.cache
def spellings() -> np.ndarray:
    """Classes of words by their last two bytes, then of words of one byte."""
    return np.array([spelling(bytes((i >> 8, i & 255))) for i in range(1 << 16)] + [spelling(bytes((i,))) for i in range(256)], np.int32)


def part_of(h: np.ndarray) -> np.ndarray:
    return (h & (PARTS - 1)).astype(np.int32)


def tokens_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and spelling of each token of the texts, in order, the end token last in each; and the count of tokens of each text."""
    texts = pc.fill_null(texts, "")
    _, offsets, held = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    n = offsets[-1] - offsets[0]
    data = np.zeros(n + 8, np.uint8)
    if n:
        np.take(LOWER, np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]], out=data[:n], mode="clip")
    offsets -= offsets[0]
    word = ~SPACES[data[:n]]
    apart = np.ones(n + 1, bool)  # no word goes on from the byte before
    apart[1:] = ~np.append(word, False)[:-1]
    apart[offsets] = True
    start = np.flatnonzero(word & apart[:-1])
    apart[:-1] |= ~word
    size = np.flatnonzero(word & apart[1:]) + 1 - start
    tail = start + size
    tail = np.where(size > 1, data[tail - 2].astype(np.int32) << 8, 1 << 16) | data[tail - 1]
    sizes = np.diff(np.searchsorted(start, offsets)) + 1
    h, spelled = np.full(len(start) + len(texts), token_hash(END)), np.full(len(start) + len(texts), spelling(END), np.int32)
    inside = np.ones(len(h), bool)
    inside[np.cumsum(sizes) - 1] = False
    h[inside], spelled[inside] = hashes(data, start, size), spellings()[tail]
    return h, spelled, sizes


def count_tokens(docs: DataFrame) -> DataFrame:
    """(text) to token (hash), spelling, n."""

    def counted(some: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        whole = pa.Table.from_batches(some).group_by(["token", "spelling"], use_threads=False).aggregate([("n", "sum")])
        return whole.rename_columns({"n_sum": "n"}).select(["token", "spelling", "n"]).combine_chunks().to_batches(max_chunksize=COUNTED // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for texts, _ in blocks(batches, 0):
            h, spelled, _ = tokens_in(texts)
            some += counted([pa.RecordBatch.from_arrays([pa.array(h), pa.array(spelled), pa.array(np.ones(len(h), np.int64))], names=["token", "spelling", "n"])])
            if sum(b.num_rows for b in some) > 2 * COUNTED:
                some = counted(some)
                if sum(b.num_rows for b in some) > COUNTED:
                    yield from some
                    some = []
        if some:
            yield from counted(some)

    return docs.select("text").mapInArrow(run, "token long, spelling int, n long").groupBy("token", "spelling").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Classes and training counts of tokens by their hashes."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, singles: np.ndarray):
        self.frequent, self.counts = frequent, counts  # sorted hashes and their counts
        self.order = singles.argsort()
        self.singles = singles[self.order]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, counts (-1: not frequent) and classes of these; the place in them of each token of the texts; and the count of tokens of each text."""
        h, spelled, sizes = tokens_in(texts)
        coded = pa.array(h).dictionary_encode()
        h, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        where = np.minimum(np.searchsorted(self.frequent, h), max(0, len(self.frequent) - 1))
        n = np.where(self.frequent[where] == h, self.counts[where], -1) if len(self.frequent) else np.full(len(h), -1)
        cls = np.empty(len(h), np.int32)
        cls[at] = spelled + SINGLES
        own = np.minimum(np.searchsorted(self.singles, h), len(self.singles) - 1)
        single = self.singles[own] == h
        cls[single] = self.order[own[single]]
        return h, n, cls, at, sizes


def history(h: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's features, from token hashes: the tokens one, two and three before, and the first two of these together."""
    u = (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
    within = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = []
    for d in (1, 2, 3):
        x = np.zeros(len(u), np.uint64)
        x[d:] = u[:-d] if d <= len(u) else 0
        x[within < d] = 0
        back.append(x)
    return [*back, (back[0] * np.uint64(0xD6E8FEB86659FD93) + back[1]) >> np.uint64(20)]


def class_rows(back: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of weights of each class feature."""
    return [(x % np.uint64(ROWS)).astype(np.uint16) for x in back]


def part_rows(back: list[np.ndarray], cls: np.ndarray, rows: int) -> list[np.ndarray]:
    """Rows of weights of each part feature: of the class itself, and of the class with the last token and with the last two."""
    own = (cls - SINGLES).astype(np.uint64)
    out = [own.astype(np.uint16)]
    for x in (back[0], back[3]):
        y = ((x + own * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        out.append((y % np.uint64(rows)).astype(np.uint16))
    return out


def of_classes(weights: np.ndarray) -> list[np.ndarray]:
    """The weights of each class feature, as views."""
    return [weights[i * ROWS : (i + 1) * ROWS] for i in range(SLOTS)]


def of_parts(weights: np.ndarray) -> list[np.ndarray]:
    """The weights of each part feature, as views."""
    rows = (len(weights) - SPELLINGS) // PART_SLOTS
    return [weights[:SPELLINGS], *(weights[SPELLINGS + i * rows : SPELLINGS + (i + 1) * rows] for i in range(PART_SLOTS))]


class Room:
    """Arrays that steps write to, made once for a task: fresh ones of their size cost more than the sums in them."""

    def __init__(self, outcomes: int, tokens: int = STEP):
        self.slope, self.some, self.new = (np.empty((tokens, outcomes), np.float32) for _ in range(3))
        self.ones = np.ones(max(tokens, outcomes), np.float32)


def rows_of(table: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Those rows of a table, in the first rows of out; rows are known to be in the table."""
    return table.take(rows, 0, out[: len(rows)], "clip")


def energies(weights: list[np.ndarray], rows: list[np.ndarray], bias: np.ndarray | None = None, room: Room | None = None) -> np.ndarray:
    """Sums of the features' weights for each outcome, the largest 0 where any is large; in the room's slope."""
    room = room or Room(weights[0].shape[1], len(rows[0]))
    z = rows_of(weights[0], rows[0], room.slope)
    if bias is not None:
        z += bias
    for w, row in zip(weights[1:], rows[1:]):
        z += rows_of(w, row, room.some)
    if z.size and z.max() > 30:
        z -= z.max(1, keepdims=True)
    return z


def log_softmax_of(weights: list[np.ndarray], rows: list[np.ndarray], y: np.ndarray, bias: np.ndarray | None = None, room: Room | None = None) -> np.ndarray:
    """Log probability of one outcome for each token."""
    room = room or Room(weights[0].shape[1], len(y))
    z = energies(weights, rows, bias, room)
    own = z[np.arange(len(y)), y]
    np.exp(z, out=z)
    return own - np.log(z @ room.ones[: z.shape[1]])


def step(weights: list[np.ndarray], square: list[np.ndarray], rows: list[np.ndarray], y: np.ndarray, rate: float, bias: np.ndarray | None = None, room: Room | None = None) -> None:
    """One AdaGrad step on the likelihood of outcomes y, in place; square has the summed squares of a row's gradients."""
    room = room or Room(weights[0].shape[1], len(y))
    slope = energies(weights, rows, bias, room)
    np.exp(slope, out=slope)
    slope /= (slope @ room.ones[: slope.shape[1]])[:, None]
    slope[np.arange(len(y)), y] -= 1
    if bias is not None:
        bias -= np.float32(rate * 0.1 / len(y)) * (room.ones[: len(y)] @ slope)
    for w, w2, own in zip(weights, square, rows):
        descend(w, w2, *summed(slope, own, room, len(w)), rate, room)


def summed(slope: np.ndarray, own: np.ndarray, room: Room, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are used, of so many, and the sum of the slopes of each row's uses; of few rows all, and zeros for those without uses."""
    if rows <= FEW_ROWS:
        return np.arange(rows), (np.arange(rows)[:, None] == own).astype(np.float32) @ slope
    order = own.argsort(kind="stable")
    in_order = own[order]
    new = np.ones(len(own), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    first = np.flatnonzero(new)
    size = np.append(first[1:], len(own)) - first
    most = (-size.astype(np.int16)).argsort(kind="stable")  # the rows with most uses come first; STEP fits
    first, size = first[most], size[most]
    grad = rows_of(slope, order[first], room.some)
    more = (len(size) - np.bincount(np.minimum(size, USES + 1), minlength=USES + 2).cumsum()).tolist()  # rows with more uses than 0, 1, ...
    for i in range(1, USES):
        n = more[i]
        if not n:
            break
        grad[:n] += rows_of(slope, order[first[:n] + i], room.new)
    if n := more[USES]:
        further = size[:n] - USES
        which = np.arange(n).repeat(further)
        at = np.arange(len(which)) + (first[:n] + USES - further.cumsum() + further)[which]
        grad[:n] += (np.arange(n)[:, None] == which).astype(np.float32) @ rows_of(slope, order[at], room.new)
    return in_order[first], grad


def descend(w: np.ndarray, w2: np.ndarray, row: np.ndarray, grad: np.ndarray, rate: float, room: Room) -> None:
    total = w2[row] + np.einsum("ij,ij->i", grad, grad) / np.float32(grad.shape[1])
    w2[row] = total
    grad *= (np.float32(rate) / np.sqrt(total))[:, None]
    new = rows_of(w, row, room.new)
    new -= grad
    w[row] = new


def blocks(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[tuple[pa.Array, pa.RecordBatch]]:
    """Texts of a batch in runs of about size characters, and the rows that they are in."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()):
            held += n
            if held >= size or i == batch.num_rows - 1:
                rows = batch.slice(start, i + 1 - start)
                yield rows.column(column), rows
                start, held = i + 1, 0


def trainer(held, rate: float = RATE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        words = Vocabulary(m["frequent"], m["n"], m["singles"])
        w, b, p = m["weights"].copy(), m["bias"].copy(), m["parts"].copy()
        w2, p2 = np.full(len(w), m["square"], np.float32), np.full(len(p), m["square"], np.float32)
        classes, parts = (of_classes(w), of_classes(w2)), (of_parts(p), of_parts(p2))
        class_room, part_room = Room(CLASSES), Room(PARTS)
        seen = 0
        for texts, _ in blocks(batches, 0):
            kinds, _, classes_of, at, sizes = words.tokens(texts)
            h, cls = kinds[at], classes_of[at]
            back = history(h, sizes)
            rows = class_rows(back)
            for a in range(0, len(at), STEP):
                step(*classes, [x[a : a + STEP] for x in rows], cls[a : a + STEP], rate, b, class_room)
            spelled = np.flatnonzero(cls >= SINGLES)
            rows, y = part_rows([x[spelled] for x in back], cls[spelled], len(parts[0][1])), part_of(h[spelled])
            for a in range(0, len(y), STEP):
                step(*parts, [x[a : a + STEP] for x in rows], y[a : a + STEP], rate, room=part_room)
            seen += len(at)
        if seen:
            task = TaskContext.get().partitionId()
            # what has changed, in half precision
            change = np.concatenate([(x - m[k]).ravel() for x, k in ((w, "weights"), (b, "bias"), (p, "parts"))])
            for i, part in enumerate(np.array_split(change, 64)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([seen], pa.int64()), pa.array([part.astype("<f2").tobytes()])], names=["part", "task", "seen", "change"])

    return run


def average(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of changes by the tokens that they come from."""
    seen = pdf.seen.to_numpy(np.float64)
    total = sum(np.frombuffer(w, "<f2").astype(np.float32) * np.float32(n / seen.sum()) for w, n in zip(pdf.change, seen))
    return pd.DataFrame({"part": [pdf.part.iloc[0]], "task": [pdf.task.iloc[0] // FAN], "seen": [int(seen.sum())], "change": [total.astype("<f2").tobytes()]})


CHANGES = "part int, task int, seen long, change binary"


class Model:
    """Everything that scoring needs beside the counts."""

    def __init__(self, counts: DataFrame, training: DataFrame):
        spark = counts.sparkSession
        self.counts = counts
        top = counts.orderBy(F.col("n").desc(), "token").limit(FREQUENT).toPandas()  # bounded
        end = token_hash(END)
        singles = [t for t in top.token.head(SINGLES) if t != end][: SINGLES - 1]
        self.singles = np.array([*singles, end], np.int64)
        order = top.token.to_numpy().argsort()
        self.frequent, self.n = top.token.to_numpy(np.int64)[order], top.n.to_numpy(np.int64)[order]
        rare = ~F.col("token").isin([int(t) for t in self.singles])
        cell = F.col("spelling") * PARTS + F.col("token").bitwiseAND(F.lit(PARTS - 1)).cast("int")
        by = counts.groupBy(cell.alias("cell")).agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("all_v"), F.sum(F.when(rare, F.col("n"))).alias("n"), F.sum(F.when(rare & (F.col("n") == 1), 1)).alias("once")).toPandas().fillna(0)  # a row a part
        self.total, self.kinds = int(by.all_n.sum()), int(by.all_v.sum())
        self.size, self.unseen = np.zeros(SPELLINGS * PARTS), np.full(SPELLINGS * PARTS, 0.5)
        self.size[by.cell] = by.n
        self.unseen[by.cell] = (by.once + 0.5) / (by.n + 1)
        share = np.zeros(CLASSES)
        known = dict(zip(top.token, top.n))
        share[: len(self.singles)] = [known.get(t, 0) for t in self.singles]
        share[SINGLES:] = self.size.reshape(SPELLINGS, PARTS).sum(1)
        share = (share + 0.1) / (share + 0.1).sum()
        self.weights = np.zeros((SLOTS * ROWS, CLASSES), np.float32)
        self.bias = np.log(share).astype(np.float32)
        part_size = min(MOST_ROWS, max(LEAST_ROWS, 1 << (self.kinds // 4).bit_length()))
        self.parts = np.zeros((SPELLINGS + PART_SLOTS * part_size, PARTS), np.float32)
        inner = self.size.reshape(SPELLINGS, PARTS) + 0.1
        self.parts[:SPELLINGS] = np.log(inner / inner.sum(1, keepdims=True))
        square = 0.1
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-self.total // (ROUNDS * TASK_TOKENS)))  # coalesce() never adds any
        small_batches(training)
        for part in range(ROUNDS if self.total else 0):
            held = spark.sparkContext.broadcast(self.arrays() | {"square": square})
            own = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == part).select("text").coalesce(tasks)
            got, left = own.mapInArrow(trainer(held), CHANGES), tasks
            while left > 1:
                left = -(-left // FAN)
                got = got.groupBy("part", F.floor(F.col("task") / FAN)).applyInPandas(average, CHANGES)
            rows = got.collect()  # the changes, in 64 parts
            if rows:
                flat = np.concatenate([np.frombuffer(r.change, "<f2").astype(np.float32) for r in sorted(rows, key=lambda r: r.part)])
                a, b = self.weights.size, self.weights.size + CLASSES
                self.weights, self.bias, self.parts = self.weights + flat[:a].reshape(-1, CLASSES), self.bias + flat[a:b], self.parts + flat[b:].reshape(-1, PARTS)
            square = square * 4  # later parts refine
            held.unpersist()
            del own, got, rows
            clean(spark)

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("frequent", "n", "singles", "weights", "bias", "parts")}


def log_probability(m: dict, h: np.ndarray, cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 P(class, part | history) of tokens by their hashes and classes, in texts of those sizes."""
    back = history(h, sizes)
    rows, weights, room = class_rows(back), of_classes(m["weights"]), Room(CLASSES)
    out = np.empty(len(h))
    for a in range(0, len(h), STEP):
        out[a : a + STEP] = log_softmax_of(weights, [x[a : a + STEP] for x in rows], cls[a : a + STEP], m["bias"], room)
    spelled, weights, room = np.flatnonzero(cls >= SINGLES), of_parts(m["parts"]), Room(PARTS)
    rows, y = part_rows([x[spelled] for x in back], cls[spelled], len(weights[1])), part_of(h[spelled])
    for a in range(0, len(y), STEP):
        out[spelled[a : a + STEP]] += log_softmax_of(weights, [x[a : a + STEP] for x in rows], y[a : a + STEP], room=room)
    return out / math.log(10)


def scorer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total, kinds = held.value
        words = Vocabulary(m["frequent"], m["n"], m["singles"])
        floor = math.log10(total + 0.1 * (kinds + 1))
        of = pa.struct([("token", pa.int64()), ("cls", pa.int32()), ("times", pa.int32())])
        for texts, batch in blocks(batches, 1):
            kinds_h, kinds_n, kinds_cls, at, sizes = words.tokens(texts)
            n, cls, h = kinds_n[at], kinds_cls[at], kinds_h[at]
            score = log_probability(m, h, cls, sizes)
            known = n > 0
            cell = np.where(cls < SINGLES, 0, (cls - SINGLES) * PARTS + part_of(h))
            inside = np.log10((1 - m["unseen"][cell]) * np.maximum(n, 1) / np.maximum(m["size"][cell], 1))
            score += np.where(known & (cls >= SINGLES), inside, 0.0)
            base = np.where(known, np.log10(np.maximum(n, 0) + 0.1) - floor, 0.0)
            first = np.cumsum(sizes) - sizes
            # the others, each once a text
            left = np.flatnonzero(~known)
            text = np.repeat(np.arange(len(sizes)), sizes)[left]
            pair, times = np.unique(text * len(kinds_h) + at[left], return_counts=True)
            place = pair % len(kinds_h)
            offsets = np.searchsorted(pair, np.arange(len(sizes) + 1) * len(kinds_h)).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(kinds_h[place]), pa.array(kinds_cls[place]), pa.array(times.astype(np.int32))], fields=list(of))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(np.add.reduceat(known, first, dtype=np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first)), pa.ListArray.from_arrays(pa.array(offsets), rare)],
                names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to doc_id, n_tokens, n_known, base_score, score for every row."""
    m = model.arrays() | {"unseen": model.unseen, "size": model.size}
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast((m, model.total, model.kinds))
    got = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scorer(held), "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<token:long,cls:int,times:int>>")
    got = cut(got.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = got.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(model.counts.select("token", "n"), "token", "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    b = F.greatest(F.col("cls") - SINGLES, F.lit(0)) * PARTS + F.col("token").bitwiseAND(F.lit(PARTS - 1)).cast("int")
    unseen, size = (F.get(F.array(*[F.lit(float(x)) for x in xs]), b) for xs in (model.unseen, np.maximum(model.size, 1)))
    # an unseen token with a class of its own (the end token, without training) has all of it
    inside = F.log10(F.when(F.col("cls") < SINGLES, 1.0).when(n > 0, (1 - unseen) * n / size).otherwise(unseen))
    base = F.log10((n + 0.1) / F.lit(model.total + 0.1 * (model.kinds + 1)))
    rare = rare.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * base).alias("rare_base"), F.sum(F.col("times") * inside).alias("rare_score"))
    out = got.drop("rare").join(rare, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + zero("known")).cast("long").alias("n_known"), (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("score") + zero("rare_score")).alias("score"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts under the model of those outside fold 0 of 10, and under counts alone."""
    docs = table(spark, sf_dir, "documents")
    training = docs.where(remainder(F.col("doc_id"), 10) != 0)
    model = Model(cut(count_tokens(training), "counts"), training)
    got = score(docs, model)
    return got.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
