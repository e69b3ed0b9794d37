"""Packing by power-of-two decomposition.

Each document is tokenized and cut into pieces whose lengths are powers of two,
at most ``LONGEST``: as many of the longest as fit, then the binary digits of the
rest, largest first.  A piece is a training sequence by itself, so no sequence
crosses documents and none is padded; sequences of equal length form a bucket,
from which batches are drawn.  The low four bits of sequence_id are the bucket,
the base-two logarithm of the length.

All work is one narrow stage over the scan: nothing is shuffled.  Words that
white space separates are tokenized on their own (the tokenizer's pieces never
cross white space), so each distinct word is encoded once per task, or per tasks in a
row; the table of encoded words is emptied when it reaches ``CACHED_WORDS``, and
gone ``KEEP`` seconds after a worker's last task.

Edge cases: null and empty texts are the end token alone, one piece of length 1;
repeated rows are packed each on their own; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import threading
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

LONGEST = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 600_000
#: Seconds for which a worker holds an encoder that no task uses.
KEEP = 3.0
#: Bytes of token ids in an output batch.
BATCH_BYTES = 8_000_000
#: What only special tokens hold, and punctuation at the end of ASCII letters and digits (without the apostrophe of contractions).
SPECIAL = b"<|"
TRAILING = re.compile(rb"(?<=[a-z0-9])[^\x00-\x20'>a-z0-9\x7f-\xff]+(?=[\x20\x09-\x0D]|\Z)")
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Texts to token ids, word by word."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        known = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(known.values()) + 1, bool)
        self.left = 0.0
        self.ends_word[[i for t, i in known.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 15, np.int64)
        self.used = 0

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        # a word of letters is one piece to the tokenizer, whose last token alone ends a word: many go as one text
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in letters])], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends_word[ids]) + 1
        if len(last) != len(letters):
            letters, ids, last = [], ids[:0], last[:0]
        other = sorted(set(range(len(texts))).difference(letters))
        more = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)]
        counts = np.append(np.diff(last, prepend=0), np.fromiter(map(len, more), np.int64, len(more))).astype(np.int64)
        ids = np.append(ids, np.fromiter((i for x in more for i in x), np.uint32)).astype(np.uint32)
        n, total = len(self.index), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + total] = ids
        self.start[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(counts)
        self.used += total
        self.index.update(zip([words[i] for i in (*letters, *other)], range(n, n + len(words))))

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        """Parts of a text that the tokenizer treats alone, ASCII letters as it lowers them, and punctuation at their end by itself."""
        data = (text or "").encode()
        if SPECIAL in data:
            return data.split()
        return TRAILING.sub(rb" \g<0>", data.lower()).split()

    def encode(self, texts: list) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.index) > CACHED_WORDS:
            self.clear()
        parts = [self.words(t) for t in texts]
        flat = [w for p in parts for w in p]
        if not flat:
            return [np.zeros(0, np.uint32) for _ in texts]
        if new := set(flat).difference(self.index):
            self.learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        first = self.start[at]
        counts = self.start[at + 1] - first
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(first - ends + counts, counts) + np.arange(ends[-1])]
        upto = np.append(0, ends)[np.cumsum([len(p) for p in parts])]
        return np.split(ids, upto[:-1])


#: The encoder that the last task of this worker left, until KEEP seconds are over.
_LEFT: list[tuple[str, Encoder]] = []
_LOCK = threading.Lock()


def take_encoder(vocabulary: str) -> Encoder:
    """The encoder that a task has just left, with its table of words, or a new one."""
    with _LOCK:
        left = [e for v, e in _LEFT if v == vocabulary]
        _LEFT.clear()
    return left[0] if left else Encoder(vocabulary)


def leave_encoder(vocabulary: str, encoder: Encoder) -> None:
    """Leave the encoder to a task that follows soon; after KEEP seconds its memory is free for other stages."""
    encoder.left = time.monotonic()
    with _LOCK:
        _LEFT[:] = [(vocabulary, encoder)]
    held = threading.Timer(KEEP, drop_encoder, [encoder])
    held.daemon = True
    held.start()


def drop_encoder(encoder: Encoder) -> None:
    with _LOCK:
        if _LEFT and _LEFT[0][1] is encoder and time.monotonic() - encoder.left >= KEEP * 0.9:
            _LEFT.clear()


def blocks(texts: list, size: int = 1 << 20) -> Iterator[list[int]]:
    """Places of texts in runs of about size characters."""
    some, held = [], 0
    for i, t in enumerate(texts):
        some.append(i)
        held += len(t or "")
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def packer(vocabulary: str, end: int, longest: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = take_encoder(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
        out: list[list] = [[] for _ in schema]
        held = 0
        for batch in batches:
            for rows in blocks(batch.column(1).to_pylist()):
                for i, ids in zip(rows, encoder.encode([batch.column(1)[i].as_py() for i in rows])):
                    data = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                    doc_id, total, at = batch.column(0)[i].as_py(), len(data) // 4, 0
                    for length in cuts(total, longest):
                        for column, value in zip(out, (doc_id, at, length, data[4 * at : 4 * (at + length)], total)):
                            column.append(value)
                        at += length
                    held += len(data)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                        out, held = [[] for _ in schema], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        leave_encoder(vocabulary, encoder)

    return pack


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = END, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text) to pieces: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, bucket."""
    fn = packer(vocabulary or default_vocabulary(), end, longest)
    small_batches(docs)
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fn, PIECES)
    bucket = F.log2("length").cast("int")
    sequence = F.monotonically_increasing_id() * 16 + bucket
    return pieces.select("*", sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the sequences with a folder for each length, from which batches of equal lengths are read."""
    pieces.write.partitionBy("bucket").parquet(path)


def op6_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all pieces of all documents."""
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
