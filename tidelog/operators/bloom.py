"""A Bloom filter over keys, as expressions and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Corruption, InvalidArgument

#: Bytes of a filter that is sent to tasks or encoded.
HELD_BYTES = 64_000_000


def shape(expected_keys: int, bits_per_key: int = 10) -> tuple[int, int]:
    """Bits and hashes for so many keys."""
    return max(64, expected_keys * bits_per_key), max(1, min(30, bits_per_key * 69 // 100))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """Places of a key's bits, by double hashing."""
    h1, h2 = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    # sums wrap; keep them small enough not to
    a, b = F.pmod(h1, F.lit(bits)), F.pmod(h2, F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)))


@dataclass
class Bloom:
    """bits: (word, bits) of the words of 64 bits that are not zero; it may be as large as the keys ask."""

    words: DataFrame
    bit_count: int
    hash_count: int

    @classmethod
    def build(cls, keys: DataFrame, expected_keys: int, bits_per_key: int = 10) -> Bloom:
        m, k = shape(expected_keys, bits_per_key)
        at = keys.select(F.explode(positions(F.col("key"), m, k)).alias("p"))
        word = F.floor(F.col("p") / 64).cast("long")
        words = at.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        return cls(words, m, k)

    def probe(self, keys: DataFrame) -> DataFrame:
        """keys with maybe: false where the key was never inserted for certain.

        A filter of at most HELD_BYTES goes to every task, which looks bits up; a
        larger one is joined by word.
        """
        if self.hash_count < 1:
            raise InvalidArgument("a filter has at least one hash")
        if self.bit_count // 8 > HELD_BYTES:
            return self._joined(keys)
        words = np.zeros(-(-self.bit_count // 64), np.int64)
        got = self.words.toPandas()  # as many rows as the filter has words, at most
        words[got["word"].to_numpy()] = got["bits"].to_numpy()
        held = keys.sparkSession.sparkContext.broadcast(words.view(np.uint64))

        @F.pandas_udf("boolean")
        def look_up(at: pd.Series) -> pd.Series:
            if not len(at):
                return pd.Series([], dtype=bool)
            p = np.stack(at.to_numpy())
            return pd.Series(((held.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(1).astype(bool))

        return keys.withColumn("maybe", look_up(positions(F.col("key"), self.bit_count, self.hash_count)))

    def _joined(self, keys: DataFrame) -> DataFrame:
        asked = keys.select("key").distinct().select("key", F.explode(positions(F.col("key"), self.bit_count, self.hash_count)).alias("p"))
        asked = asked.select("key", F.floor(F.col("p") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
        seen = asked.join(self.words, "word", "left").groupBy("key").agg(F.min(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).alias("maybe"))
        return keys.join(seen, "key")

    def encode(self) -> tuple[bytes, int, int]:
        """The filter as bytes with a checksum, where it has at most HELD_BYTES; a larger one is kept as its table of words."""
        if self.bit_count // 8 > HELD_BYTES:
            raise InvalidArgument(f"a filter of {self.bit_count // 8} bytes; write its words as a table")
        import struct
        import zlib

        data = bytearray(-(-self.bit_count // 64) * 8)
        for r in self.words.collect():
            struct.pack_into("<q", data, 8 * r.word, r.bits)
        head = struct.pack("<QI", self.bit_count, self.hash_count) + bytes(data)
        return struct.pack("<I", zlib.crc32(head)) + head, self.bit_count, self.hash_count

    @classmethod
    def decode(cls, spark, data: bytes) -> Bloom:
        import struct
        import zlib

        if len(data) < 16 or zlib.crc32(data[4:]) != struct.unpack_from("<I", data)[0]:
            raise Corruption("checksum of the filter does not match")
        m, k = struct.unpack_from("<QI", data, 4)
        if k < 1:
            raise InvalidArgument("a filter has at least one hash")
        if len(data) != 16 + -(-m // 64) * 8:
            raise Corruption("the filter's size does not match its bits")
        values = struct.unpack_from(f"<{(len(data) - 16) // 8}q", data, 16)
        return cls(spark.createDataFrame([(i, v) for i, v in enumerate(values) if v], "word long, bits long"), m, k)
