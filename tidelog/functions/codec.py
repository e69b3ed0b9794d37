"""Byte forms: vectors as little-endian 32-bit floats, log records with a checksum.

A record is crc32 of the rest, kind, key length, value length, key, value; the
integers are little-endian, of 4, 1, 4 and 4 bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DELETE, MAX_KEY, MAX_VALUE, PUT, VECTOR, Corruption, InvalidArgument

HEAD = struct.Struct("<IBII")


def to_bytes(vector) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def from_bytes(data: bytes) -> list[float]:
    if len(data) % 4:
        raise Corruption(f"{len(data)} bytes are no vector of 32-bit floats")
    return np.frombuffer(data, "<f4").tolist()


def vector_bytes(vector: str | Column) -> Column:
    """Byte form of a column of vectors, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else to_bytes(x))

    return run(vector)


def bytes_vector(data: str | Column) -> Column:
    """Vectors of a column of byte forms."""

    @F.pandas_udf("array<float>")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else from_bytes(x))

    return run(data)


def encode(kind: int, key: bytes, value: bytes = b"") -> bytes:
    if kind not in (PUT, DELETE, VECTOR):
        raise InvalidArgument(f"no such kind: {kind}")
    if not 1 <= len(key) <= MAX_KEY:
        raise InvalidArgument(f"a key has 1 to {MAX_KEY} bytes, not {len(key)}")
    if len(value) > MAX_VALUE:
        raise InvalidArgument(f"a value has at most {MAX_VALUE} bytes, not {len(value)}")
    if kind == DELETE and value:
        raise InvalidArgument("a delete has no value")
    rest = HEAD.pack(0, kind, len(key), len(value))[4:] + key + value
    return struct.pack("<I", zlib.crc32(rest)) + rest


def decode_all(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes, bytes]]:
    """Records of a log in order.  A tail that is cut short ends it; damage before the tail raises."""
    while at < len(data):
        if len(data) - at < HEAD.size:
            return
        crc, kind, n_key, n_value = HEAD.unpack_from(data, at)
        end = at + HEAD.size + n_key + n_value
        if not 1 <= n_key <= MAX_KEY or n_value > MAX_VALUE or kind not in (PUT, DELETE, VECTOR):
            raise Corruption(f"bad record head at byte {at}")
        if kind == DELETE and n_value:
            raise Corruption(f"the delete at byte {at} has a value")
        if end > len(data):
            return
        if zlib.crc32(data[at + 4 : end]) != crc:
            raise Corruption(f"checksum of the record at byte {at} does not match")
        key = data[at + HEAD.size : at + HEAD.size + n_key]
        yield kind, key, data[at + HEAD.size + n_key : end]
        at = end


def record_crc(kind: Column, key: Column, value: Column) -> Column:
    """Checksum of a record as encode() writes it, in the JVM: over kind, both lengths, key and value."""
    value = F.coalesce(value, F.lit(b""))

    def little(n: Column) -> Column:  # four bytes, least first
        digits = F.lpad(F.hex(n.cast("long")), 8, "0")
        return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))

    return F.crc32(F.concat(F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), little(F.octet_length(key)), little(F.octet_length(value)), key, value))


def record(kind: Column, key: Column, value: Column) -> Column:
    """Byte form of log records, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(k: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([encode(int(a), bytes(b), bytes(c or b"")) for a, b, c in zip(k, key, value)])

    return run(kind, key, value)


def record_parts(data: Column) -> Column:
    """(kind, key, value) of byte forms of one record each; damage raises."""

    @F.pandas_udf("kind int, key binary, value binary")
    def run(data: pd.Series) -> pd.DataFrame:
        got = []
        for x in data:
            each = list(decode_all(bytes(x)))
            if len(each) != 1:
                raise Corruption(f"{len(each)} records where one is due")
            got += each
        return pd.DataFrame(got, columns=["kind", "key", "value"])

    return run(data)
