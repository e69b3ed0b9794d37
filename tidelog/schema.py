"""Types, limits, options and errors of the log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Codes of an entry's kind; 0 is not a kind.
PUT, DELETE, VECTOR = 1, 2, 3
# Limits of a key and of a value, in bytes.
MAX_KEY, MAX_VALUE = 65_536, 67_108_864

COSINE, EUCLIDEAN_SQUARED, INNER_PRODUCT = "cosine", "euclidean_squared", "inner_product"
METRICS = (COSINE, EUCLIDEAN_SQUARED, INNER_PRODUCT)

LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("kind", T.ByteType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


class StoreError(Exception):
    """Any error of a store."""


class StoreIOError(StoreError):
    """The file system failed."""


class Corruption(StoreError):
    """Stored bytes are not what was written."""


class InvalidArgument(StoreError):
    """The caller asked for something that cannot be."""


class Closed(StoreError):
    """The store has been closed."""


@dataclass
class VectorOptions:
    """metric is fixed when the store is made; dim 0 means that the first vector sets it."""

    metric: str = COSINE
    dim: int = 0
    seed: int = 42
    cells: int = 0  # 0: about the square root of the count of vectors
    probes: int = 0  # 0: an eighth of the cells
    train_rows: int = 100_000

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise InvalidArgument(f"unknown metric {self.metric!r}")


@dataclass
class StoreOptions:
    path: str
    memtable_max_size_bytes: int = 4 * 1024 * 1024
    l0_compaction_trigger: int = 4
    bloom_bits_per_key: int = 10
    vectors: VectorOptions = field(default_factory=VectorOptions)
