"""The store: one log of keys with values or vectors, its maintenance and its queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance
from ..functions.codec import from_bytes, to_bytes, vector_bytes
from ..operators import knn, merge
from ..operators.ivf import IvfIndex
from ..schema import COSINE, DELETE, LOG, MAX_KEY, MAX_VALUE, PUT, VECTOR, Closed, InvalidArgument, StoreOptions
from .files import Files
from .runs import INDEX_NAME, Manifest, Runs
from .wal import Wal

MANIFEST = "MANIFEST.json"


class Store:
    """Single writes go to a small log and a buffer that is bounded by
    memtable_max_size_bytes; batches become runs at once.  One writer at a time."""

    def __init__(self, spark: SparkSession, options: StoreOptions):
        self.spark, self.options = spark, options
        self.files = Files(spark, options.path)
        self.files.make_dirs(options.path)
        self.runs = Runs(spark, self.files, options.bloom_bits_per_key)
        self.closed = False
        at = f"{options.path.rstrip('/')}/{MANIFEST}"
        self._manifest_path = at
        asked = options.vectors
        if self.files.exists(at):
            self.manifest = Manifest.decode(self.files.read(at))
            if self.manifest.metric != asked.metric:
                raise InvalidArgument(f"the store's metric is {self.manifest.metric}, not {asked.metric}")
            if asked.dim and self.manifest.dim and asked.dim != self.manifest.dim:
                raise InvalidArgument(f"the store's vectors have {self.manifest.dim} dimensions, not {asked.dim}")
        else:
            self.manifest = Manifest(metric=asked.metric, dim=asked.dim)
            self._commit()
        self.manifest.dim = self.manifest.dim or asked.dim
        self.wal = Wal(self.files)
        self.pending: dict[bytes, tuple[int, int, bytes | None]] = {}
        self.pending_bytes = 0
        first = self.manifest.next_seq
        for seq, kind, key, value in self.wal.replay():
            if seq >= first:  # older ones are in a run already
                self._apply(seq, kind, key, value)
                self.manifest.next_seq = max(self.manifest.next_seq, seq + 1)
                if kind == VECTOR:
                    self.manifest.dim = self.manifest.dim or len(value) // 4

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Store:
        return cls(spark, StoreOptions(path, **options))

    # writes

    def put(self, key: bytes, value: bytes) -> None:
        self._write(PUT, key, value)

    def delete(self, key: bytes) -> None:
        self._write(DELETE, key, b"")

    def put_indexed(self, key: bytes, embedding) -> None:
        """Everything that can be refused is refused before anything is written."""
        self._open()
        v = np.asarray(embedding, np.float32)
        if v.ndim != 1 or not len(v):
            raise InvalidArgument("an embedding has at least one dimension")
        if not np.isfinite(v).all():
            raise InvalidArgument("an embedding has finite components")
        if self.manifest.dim and len(v) != self.manifest.dim:
            raise InvalidArgument(f"the store's vectors have {self.manifest.dim} dimensions, not {len(v)}")
        if self.manifest.metric == COSINE:
            with np.errstate(over="ignore"):
                n = np.sqrt((v * v).sum(dtype=np.float32))
            if n == 0 or not np.isfinite(n):
                raise InvalidArgument("a cosine vector has a length that is finite and not zero")
        self.manifest.dim = len(v)
        self._write(VECTOR, key, to_bytes(v))

    def put_many(self, rows: DataFrame, stream: str | None = None, batch_id: int = -1) -> None:
        """A batch as one run: (key, value), (key, embedding) or (key, kind, value, embedding).

        Rows of one key need an ``ordinal`` that puts them in order.  The rows are
        read once: what is checked is what is stored.  With a stream's name, a
        batch whose number is not above the last one stored is passed over; the
        number is committed with the run.
        """
        self._open()
        if stream is not None and batch_id <= self.manifest.streams.get(stream, -1):
            return
        if self.pending:
            self.flush()
        have = set(rows.columns)
        kind = F.col("kind") if "kind" in have else F.lit(VECTOR if "embedding" in have and "value" not in have else PUT)
        value = F.col("value").cast("binary") if "value" in have else F.lit(None).cast("binary")
        embedding = F.col("embedding").cast("array<float>") if "embedding" in have else F.lit(None).cast("array<float>")
        ordinal = F.col("ordinal").cast("long") if "ordinal" in have else F.lit(0).cast("long")
        batch = rows.select(F.col("key").cast("binary").alias("key"), kind.cast("byte").alias("kind"), value.alias("value"), embedding.alias("embedding"), ordinal.alias("ordinal"))
        staged = f"{self.files.root}/_tmp/batch"
        self.files.remove(staged)
        batch.write.parquet(staged)
        batch = self.spark.read.schema(batch.schema).parquet(staged)
        vector = F.col("kind") == VECTOR
        fault = (
            F.when(F.col("key").isNull() | ~F.length("key").between(1, MAX_KEY), "key length")
            .when(~F.col("kind").isin(PUT, DELETE, VECTOR) | F.col("kind").isNull(), "kind")
            .when((F.col("kind") == PUT) & F.col("value").isNull(), "value")
            .when(F.length("value") > MAX_VALUE, "value length")
            .when(vector, distance.problem(F.col("embedding"), self.manifest.metric, self.manifest.dim))
        )
        checks = batch.select(fault.alias("fault"), F.when(vector, F.size("embedding")).alias("dim"), "ordinal")
        got = checks.agg(F.max("fault").alias("fault"), F.min("dim").alias("a"), F.max("dim").alias("b"), F.max("ordinal").alias("o"), F.count(F.lit(1)).alias("n")).first()
        if got.fault:
            raise InvalidArgument(f"the batch is refused: {got.fault}")
        if got.a != got.b:
            raise InvalidArgument("the batch is refused: vectors of several dimensions")
        mark = {stream: batch_id} if stream is not None else {}
        if not got.n:
            if mark:
                self.manifest.streams |= mark
                self._commit()
            return
        same = batch.groupBy("key", "ordinal").count().where("count > 1").limit(1).collect()
        if same:
            raise InvalidArgument("the batch repeats a key; give an ordinal column that orders its rows")
        clean = lambda c, on: F.when(on, F.col(c)).alias(c)
        base = self.manifest.next_seq
        log = batch.select((F.lit(base) + F.col("ordinal")).alias("seq"), "key", "kind", clean("value", F.col("kind") == PUT), clean("embedding", vector))
        self.manifest.streams |= mark
        self._add_run(merge.latest(log), got.o + 1, got.b or 0)
        self.files.remove(staged)

    def _write(self, kind: int, key: bytes, value: bytes) -> None:
        self._open()
        seq = self.manifest.next_seq
        self.wal.append(seq, kind, bytes(key), bytes(value))  # durable before it is visible
        self._apply(seq, kind, bytes(key), bytes(value))
        self.manifest.next_seq = seq + 1
        if self.pending_bytes >= self.options.memtable_max_size_bytes:
            self.flush()

    def _apply(self, seq: int, kind: int, key: bytes, value: bytes) -> None:
        old = self.pending.get(key)
        self.pending_bytes += len(value) - len(old[2] or b"") if old else len(key) + len(value)
        self.pending[key] = (seq, kind, value)

    # maintenance

    def flush(self) -> None:
        """The buffer becomes a run; then its log files go."""
        self._open()
        if not self.pending:
            return
        self._add_run(self._pending_rows(), 0)
        self.pending, self.pending_bytes = {}, 0
        self.wal.drop_before(self.manifest.next_seq)

    def _add_run(self, rows: DataFrame, sequences: int, dim: int = 0) -> None:
        """One commit for the run and all that comes with it."""
        run = self.runs.write(rows, 0, self.manifest.next_run_id)
        self.manifest.dim = self.manifest.dim or dim
        self.manifest.runs.insert(0, run)
        self.manifest.next_run_id += 1
        self.manifest.next_seq += sequences
        self._commit()
        if self.level_counts()[0] >= self.options.l0_compaction_trigger:
            self.compact()

    def compact(self) -> None:
        """All runs into one of level 1, without tombstones; the old ones go after the manifest has changed."""
        self._open()
        old = list(self.manifest.runs)
        if not old:
            return
        run = self.runs.write(merge.compacted(self.runs.read(old)), 1, self.manifest.next_run_id)
        self.manifest.runs = [run] if run.rows else []
        self.manifest.next_run_id += 1
        indexed, self.manifest.index = self.manifest.index, None  # tombstones that masked its rows are gone
        self._commit()
        self.runs.vacuum(self.manifest)
        if indexed:
            self.build_index()

    def build_index(self) -> None:
        """A new generation of the approximate index, over all that is live now."""
        self._open()
        self.flush()
        v = self.options.vectors
        name = INDEX_NAME.format(id=self.manifest.next_run_id)
        path = f"{self.files.root}/index/{name}"
        self.files.remove(path)
        seq = self.manifest.next_seq - 1
        index = IvfIndex.build(merge.live_vectors(self.log()), path, seq, self.manifest.metric, v.cells, v.seed, v.train_rows)
        self.manifest.index = {"name": name, "centroids": index.centroids.tolist(), "indexed_seq": seq, "files": self.files.sizes(path)}
        self.manifest.next_run_id += 1
        self._commit()
        for n in self.files.names(f"{self.files.root}/index"):
            if n != name:
                self.files.remove(f"{self.files.root}/index/{n}")

    def vacuum(self) -> list[str]:
        self._open()
        return self.runs.vacuum(self.manifest)

    def _commit(self) -> None:
        self.files.write(self._manifest_path, self.manifest.encode())

    # reads

    def _pending_rows(self) -> DataFrame:
        rows = [(s, bytearray(k), kind, bytearray(v) if kind == PUT else None, from_bytes(v) if kind == VECTOR else None) for k, (s, kind, v) in self.pending.items()]
        return self.spark.createDataFrame(rows, LOG)

    def log(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All entries of the buffer and of all runs, or of the runs that may hold keys between two."""
        self._open()
        rows = self.runs.read([r for r in self.manifest.runs if r.may_hold(low, high)])
        return rows.unionByName(self._pending_rows()) if self.pending else rows

    def live(self) -> DataFrame:
        return merge.live(self.log())

    def live_vectors(self) -> DataFrame:
        return merge.live_vectors(self.log())

    def get(self, key: bytes) -> bytes | None:
        """The newest value; a vector as its bytes; None where there is none."""
        self._open()
        if key in self.pending:
            _, kind, value = self.pending[key]
            return None if kind == DELETE else value
        held = [r for r in self.manifest.runs if r.may_hold(key, key)]
        if not held:
            return None
        got = merge.get(self.runs.read(held), F.lit(bytearray(key))).collect()
        if not got:
            return None
        return to_bytes(got[0].embedding) if got[0].kind == VECTOR else bytes(got[0].value)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key) with value: null where it is absent, a vector's bytes where it is one."""
        got = merge.multi_get(self.log(), keys)
        return got.select("key", F.coalesce("value", vector_bytes("embedding")).alias("value"))

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """Live entries with low <= key < high, ascending."""
        rows = self.log(low, high)
        if low is not None:
            rows = rows.where(F.col("key") >= F.lit(bytearray(low)))
        if high is not None:
            rows = rows.where(F.col("key") < F.lit(bytearray(high)))
        return merge.live(rows).orderBy("key")

    def nearest(self, query, k: int, approximate: bool = False) -> list[tuple[bytes, float]]:
        return self.nearest_filtered(query, k, None, approximate)

    def nearest_filtered(self, query, k: int, predicate: Column | Callable[[bytes], bool] | None, approximate: bool = False) -> list[tuple[bytes, float]]:
        """(key, distance) of the k nearest whose key passes, ascending; all that pass where they are fewer."""
        self._open()
        if k <= 0 or not self.manifest.dim:
            return []
        v = np.asarray(query, np.float32)
        problem = None
        if len(v) != self.manifest.dim:
            problem = f"the store's vectors have {self.manifest.dim} dimensions, not {len(v)}"
        elif not np.isfinite(v).all() or self.manifest.metric == COSINE and not v.any():
            problem = "a query has finite components, and a cosine query a length"
        if problem:
            if self.vector_count() == 0:  # an empty index answers any query
                return []
            raise InvalidArgument(problem)
        if predicate is not None and not isinstance(predicate, Column):
            predicate = knn.predicate_of(predicate)
        index = self._index() if approximate else None
        if index:
            found = index.search(self.log(), v, k, self.options.vectors.probes, predicate)
        else:
            found = knn.nearest(self.live_vectors(), v, k, self.manifest.metric, predicate)
        return [(bytes(r.key), r.distance) for r in found.collect()]

    def _index(self) -> IvfIndex | None:
        """The index generation, or None where it is missing or damaged; the log is the truth then."""
        i = self.manifest.index
        path = f"{self.files.root}/index/{i['name']}" if i else ""
        if not i or not self.files.exists(f"{path}/_SUCCESS") or self.files.sizes(path) != i.get("files"):
            return None
        return IvfIndex(f"{self.files.root}/index/{i['name']}", np.array(i["centroids"]), self.manifest.metric, i["indexed_seq"])

    def knn_join(self, queries: DataFrame, k: int) -> DataFrame:
        return knn.knn_join(self.live_vectors(), queries, k, self.manifest.metric)

    # counters

    @property
    def path(self) -> str:
        return self.options.path

    def level_counts(self) -> tuple[int, int]:
        return sum(r.level == 0 for r in self.manifest.runs), sum(r.level == 1 for r in self.manifest.runs)

    def run_count(self) -> int:
        return len(self.manifest.runs)

    def pending_len(self) -> int:
        return len(self.pending)

    def vector_count(self) -> int:
        return self.live_vectors().count()

    @property
    def dim(self) -> int:
        """Dimensions of the vectors; 0 before the first."""
        return self.manifest.dim

    @property
    def metric(self) -> str:
        return self.manifest.metric

    def vector_count_with_deleted(self) -> int:
        """Keys that ever had a vector that the runs and the buffer still hold, live or not."""
        return self.log().where(F.col("kind") == VECTOR).select("key").distinct().count()

    def is_deleted(self, key: bytes) -> bool:
        """Whether the key had a vector that a delete or a plain put has since removed, and no compaction dropped."""
        own = self.log(key, key).where(F.col("key") == F.lit(bytearray(key)))
        got = own.agg(F.max(F.col("kind") == VECTOR).alias("had"), F.max_by("kind", "seq").alias("kind")).first()
        return bool(got.had) and got.kind != VECTOR

    def close(self) -> None:
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise Closed("the store is closed")
