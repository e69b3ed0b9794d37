"""Runs: immutable Parquet folders, one for each flush or compaction, listed in a manifest.

Ids in names are padded to 20 digits, so names of any 64-bit id sort as the ids;
names with fewer digits are read as well.  The manifest has each run's key bounds,
by which reads of a key or a range leave out runs; within a run, Parquet's
statistics and Bloom filters leave out row groups.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LOG, Corruption
from .files import Files

# Names of a run and of an index generation.
RUN_NAME = "sst_L{level}_{id:020d}.sst"
RUN_PATTERN = r"sst_L(\d+)_(\d+)\.sst$"
INDEX_NAME = "ivf_{id:020d}"


def run_name(level: int, run_id: int) -> str:
    return RUN_NAME.format(level=level, id=run_id)


def parse_run(name: str) -> tuple[int, int] | None:
    m = re.search(RUN_PATTERN, name)
    return (int(m[1]), int(m[2])) if m else None


def parse_names(names: DataFrame) -> DataFrame:
    """(name) with level and run_id; null where the name is no run's."""
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(name, '{RUN_PATTERN}', {i}), '') as bigint)".replace("\\", "\\\\"))
    return names.withColumn("level", part(1)).withColumn("run_id", part(2))


def reconcile(catalog: DataFrame) -> DataFrame:
    """(level, run_id) with keep: of level 1 the newest run alone, of level 0 those newer than it.

    What an interrupted compaction left behind: its inputs beside its output.
    """
    newest = F.max(F.when(F.col("level") == 1, F.col("run_id")))
    bound = catalog.agg(newest.alias("l1")).select(F.coalesce("l1", F.lit(-1)).alias("l1"))
    both = catalog.join(F.broadcast(bound))  # one row
    keep = F.when(F.col("level") == 1, F.col("run_id") == F.col("l1")).otherwise(F.col("run_id") > F.col("l1"))
    return both.select(*catalog.columns, keep.alias("keep"))


@dataclass
class Run:
    """low and high: the least and greatest key, as hex digits; None in a run without rows."""

    id: int
    level: int
    name: str
    low: str | None = None
    high: str | None = None
    rows: int = 0

    def may_hold(self, low: bytes | None, high: bytes | None) -> bool:
        """Whether a key between both, themselves included, may be in the run."""
        if self.low is None:
            return False
        return (low is None or low.hex() <= self.high) and (high is None or self.low <= high.hex())


@dataclass
class Manifest:
    """What a store consists of.  Replacing its file is the commit of every change."""

    next_run_id: int = 0
    next_seq: int = 0
    metric: str = ""
    dim: int = 0
    runs: list[Run] = field(default_factory=list)
    index: dict | None = None
    #: The last micro-batch of each stream that is in the runs.
    streams: dict[str, int] = field(default_factory=dict)

    def encode(self) -> bytes:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"crc32": zlib.crc32(body.encode()), "body": body}).encode()

    @classmethod
    def decode(cls, data: bytes) -> Manifest:
        try:
            outer = json.loads(data)
            body = outer["body"]
            if zlib.crc32(body.encode()) != outer["crc32"]:
                raise Corruption("checksum of the manifest does not match")
            got = json.loads(body)
            got["runs"] = [Run(**r) for r in got["runs"]]
            return cls(**got)
        except (ValueError, KeyError, TypeError) as e:
            raise Corruption(f"the manifest cannot be read: {e}") from e


class Runs:
    """The runs of one store."""

    def __init__(self, spark: SparkSession, files: Files, bloom_bits_per_key: int = 10):
        self.spark, self.files, self.bits = spark, files, bloom_bits_per_key
        self.root = f"{files.root}/runs"

    def path(self, run: Run) -> str:
        return f"{self.root}/{run.name}"

    def read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], LOG)
        missing = [r.name for r in runs if not self.files.exists(f"{self.path(r)}/_SUCCESS")]
        if missing:
            raise Corruption(f"runs that the manifest lists are not there: {', '.join(missing)}")
        return self.spark.read.schema(LOG).parquet(*[self.path(r) for r in runs])

    def write(self, rows: DataFrame, level: int, run_id: int) -> Run:
        """A run sorted by key, with row-group statistics and a Bloom filter on the key; renamed into place when whole."""
        run = Run(run_id, level, run_name(level, run_id))
        staged = f"{self.files.root}/_tmp/{run.name}"
        self.files.remove(staged)
        writer = rows.repartitionByRange("key").sortWithinPartitions("key").write
        if self.bits > 0:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(0.6185**self.bits))
        writer.parquet(staged)
        self.files.make_dirs(self.root)
        self.files.remove(self.path(run))
        self.files.rename(staged, self.path(run))
        bounds = self.read([run]).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows")).first()
        run.rows = bounds["rows"]
        if run.rows:
            run.low, run.high = bytes(bounds["low"]).hex(), bytes(bounds["high"]).hex()
        return run

    def vacuum(self, manifest: Manifest) -> list[str]:
        """Remove runs that the manifest does not list, and what was being staged."""
        listed = {r.name for r in manifest.runs}
        gone = [n for n in self.files.names(self.root) if n not in listed]
        for n in gone:
            self.files.remove(f"{self.root}/{n}")
        self.files.remove(f"{self.files.root}/_tmp")
        return gone
