"""The store end to end, against a dictionary and the cases of the fixtures."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions.codec import from_bytes, to_bytes
from tidelog.schema import Closed, Corruption, InvalidArgument, StoreOptions, VectorOptions
from tidelog.sources.store import Store


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def test_basic_flow_and_reopen(spark, path):
    s = Store.open(spark, path)
    s.put(b"key1", b"value1")
    s.put(b"key2", b"value2")
    s.delete(b"key1")
    s.delete(b"never seen")
    s.put(b"empty", b"")
    assert s.get(b"key1") is None and s.get(b"key2") == b"value2" and s.get(b"empty") == b""
    s.close()
    s.close()
    for call in (lambda: s.put(b"a", b"b"), lambda: s.get(b"a"), lambda: s.delete(b"a"), s.flush, lambda: s.nearest([1.0], 1)):
        with pytest.raises(Closed):
            call()
    s = Store.open(spark, path)
    assert s.get(b"key1") is None and s.get(b"key2") == b"value2" and s.get(b"empty") == b""
    s.put(b"key1", b"again")
    assert s.get(b"key1") == b"again"


def test_flush_shadowing_and_counters(spark, path):
    s = Store.open(spark, path)
    s.flush()
    assert s.run_count() == 0
    s.put(b"k", b"old")
    s.flush()
    assert s.level_counts() == (1, 0) and s.pending_len() == 0
    s.put(b"k", b"new")
    assert s.get(b"k") == b"new" and s.pending_len() == 1
    s.flush()
    assert s.get(b"k") == b"new" and s.level_counts() == (2, 0)
    s.delete(b"k")
    assert s.get(b"k") is None
    assert Store.open(spark, path).get(b"k") is None


@pytest.mark.parametrize("trigger, writes, counts, want", [(2, [("k", "v"), ("k", None)], (0, 0), {"k": None}), (3, [("k", "1"), ("k", "2"), ("k", "3")], (0, 1), {"k": "3"}), (4, [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], (0, 1), {"a": "1", "d": "4"})])
def test_compaction(spark, path, trigger, writes, counts, want):
    s = Store(spark, StoreOptions(path, memtable_max_size_bytes=1, l0_compaction_trigger=trigger))
    for k, v in writes:
        s.put(k.encode(), v.encode()) if v else s.delete(k.encode())
    assert s.level_counts() == counts
    s = Store.open(spark, path)
    for k, v in want.items():
        assert s.get(k.encode()) == (v.encode() if v else None)


def test_batches_need_an_order(spark, path):
    s = Store.open(spark, path)
    with pytest.raises(InvalidArgument):
        s.put_many(spark.createDataFrame([(b"k", b"1"), (b"k", b"2")], "key binary, value binary"))
    s.put_many(spark.createDataFrame([(b"k", b"1", 0), (b"k", b"2", 1), (b"j", b"3", 0)], "key binary, value binary, ordinal int"))
    assert s.get(b"k") == b"2"
    s.put(b"k", b"4")
    s.put_many(spark.createDataFrame([(b"j", b"5")], "key binary, value binary"))
    assert s.get(b"k") == b"4" and s.get(b"j") == b"5"
    got = {bytes(r.key): r.value and bytes(r.value) for r in s.multi_get(spark.createDataFrame([(b"k",), (b"j",), (b"none",)], "key binary")).collect()}
    assert got == {b"k": b"4", b"j": b"5", b"none": None}
    assert [bytes(r.key) for r in s.scan(b"k", b"l").collect()] == [b"k"]
    with pytest.raises(InvalidArgument):
        s.put_many(spark.createDataFrame([(b"", b"5")], "key binary, value binary"))


def test_vectors(spark, path):
    s = Store.open(spark, path)
    assert s.nearest([1.0, 0.0], 3) == []
    for bad in ([], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0]):
        with pytest.raises(InvalidArgument):
            s.put_indexed(b"k", bad)
    s.put_indexed(b"near", [1.0, 0.01, 0.0])
    s.put_indexed(b"mid", [0.7, 0.7, 0.0])
    s.put_indexed(b"far", [0.0, 1.0, 0.0])
    with pytest.raises(InvalidArgument):
        s.put_indexed(b"k", [1.0, 0.0])
    with pytest.raises(InvalidArgument):
        s.nearest([1.0, 0.0], 1)
    assert [k for k, _ in s.nearest([1, 0, 0], 3)] == [b"near", b"mid", b"far"]
    assert s.get(b"far") == to_bytes([0, 1, 0]) and from_bytes(s.get(b"far")) == [0, 1, 0]
    assert [k for k, _ in s.nearest_filtered([1, 0, 0], 3, F.col("key").cast("string").startswith("m"))] == [b"mid"]
    assert [k for k, _ in s.nearest_filtered([1, 0, 0], 3, lambda k: k.endswith(b"r"))] == [b"near", b"far"]
    assert s.nearest_filtered([1, 0, 0], 3, F.lit(False)) == [] and s.nearest([1, 0, 0], 0) == []
    s.delete(b"near")
    s.put(b"mid", b"plain")  # takes its vector away
    s.flush()
    s = Store.open(spark, path)
    assert [k for k, _ in s.nearest([1, 0, 0], 3)] == [b"far"] and s.vector_count() == 1
    s.put_indexed(b"far", [1.0, 0.0, 0.0])
    (k, d), *rest = s.nearest([1, 0, 0], 3)
    assert k == b"far" and abs(d) < 1e-6 and not rest
    with pytest.raises(InvalidArgument):
        Store(spark, StoreOptions(path, vectors=VectorOptions(metric="inner_product")))


@pytest.mark.parametrize("metric, query, want", [("euclidean_squared", [0.0, 0.0], [0.01, 1.0, 100.0]), ("inner_product", [1.0, 0.0], [-10.0, -1.0, -0.1])])
def test_metrics(spark, path, metric, query, want):
    s = Store(spark, StoreOptions(path, vectors=VectorOptions(metric=metric)))
    for x in (0.1, 1.0, 10.0):
        s.put_indexed(f"{x}".encode(), [x, 0.0])
    assert np.allclose([d for _, d in s.nearest(query, 3)], want)


def test_approximate_index(spark, path):
    s = Store(spark, StoreOptions(path, vectors=VectorOptions(cells=8)))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype("f4")
    s.put_many(spark.createDataFrame([(f"v{i}".encode(), v.tolist()) for i, v in enumerate(x)], "key binary, embedding array<float>"))
    s.build_index()
    s.delete(b"v0")
    s.put_indexed(b"v1", (-x[1]).tolist())
    s.put_indexed(b"new", x[2].tolist())
    found = s.nearest(x[2], 5, approximate=True)
    assert {k for k, _ in found[:2]} == {b"v2", b"new"} and len(found) == 5
    assert b"v0" not in [k for k, _ in s.nearest(x[0], 300, approximate=True)]
    assert s.nearest(x[0], 300, approximate=True) == s.nearest(x[0], 300)
    s.flush()
    s.compact()
    assert s.nearest(x[5], 300, approximate=True) == s.nearest(x[5], 300)
    s.files.remove(f"{s.files.root}/index")
    assert s.nearest(x[5], 10, approximate=True) == s.nearest(x[5], 10)
    s.build_index()
    assert s._index() is not None
    part = next(n for n in s.files.sizes(f"{s.files.root}/index") if n.endswith(".parquet"))
    s.files.write(f"{s.files.root}/index/{part}", b"cut short")  # damage: the log is searched instead
    assert s._index() is None and s.nearest(x[5], 10, approximate=True) == s.nearest(x[5], 10)


def test_index_counters(spark, path):
    s = Store.open(spark, path)
    assert (s.dim, s.metric, s.vector_count_with_deleted()) == (0, "cosine", 0)
    for k in (b"a", b"b", b"c"):
        s.put_indexed(k, [1.0, 2.0, 3.0])
    s.flush()
    s.put(b"d", b"plain")
    s.delete(b"a")
    s.put(b"b", b"plain")
    assert (s.dim, s.vector_count(), s.vector_count_with_deleted()) == (3, 1, 3)
    assert [s.is_deleted(k) for k in (b"a", b"b", b"c", b"d", b"none")] == [True, True, False, False, False]


def test_reads_leave_out_runs_by_key_bounds(spark, path):
    s = Store.open(spark, path)
    for low, high in ((b"a", b"c"), (b"m", b"p")):
        s.put(low, b"1")
        s.put(high, b"2")
        s.flush()
    s = Store.open(spark, path)
    first = next(r for r in s.manifest.runs if r.low == b"a".hex())
    s.files.remove(s.runs.path(first))
    assert s.get(b"p") == b"2" and s.get(b"z") is None and s.scan(b"d", b"n").count() == 1
    with pytest.raises(Corruption):
        s.get(b"b")


def test_a_batch_is_one_commit(spark, path):
    """The number of a stream's batch and the vectors' dimensions are in the manifest that lists the batch's run."""
    s = Store.open(spark, path)
    rows = spark.createDataFrame([(b"k", [1.0, 2.0])], "key binary, embedding array<float>")
    seen = []
    write = s.files.write
    s.files.write = lambda at, data: (seen.append(data) if at.endswith("MANIFEST.json") else None, write(at, data))
    s.put_many(rows, "stream", 4)
    assert len(seen) == 1
    s = Store.open(spark, path)
    assert (s.manifest.streams, s.dim, s.run_count()) == ({"stream": 4}, 2, 1)
    s.put_many(rows, "stream", 4)
    assert s.run_count() == 1
    s.put_many(rows, "other", 0)
    assert s.run_count() == 2


def test_a_batch_is_read_once(spark, path):
    s = Store.open(spark, path)
    rows = spark.range(50).select(F.concat(F.lit("k"), F.col("id")).cast("binary").alias("key"), F.expr("cast(uuid() as binary)").alias("value"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    s.put_many(rows.mapInArrow(count, rows.schema))
    assert reads.value == 50 and s.live().count() == 50


def test_damage(spark, path):
    s = Store.open(spark, path)
    s.put(b"k", b"v")
    s.flush()
    s.files.make_dirs(f"{s.runs.root}/sst_L0_00000000000000000099.sst")  # an orphan
    assert s.vacuum() == ["sst_L0_00000000000000000099.sst"] and s.get(b"k") == b"v"
    s.files.remove(s.runs.path(s.manifest.runs[0]))
    with pytest.raises(Corruption):
        Store.open(spark, path).get(b"k")
    s.files.write(f"{path}/MANIFEST.json", b"{}")
    with pytest.raises(Corruption):
        Store.open(spark, path)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("pdf"), st.binary(min_size=1, max_size=2), st.binary(max_size=4)), max_size=12))
def test_against_dictionary(spark, tmp_path_factory, ops):
    s = Store.open(spark, str(tmp_path_factory.mktemp("model")))
    model = {}
    for op, k, v in ops:
        if op == "p":
            s.put(k, v)
            model[k] = v
        elif op == "d":
            s.delete(k)
            model.pop(k, None)
        else:
            s.flush()
    assert {bytes(r.key): bytes(r.value) for r in s.scan().collect()} == model
    s = Store.open(spark, s.path)
    assert {bytes(r.key): bytes(r.value) for r in s.scan().collect()} == model


def test_stream(spark, path, tmp_path):
    from tidelog.streaming.ingest import ingest

    source = str(tmp_path / "in")
    spark.createDataFrame([(b"a", 1, b"1", 0), (b"b", 1, b"2", 1), (b"a", 2, None, 2)], "key binary, kind byte, value binary, ordinal int").coalesce(1).write.parquet(source)
    s = Store.open(spark, path)
    schema = "key binary, kind byte, value binary, ordinal int"
    for _ in range(2):  # the second time nothing is new
        ingest(spark.readStream.schema(schema).parquet(source), s, str(tmp_path / "check")).awaitTermination()
    assert s.get(b"a") is None and s.get(b"b") == b"2" and s.run_count() == 1
