"""Codecs, logs, quantizer, filter, names, recall."""

import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import bloom, ivf, knn, quantize
from tidelog.operators.quantize import ScalarQuantizer
from tidelog.schema import Corruption, InvalidArgument
from tidelog.sources import runs, wal

record = st.tuples(st.sampled_from([1, 2, 3]), st.binary(min_size=1, max_size=255), st.binary(max_size=4095)).map(lambda r: (r[0], r[1], b"" if r[0] == 2 else r[2]))


@given(st.lists(record, max_size=5))
def test_records_round_trip(records):
    assert wal.parse_log(wal.log_bytes(records)) == records


@given(record, st.data())
def test_a_flipped_bit_is_noticed(one, data):
    raw = bytearray(codec.encode(*one) + codec.encode(1, b"next", b""))
    n = len(codec.encode(*one))
    bit = data.draw(st.integers(0, 8 * n - 1))
    raw[bit // 8] ^= 1 << bit % 8
    try:
        assert list(codec.decode_all(bytes(raw))) != [one, (1, b"next", b"")]
    except Corruption:
        pass


def test_torn_tail_and_damage(spark, tmp_path):
    records = [(1, b"a", b"1"), (1, b"b", b"2" * 100), (2, b"c", b"")]
    raw = wal.log_bytes(records)
    assert wal.parse_log(raw[:-5]) == records[:2]
    bad = bytearray(raw)
    bad[len(wal.log_bytes(records[:1])) + 40] ^= 1
    for data in (bytes(bad), b"short", b"X" * 20, wal.MAGIC + b"\x09\x00\x00\x00"):
        with pytest.raises(Corruption):
            wal.parse_log(data)
    for bad_record in ((1, b"", b""), (0, b"k", b""), (1, b"k" * 65537, b"")):
        with pytest.raises(InvalidArgument):
            codec.encode(*bad_record)
    (tmp_path / "a.log").write_bytes(raw)
    got = wal.read_logs(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.kind, bytes(r.key), bytes(r.value)) for r in got] == records


def test_quantizer(spark):
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "embedding array<float>")
    q = ScalarQuantizer.train(rows([[0.0, -10.0, 3.0], [1.0, 10.0, 3.0], [0.5, 0.0, 3.0]]))
    got = rows([[0.3, 4.2, 9.0], [-5.0, 50.0, float("nan")]]).select(q.quantize(F.col("embedding")).alias("q"), q.round_trip(F.col("embedding")).alias("r")).collect()
    assert abs(got[0].r[0] - 0.3) <= 1 / 510 + 1e-6 and abs(got[0].r[1] - 4.2) <= 20 / 510 + 1e-6 and got[0].r[2] == 3.0
    assert got[1].q == [0, 255, 0] and q.dim == 3
    for bad in ([], [[]], [[1.0], [1.0, 2.0]], [[float("nan")]]):
        with pytest.raises(InvalidArgument):
            ScalarQuantizer.train(rows(bad))


def test_filter(spark):
    keys = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).cast("binary").alias("key"))
    absent = spark.range(10_000).select(F.concat(F.lit("x"), F.col("id")).cast("binary").alias("key"))
    f = bloom.Bloom.build(keys, 1000)
    data, m, k = f.encode()
    assert (m, k) == bloom.shape(1000) == (10_000, 6) and bloom.shape(0) == (64, 6)
    for g in (f, bloom.Bloom.decode(spark, data)):
        assert g.probe(keys).where("not maybe").count() == 0
        assert g.probe(absent).where("maybe").count() < 500
    with pytest.raises(Corruption):
        bloom.Bloom.decode(spark, data[:-1])


def test_names(spark):
    assert runs.parse_run(runs.run_name(1, 7)) == (1, 7) and runs.parse_run("other") is None
    got = runs.parse_names(spark.createDataFrame([(runs.run_name(0, 12),), ("x",)], "name string")).collect()
    assert [(r.level, r.run_id) for r in got] == [(0, 12), (None, None)]


@pytest.mark.parametrize("n, dim, bound", [(1000, 16, 0.90), (3000, 32, 0.85)])
def test_recall(spark, tmp_path, n, dim, bound):
    x = np.random.default_rng(3).uniform(-1, 1, (n, dim)).astype("f4")
    rows = spark.createDataFrame([(f"v{i}", i, v.tolist()) for i, v in enumerate(x)], "key string, seq long, embedding array<float>").cache()
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).uniform(-1, 1, (50, dim)))], "qid int, query array<float>")
    for deleted in (0, n * 3 // 10):
        left = rows.where(F.col("seq") >= deleted)
        index = ivf.IvfIndex.build(left, str(tmp_path / f"index{deleted}"), n, cells=32)
        found = knn.recall(ivf.ivf_join(index, asked, 10, 16, left), knn.knn_join(left, asked, 10), 10).first().recall
        assert found > bound


def test_recall_on_clusters_at_an_eighth_of_the_cells(spark, tmp_path):
    """The default index: about the square root of the count in cells, an eighth of them read."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(50, 128))
    x = (centres[rng.integers(0, 50, 5000)] + rng.normal(size=(5000, 128)) * 0.3).astype("f4")
    rows = spark.createDataFrame([(f"v{i}", i, v.tolist()) for i, v in enumerate(x)], "key string, seq long, embedding array<float>").cache()
    asked = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, 5000, 50)], "qid int, query array<float>")
    index = ivf.IvfIndex.build(rows, str(tmp_path / "index"), 5000)
    cells = len(index.centroids)
    assert 60 <= cells <= 80 and ivf.default_probes(cells) <= cells / 7
    exact = knn.knn_join(rows, asked, 10)
    assert knn.recall(ivf.ivf_join(index, asked, 10, ivf.default_probes(cells), rows), exact, 10).first().recall >= 0.9
    coded = rows.withColumn("embedding", quantize.ScalarQuantizer.train(rows).round_trip(F.col("embedding")))
    assert knn.recall(knn.knn_join(coded, asked, 10), exact, 10).first().recall >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "euclidean_squared", "inner_product"])
def test_batch_equals_single(spark, metric):
    x = np.random.default_rng(5).normal(size=(60, 8)).astype("f4")
    rows = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "key string, embedding array<float>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "qid int, query array<float>")
    got = knn.knn_join(rows, asked, 5, metric).orderBy("qid", "rank").collect()
    same = knn.knn_join_columns(rows, asked, 5, metric).orderBy("qid", "rank").collect()
    assert [r.key for r in got] == [r.key for r in same]
    for q in range(3):
        one = knn.nearest(rows, x[q], 5, metric, kind="double").collect()
        assert [r.key for r in one] == [r.key for r in got if r.qid == q]


@pytest.mark.parametrize("metric", ["cosine", "euclidean_squared"])
def test_more_queries_than_a_block(spark, monkeypatch, metric):
    x = np.random.default_rng(8).normal(size=(300, 8)).astype("f4")
    rows = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate([*x, *x[:20]])], "key string, embedding array<float>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(100)], "qid int, query array<float>")
    want = knn.knn_join(rows, asked, 5, metric).orderBy("qid", "rank").select("qid", "key", "rank").collect()
    monkeypatch.setattr(knn, "QUERY_BYTES", 2000)
    joined = knn.knn_join(rows, asked, 5, metric)
    assert "FlatMapCoGroupsInPandas" in joined._jdf.queryExecution().toString()
    assert joined.orderBy("qid", "rank").select("qid", "key", "rank").collect() == want
    assert knn.knn_join(rows, asked.where("qid < 0"), 5, metric).count() == 0
    with pytest.raises(InvalidArgument):
        knn.knn_join_columns(rows, rows.selectExpr("key as qid", "embedding as query"), 5, metric)


def test_records_of_deletes_have_no_value():
    with pytest.raises(InvalidArgument):
        codec.encode(2, b"k", b"v")
    rest = codec.HEAD.pack(0, 2, 1, 1)[4:] + b"kv"
    with pytest.raises(Corruption):
        list(codec.decode_all(zlib.crc32(rest).to_bytes(4, "little") + rest))


def test_quantizer_refuses_other_dimensions(spark):
    q = quantize.ScalarQuantizer([0.0, 0.0], [1.0, 1.0])
    rows = lambda *v: spark.createDataFrame([(list(x) if x is not None else None,) for x in v], "v array<float>")
    assert [r[0] for r in rows((0.0, 1.0), None).select(q.quantize(F.col("v"))).collect()] == [[0, 255], None]
    for bad in ((0.5,), (0.5, 0.5, 0.5)):
        with pytest.raises(Exception, match="dimensions"):
            rows(bad).select(q.quantize(F.col("v"))).collect()
        with pytest.raises(Exception, match="dimensions"):
            rows(bad).select(q.dequantize(F.col("v").cast("array<smallint>"))).collect()


def test_large_filters_are_joined(spark, monkeypatch):
    keys = spark.range(500).selectExpr("concat('k', id) as key")
    f = bloom.Bloom.build(keys, 500)
    asked = keys.union(spark.range(500).selectExpr("concat('absent', id) as key"))
    want = sorted(map(tuple, f.probe(asked).collect()))
    monkeypatch.setattr(bloom, "HELD_BYTES", 1)
    assert sorted(map(tuple, f.probe(asked).collect())) == want and sum(m for _, m in want) < 530
    with pytest.raises(InvalidArgument):
        f.encode()


@pytest.mark.parametrize("metric", ["cosine", "euclidean_squared"])
def test_copies_are_ranked_by_key(spark, monkeypatch, metric):
    """Rounded distances that tie go by key, in blocks, in one pass and over an index."""
    x = np.repeat(np.random.default_rng(9).normal(size=(40, 16)).astype("f4"), 25, axis=0)
    x += (np.random.default_rng(10).normal(size=x.shape) * 1e-9).astype("f4")
    rows = spark.createDataFrame([(f"v{i:04}", i, v.tolist()) for i, v in enumerate(x)], "key string, seq long, embedding array<float>")
    asked = spark.createDataFrame([(i * 25, x[i * 25].tolist()) for i in range(40)], "qid int, query array<float>")
    want = [(q, f"v{q + r:04}", r + 1, 0.0) for q in range(0, 1000, 25) for r in range(10)]
    got = lambda found: [(r.qid, r.key, r["rank"], r.distance) for r in found.orderBy("qid", "rank").collect()]
    assert got(knn.knn_join(rows, asked, 10, metric, 6)) == want
    assert got(knn.knn_join_columns(rows, asked, 10, metric, 6)) == want
    for name, value in {"QUERY_BYTES": 0, "BLOCK_BYTES": 16 * 8 * 70, "TILE": 300, "TASK_PAIRS": 1000}.items():
        monkeypatch.setattr(knn, name, value)
    assert got(knn.knn_join(rows, asked, 10, metric, 6)) == want


def test_a_search_over_an_index_holds_tiles_alone(spark, tmp_path):
    """Distances are matrices of at most TILE, not an expression for each pair of rows."""
    x = np.random.default_rng(11).normal(size=(400, 8)).astype("f4")
    rows = spark.createDataFrame([(f"v{i:03}", i, v.tolist()) for i, v in enumerate(x)], "key string, seq long, embedding array<float>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 400, 20)], "qid int, query array<float>")
    index = ivf.IvfIndex.build(rows, str(tmp_path / "index"), 400, cells=8)
    found = ivf.ivf_join(index, asked, 10, 8, rows)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()
    select = lambda d: d.orderBy("qid", "rank").select("qid", "key", "rank").collect()
    assert select(found) == select(knn.knn_join(rows, asked, 10))
    assert ivf.ivf_join(index, asked.where("qid < 0"), 10, 8, rows).count() == 0


def test_tiles_stay_small(monkeypatch):
    """As many queries as a table of a million asks, against one batch of rows."""
    x = np.random.default_rng(12).normal(size=(10_000, 4))
    seen, was = [], knn._distances
    monkeypatch.setattr(knn, "_distances", lambda q, v, metric: seen.append(len(q) * len(v)) or was(q, v, metric))
    keys = np.arange(10_000).astype(object)
    out = knn._best(list(range(2_000)), knn._matrix(x[:2_000], "cosine"), iter([(keys, list(x))]), 10, "cosine", None)
    assert len(out) == 20_000 and max(seen) <= knn.TILE
