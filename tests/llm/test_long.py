"""Very long texts, over the sizes at which each operator takes a text in parts, and odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import langid, licences, maxent, minhash, mixing, packing, sketch, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(41)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(20_000)]
    return " ".join(rng.choices(vocabulary, k=200_000))


def test_near_duplicates(spark, long_text):
    assert 199_000 > minhash.PART
    texts = [long_text, long_text + " tail", long_text[: len(long_text) // 2], "short one here"]
    got = {r.doc_id: r for r in minhash.near_classes(rows_of(spark, texts), 2).collect()}
    w = long_text.encode().split()
    assert got[0].n_shingles == len(set(zip(w, w[1:]))) and got[1].n_shingles == got[0].n_shingles + 1
    assert [got[i].component_id for i in range(4)] == [0, 0, 2, 3]


def test_language_blocks(spark, monkeypatch):
    """Positions taken in blocks cost as if taken at once, at order 4, across texts' borders."""
    rng = random.Random(42)
    texts = ["".join(rng.choices("abcdé ", k=k)) for k in (700, 3, 65, 900, 1)]
    train = rows_of(spark, texts + ["".join(rng.choices("xyzab ", k=500))]).withColumn("lang", F.when(F.col("doc_id") < 5, "p").otherwise("q"))
    model = langid.train(train)
    want = langid.Coder(model).lengths([t.encode() for t in texts])
    for size in (64, 1, 7):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert np.allclose(langid.Coder(model).lengths([t.encode() for t in texts]), want, rtol=1e-5)


def test_singletons_count(spark):
    """Strings that occur once are in the statistics: followers of a context, and so escapes, are those of the sample."""
    model = langid.train(rows_of(spark, ["abcdeabcdf", "abcdg"]))
    keys = set(model["keys"].tolist())
    for t in (b"abcde", b"abcdf", b"abcdg", b"deabc"):
        assert int.from_bytes(t, "big") | len(t) << 8 * len(t) in keys
    # after abcd came e, f and g once each: a letter more costs 3 of 6 for the escape
    body = int.from_bytes(b"abcd", "big") | 4 << 32
    assert abs(model["escape"][np.searchsorted(model["keys"], body), 0] - 1.0) < 1e-6


def test_packing_batches(spark, monkeypatch, long_text):
    from tokenizers import Tokenizer

    texts = [long_text, "a b", long_text[:5000], None]
    got = packing.pack(rows_of(spark, texts))
    monkeypatch.setattr(packing, "BATCH_BYTES", 100)
    again = packing.pack(rows_of(spark, texts))
    plain = lambda df: sorted((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in df.collect())
    assert plain(got) == plain(again)
    ids = np.concatenate([np.frombuffer(x[3], "<u4") for x in plain(got) if x[0] == 0])
    assert ids.tolist() == Tokenizer.from_file(packing.default_vocabulary()).encode(long_text, add_special_tokens=False).ids + [2]


def test_licence_at_the_end(spark, long_text):
    text = long_text[:700_000] + "\n\n" + long_text[700_000:] + "\n\nReleased under the MIT License."
    model = licences.train(rows_of(spark, ["some words", "other words"]))
    (found,) = [r.found for r in licences.scan(rows_of(spark, [text]), model).collect()]
    assert [x.family for x in found] == ["MIT"] and text[found[0].start : found[0].end] == "Released under the MIT License."


def test_language_model(spark, long_text):
    assert len(long_text) > 1 << 20
    rows = rows_of(spark, [long_text, "a b", long_text])
    model = maxent.Model(maxent.count_tokens(rows), rows)
    got = {r.doc_id: r for r in maxent.score(rows, model).collect()}
    assert got[0].n_tokens == got[0].n_known == 200_001 and got[0].score == got[2].score > got[0].base_score


def test_fingerprint(spark, long_text):
    df = rows_of(spark, [long_text, long_text, "x"])
    got = sketch.fingerprints(df).orderBy("doc_id").collect()
    w = long_text.split()
    shingles = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert got[0].fingerprint == got[1].fingerprint and len(got[0].sketch) == sketch.K and abs(got[0].n_shingles - shingles) < 0.25 * shingles


def test_mixing(spark, long_text):
    df = rows_of(spark, [long_text, "a b c", None]).withColumn("source", F.when(F.col("doc_id") == 0, "a").otherwise("b"))
    got = {r.doc_id: r for r in mixing.serve(mixing.mix(df, ["doc_id", "source"])).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.first("size").alias("size")).collect()}
    assert got[0]["size"] == 200_000 and got[0].taken == round(1.5 * 200_003 - 6) and got[1].taken == 6 and got[2].taken == 0


def test_served_words_run_on(spark):
    """The running sum goes on from range to range in serving order and ends at the budget."""
    rng = random.Random(43)
    df = spark.createDataFrame([(i, "w " * rng.randint(0, 30), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(200)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        rows = mixing.serve(mixing.mix(df, ["doc_id", "source"])).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(rows, key=lambda r: (r.served, r.taken > 0))
    at = 0
    for r in (x for x in rows if x.taken):
        assert r.served == at
        at += r.taken
    taken = [r for r in rows if r.taken]
    assert [r.finish for r in taken] == sorted(r.finish for r in taken) and len({r.slot for r in taken}) > 1
    words = sum(len(r.text.split()) for r in df.collect())
    assert abs(at - 1.5 * words) <= 4


def test_empty_tables(spark, tmp_path):
    rows_of(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    from tidelog.llm import registry

    for name, run in registry.QUERIES.items():
        assert run(spark, str(tmp_path)).count() == 0, name


def test_clashing_columns(spark):
    """Columns named as those that the operators make do no harm."""
    df = rows_of(spark, ["a b c d e f", "a b c d e f", None]).selectExpr("*", "1 as score", "2 as toxicity", "3 as sketch", "4 as found", "5 as n", "6 as h", "7 as row", "8 as base")
    assert minhash.near_classes(df, 2).count() == 3 and sketch.fingerprints(df).count() == 3
    assert packing.pack(df).count() >= 3 and sketch.with_next(df).count() == 3
    model = maxent.Model(maxent.count_tokens(df), df)
    assert maxent.score(df, model).count() == 3
    assert toxicity.score(df, None, ["doc_id", "score"]).columns[:2] == ["doc_id", "score"]
    assert licences.scan(df, licences.train(df)).count() == 3 and langid.identify(df, langid.train(df), ["doc_id", "n"]).count() == 3
