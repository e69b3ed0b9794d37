"""The registered queries against SQL, and the pipeline over planted cases."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import registry

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, [_row(want.columns, r) for r in want.fetchall()]))


def _row(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values)))


def test_entry_has_them():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def planted(spark, folder):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts, toxic = [], []
    for i in range(160):
        bad = i % 5 == 0
        texts.append(". ".join(say(20) + (" blarghful" if bad and j == 2 else "") for j in range(5)))
        toxic.append(int(bad))
    passage = say(80)
    copies = [texts[1], texts[1] + " tail", texts[2].replace(texts[2].split()[50], "changed", 1)]
    shared = [say(60) + " " + passage + " " + say(60) for _ in range(3)]
    rest = [None, "", "short one"]
    rows = [(i, t, "en", ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(texts + copies + shared + rest)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, toxic, passage


def test_pipeline_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, toxic, passage = planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.withColumn("spans", F.lit(1)) if not i else docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in seen["toxicity"]}
    assert left == {i for i, *_ in rows if i >= len(toxic) or not toxic[i]}
    left -= {160, 161, 162}  # copies of 1, 1 and 2
    assert {r.doc_id for r in seen["near_duplicates"]} == left
    cut = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert all(passage not in (t or "") for t in cut.values()) and {163, 164, 165} <= set(cut)
    assert all(cut[i] == rows[i][1] for i in cut if i < 160)
    size = sum(len((t or "").split()) for t in cut.values())
    mixed = seen["mixing"]
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * size) <= 3
    assert all((cut[r.doc_id]).startswith(r.text.strip()) or r.text == cut[r.doc_id] for r in mixed)
    assert sum(r.length for r in seen["packing"]) >= 1.5 * size


def test_pipeline_run_on_nothing(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_cuts_passages_of_over_50_words(spark):
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 7))) for _ in range(n))
    over, under, solid = say(51), say(50), "".join(rng.choices("abcdefghijklmno", k=450))
    assert len(over) < 400
    texts = [f"{say(30)} {x} {say(30)}" for x in (over, over.replace(" ", "  ", 3), under, under, solid, solid)] + ["a " * 60, "b", None]
    rows = [(i if i != 1 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert solid not in got[4] and solid not in got[5]
    assert got[0].split() == texts[0].replace(over, "").split()
    assert got[None].split() == texts[1].split()[:30] + texts[1].split()[-30:]
    assert [got[i] for i in (2, 3, 7)] == texts[2:4] + ["b"] and got[8] is None and set(got) == {0, None, 2, 3, 4, 5, 7, 8}


def test_pipeline_keeps_rows_without_an_id_of_their_own(spark):
    rng = random.Random(22)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefghijklmno", k=5)) for _ in range(100)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (None, b + " tail"), (7, c), (7, d), (7, d), (8, c), (9, a), (10, None), (11, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    (of_b,) = [t for i, t in got if i is None and t and t.startswith(b)]
    assert sorted(map(str, got)) == sorted(map(str, [(None, of_b), (7, c), (7, d), (9, a), (10, None), (11, None), (None, None)]))
