"""Operators on pairs and repeats, against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from tidelog.llm import components, minhash, neighbours, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def reach(nodes, links):
    """Smallest node that each can reach."""
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 540)]
    want = reach({x for l in links for x in l}, links)
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts():
    rng = random.Random(2)
    base = [rng.choices(WORDS, k=60) for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base[:6]:
        for edits in (0, 1, 2, 4, 8):
            for _ in range(3):
                c = list(b)
                for _ in range(edits):
                    c[rng.randrange(len(c))] = rng.choice(WORDS)
                out.append(" ".join(c))
    chain = rng.choices(WORDS, k=80)
    for _ in range(12):  # each near the one before
        chain = list(chain)
        for _ in range(3):
            chain[rng.randrange(80)] = rng.choice(WORDS)
        out.append(" ".join(chain))
    return [*out, None, "", " \n\t", "one", "One", "ONE  ", "two words", "a b", "É é", "x y z", "x\x0by\x0cz", out[0].upper(), "ab " * 5000]


@pytest.mark.parametrize("shingle, small", [(2, 32), (5, 32), (2, 2)])
def test_minhash(spark, monkeypatch, shingle, small):
    texts = near_texts()
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 5)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + min(shingle, len(w))]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[j]]
    want = reach(range(len(sets)), links)
    rows = docs_of(spark, texts)
    got = minhash.near_classes(rows.withColumn("rep", rows.doc_id), shingle).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_minhash_empty_and_repeated(spark):
    assert minhash.near_classes(docs_of(spark, []), 5).count() == 0
    assert [r.component_id for r in minhash.near_classes(docs_of(spark, [None, ""]), 5).orderBy("doc_id").collect()] == [0, 1]
    one = docs_of(spark, ["a b c d e f g"])
    assert [tuple(r) for r in minhash.near_classes(one.union(one), 5).collect()] == [(0, 3, 0)] * 2


def test_signature_estimate(spark):
    """The corrected estimate is close to the similarity."""
    words = minhash.Words()
    a = minhash.signature(words.shingles(" ".join(WORDS[:300]), 1))
    b = minhash.signature(words.shingles(" ".join(WORDS[50:350]), 1))
    mask = np.uint64((1 << minhash.BITS) - 1)
    same = np.mean(((a >> np.uint64(32)) & mask) == ((b >> np.uint64(32)) & mask))
    chance = 2.0**-minhash.BITS
    assert abs((same - chance) / (1 - chance) - 250 / 350) < 0.15


@pytest.mark.parametrize("copy", [0.0, 1e6])
def test_range_join(spark, copy):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[:10] + rng.normal(size=(10, 8)) * 0.1, base[:10] * 2, np.repeat(base[:1], 5, 0), base[3] + rng.normal(size=(60, 8)) * 0.15]).astype("f4")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] * 8, 0), (n + 3, [None, *[1.0] * 7], 0), (n + 4, [float("inf")] * 8, 0), (n + 5, [], 0)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    want = reach(range(n), list(zip(*np.nonzero(hit))))
    old = neighbours.COPY, neighbours.BLOCK
    neighbours.COPY, neighbours.BLOCK = copy, 16  # many cells or one, in several blocks
    try:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id as rep", "1 as cell")
        got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_links(df).collect()}
    finally:
        neighbours.COPY, neighbours.BLOCK = old
    assert got == {i: (int(hit[i].sum()), want[i]) if i < n else (0, i) for i in range(n + 6)}
    cells = len(neighbours.choose_pivots(u, 10**6, 0.3))
    assert 1 <= cells <= len(u) / 4
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neighbours.near_links(empty).count() == 0
    assert [tuple(r) for r in neighbours.near_links(spark.createDataFrame([(5, None)], "vec_id long, embedding array<float>")).collect()] == [(5, 0, 5)]


def test_range_join_of_several_lengths_and_at_the_bound(spark):
    """Vectors of each length link among themselves only; pairs just over and under the bound fall on their sides."""
    rng = np.random.default_rng(13)
    x = [rng.normal(size=d) for d in (3, 5, 7, 3, 5) for _ in range(12)]
    x += [v[:-1] if len(v) > 3 else np.append(v, 0.0) for v in x[:20]] + [v + rng.normal(size=len(v)) * 0.05 for v in x[:30]]
    for t in (0.95, np.nextafter(0.95, 1), 0.95 + 1e-9, 0.95 - 1e-9, np.nextafter(0.95, 0)):
        x += [np.array([1.0, 0, 0, 0, 0, 0]), np.array([t, np.sqrt(1 - t * t), 0, 0, 0, 0])]
    x += [np.eye(9)[0] * 1e-200 + np.eye(9)[4] * 1e-200, np.eye(9)[0] * 1e200 + np.eye(9)[4] * 1e200]  # their squares are no doubles
    n = len(x)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [(i, v.tolist()) for i, v in enumerate(x[:-2])])
    want = {r[0]: r[1:3] for r in con.sql(neighbours.OP1_SQL).fetchall()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    ties = set(range(n - 12, n - 2))
    assert all(got[i] == want[i] for i in range(n - 2) if i not in ties)
    assert got[n - 2][0] == got[n - 1][0] == 1 and (got[n - 7][0], got[n - 5][0]) == (9, 4)  # 0.95 + 1e-9 links with the five equal ones, 0.95 - 1e-9 does not


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, t in enumerate(data):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((d, p))
    out = []
    for d, t in enumerate(data):
        mark = [False] * (len(t) + 1)
        for p in range(len(t) - length + 1):
            if len(seen[t[p : p + length]]) > 1:
                mark[p : p + length] = [True] * length
        out.append([(a, b) for a, b in spans(mark)])
    return out


def spans(mark):
    at = None
    for i, m in enumerate(mark):
        if m and at is None:
            at = i
        if not m and at is not None:
            yield at, i
            at = None


def odd_texts():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choices("abcdeé ", k=n))
    passage, short = say(150), say(30)
    texts = [say(200) + passage[rng.randrange(60) : 90 + rng.randrange(60)] + say(50) for _ in range(25)]
    texts += [say(100) + short + say(100) for _ in range(5)]
    return texts + ["a" * 300, "ab" * 100, "abc" * 200, texts[0], texts[0], None, "", "x", passage, "z" * 39, "q" * 40, "r" * 41]


@pytest.mark.parametrize("batches", [1, 5])
def test_suffixes(spark, batches):
    texts = odd_texts()
    rows = docs_of(spark, texts)
    got = suffixes.repeats(rows.selectExpr("*", "1 as h", "2 as runs", "3 as d", "4 as batch").drop("d"), 40, 16, batches=batches).collect()
    assert {r.doc_id: suffixes.merged(r.spans) for r in got} == dict(enumerate(brute_repeats(texts, 40)))
    assert len(got) == len(texts) and got[0].batch == 4


def brute_passages(texts, length):
    """Runs of words that strings of so many words cover which another text of the list holds too."""
    data = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, t in enumerate(data):
        for p in range(len(t) - length + 1):
            seen.setdefault(tuple(t[p : p + length]), set()).add(d)
    out = []
    for t in data:
        mark = [False] * (len(t) + 1)
        for p in range(len(t) - length + 1):
            if len(seen[tuple(t[p : p + length])]) > 1:
                mark[p : p + length] = [True] * length
        out.append(list(spans(mark)))
    return out


def test_passages_across_documents(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices(WORDS[:40], k=n))
    shared = say(30)
    texts = [say(20) + " " + " ".join(shared.split()[rng.randrange(12) :]) + " " + say(20) for _ in range(20)]
    own = say(15)
    texts += [f"{own} {say(3)} {own}", shared.upper(), shared.replace(" ", "\n "), "a " * 100, "b " * 60, "b " * 70, None, "", "one"]
    got = suffixes.repeats(docs_of(spark, texts), 12, 4, suffixes.Words, across=True, batches=3).collect()
    assert {r.doc_id: suffixes.merged(r.spans) for r in got} == dict(enumerate(brute_passages(texts, 12)))


def test_suffixes_empty_repeated_and_long(spark):
    assert suffixes.repeats(docs_of(spark, [])).count() == 0
    one = docs_of(spark, ["".join(random.Random(5).choices("abcdef", k=500))])
    assert [suffixes.merged(r.spans) for r in suffixes.repeats(one.union(one)).collect()] == [[(0, 500)]] * 2
    rng = random.Random(6)
    tail = "".join(rng.choices("abcdef", k=700))
    long = "".join(rng.choices("abcdef", k=suffixes.CHUNK + 1000)) + tail + "x"
    got = {r.doc_id: suffixes.merged(r.spans) for r in suffixes.repeats(docs_of(spark, [long, "y" + tail])).collect()}
    assert got == {0: [(len(long) - 701, len(long) - 1)], 1: [(1, 701)]}


def test_log_index(spark):
    """Levels halve in size, and a scan finds what a batch shares with any level."""
    rng = np.random.default_rng(7)
    index, seen, batches = suffixes.LogIndex([suffixes.Search(suffixes.Bytes, 40, 16)]), [], []
    for b in range(7):
        h = rng.choice(1 << 22, 4000, replace=False)
        h[:50] = rng.choice(300, 50, replace=False)
        seen.append(h)
        batches.append(spark.createDataFrame([(b, 0, 0, int(x), 100 * b + i, 0, 1, 0) for i, x in enumerate(h)], suffixes.SUFFIXES).coalesce(1))
        index.add(batches[-1])
    every, n = np.unique(np.concatenate(seen), return_counts=True)
    found = {r.h for s in index.seeds for r in s.collect()}
    assert found == set(every[n > 1].tolist())
    assert [round(x.rows.count() / 4000) for x in index.levels] == [4, 2, 1]
    matched = [r for b in batches for r in index.matched(b).collect()]
    assert len(matched) == sum(int(k) for k in n if k > 1) > 0
    index.close()


def test_searches_share_an_index(spark):
    """Two searches in one pass find what each finds alone."""
    texts = odd_texts()
    both = [suffixes.Search(suffixes.Bytes, 40, 16), suffixes.Search(suffixes.Words, 12, 4, across=True)]
    got = suffixes.repeated(docs_of(spark, texts), both, 2).collect()
    assert {r.doc_id: suffixes.merged(r.spans_0) for r in got} == dict(enumerate(brute_repeats(texts, 40)))
    assert {r.doc_id: suffixes.merged(r.spans_1) for r in got} == dict(enumerate(brute_passages(texts, 12)))


def test_kept_bytes():
    assert suffixes.without(b"abcdef", [(0, 2), (4, 5)]) == b"cdf" and hashlib.sha256(suffixes.without(b"", [])).hexdigest()[:4] == "e3b0"
