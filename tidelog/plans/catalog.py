"""Registered queries over op-logs derived from the test tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, distance
from ..functions.distance import dot
from ..operators import bloom, ivf, knn, merge, quantize
from ..schema import COSINE, EUCLIDEAN_SQUARED, INNER_PRODUCT, StoreOptions, VectorOptions
from ..sources import files, runs
from ..sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LATER = 1_000_000


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# derived inputs


def ops_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id"), F.lit(":slot_"), F.col("event_id") % 7).alias("key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("kind"), F.when(F.col("event_type") != "error", F.col("props")).alias("value"), F.floor(F.col("event_id") / 1000).cast("long").alias("run_id"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _key() -> Column:
    return F.concat(F.lit("user_"), F.col("label"), F.lit(":vec_"), F.col("vec_id")).alias("key")


def ops_v(spark: SparkSession, sf_dir: str, parts: str = "dpr") -> DataFrame:
    """Vectors, and as parts says later deletes (d), plain puts (p) and new vectors (r)."""
    v = embeddings(spark, sf_dir)
    none = F.lit(None).cast("array<float>").alias("embedding")
    later = (F.col("vec_id") + LATER).alias("seq")
    out = v.select(_key(), F.col("vec_id").alias("seq"), F.lit(3).alias("kind"), F.lit(None).cast("string").alias("value"), "embedding")
    if "d" in parts:
        out = out.union(v.where("vec_id % 10 = 3").select(_key(), later, F.lit(2), F.lit(None).cast("string"), none))
    if "p" in parts:
        out = out.union(v.where("vec_id % 10 = 7").select(_key(), later, F.lit(1), F.lit("plain"), none))
    if "r" in parts:
        n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
        out = out.union(v.where("vec_id % 10 = 5").join(n, "vec_id").select(_key(), later, F.lit(3), F.lit(None).cast("string"), F.col("next").alias("embedding")))
    return out


OPS_E = "ops_e AS (SELECT concat('user_', user_id, ':slot_', event_id % 7) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS kind, CASE WHEN event_type <> 'error' THEN props END AS value, event_id // 1000 AS run_id FROM events)"
LATEST = "latest AS (SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind FROM ops_e GROUP BY key), winner AS (SELECT o.key, o.seq, o.kind, o.value FROM ops_e o JOIN latest l ON o.key = l.key AND o.seq = l.seq)"
KV = ("kind", "value")


def ops_v_sql(parts: str = "dpr") -> str:
    key = "concat('user_', label, ':vec_', vec_id) AS key"
    out = f"SELECT {key}, vec_id AS seq, 3 AS kind, embedding FROM embeddings"
    if "d" in parts:
        out += f" UNION ALL SELECT {key}, vec_id + {LATER}, 2, NULL FROM embeddings WHERE vec_id % 10 = 3"
    if "p" in parts:
        out += f" UNION ALL SELECT {key}, vec_id + {LATER}, 1, NULL FROM embeddings WHERE vec_id % 10 = 7"
    if "r" in parts:
        out += f" UNION ALL SELECT concat('user_', a.label, ':vec_', a.vec_id), a.vec_id + {LATER}, 3, b.embedding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 10 = 5"
    return f"ops_v AS ({out}), won AS (SELECT * FROM ops_v QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), live AS (SELECT key, embedding FROM won WHERE kind = 3)"


def live_vectors(spark: SparkSession, sf_dir: str, parts: str = "dpr") -> DataFrame:
    return merge.live_vectors(ops_v(spark, sf_dir, parts)).select("key", "embedding")


# key-value queries


@query(f"WITH {OPS_E}, {LATEST} SELECT key, seq, kind, value FROM winner")
def kv_latest(spark, sf_dir):
    return merge.latest(ops_e(spark, sf_dir), KV)


@query(f"WITH {OPS_E}, {LATEST} SELECT key, seq, kind, value FROM winner WHERE kind <> 2")
def kv_live(spark, sf_dir):
    return merge.live(ops_e(spark, sf_dir), KV)


def _get(key: str):
    def run(spark, sf_dir):
        return merge.get(ops_e(spark, sf_dir), F.lit(key), KV).select("key", "value")

    return run


def _pick(kind: str):
    """The first key by name whose newest entry is (not) a tombstone."""

    def run(spark, sf_dir):
        log = ops_e(spark, sf_dir)
        chosen = merge.latest(log, KV).where(F.col("kind") == 2 if kind == "deleted" else F.col("kind") != 2).agg(F.min("key").alias("key"))
        return merge.multi_get(log, chosen, KV).select("key", "value")

    return run


for _name, _test in (("hit", "kind <> 2"), ("deleted", "kind = 2")):
    QUERIES[f"kv_get_{_name}"] = _pick(_name)
    ORACLES[f"kv_get_{_name}"] = f"WITH {OPS_E}, {LATEST}, k AS (SELECT min(key) AS key FROM winner WHERE {_test}) SELECT k.key, CASE WHEN w.kind <> 2 THEN w.value END AS value FROM k LEFT JOIN winner w ON w.key = k.key"
QUERIES["kv_get_missing"] = _get("user_none:slot_0")
ORACLES["kv_get_missing"] = f"WITH {OPS_E}, {LATEST} SELECT key, value FROM winner WHERE kind <> 2 AND key = 'user_none:slot_0'"


@query(f"WITH {OPS_E}, {LATEST}, k AS (SELECT concat('user_', i // 7 + 1, ':slot_', i % 8) AS key FROM range(0, 200) r(i)) SELECT k.key, w.value FROM k LEFT JOIN (SELECT * FROM winner WHERE kind <> 2) w ON w.key = k.key")
def kv_multi_get(spark, sf_dir):
    keys = spark.range(200).select(F.concat(F.lit("user_"), F.floor(F.col("id") / 7) + 1, F.lit(":slot_"), F.col("id") % 8).alias("key"))
    return merge.multi_get(ops_e(spark, sf_dir), keys, KV).select("key", "value")


def _pending(spark, sf_dir):
    """The last 500 operations: those not flushed."""
    log = ops_e(spark, sf_dir)
    last = log.agg(F.max("seq").alias("last"))
    return merge.latest(log.join(F.broadcast(last)).where("seq > last - 500"), KV)


PENDING = f"WITH {OPS_E}, p AS (SELECT * FROM ops_e WHERE seq > (SELECT max(seq) FROM ops_e) - 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@query(f"{PENDING} SELECT CAST(sum(length(key) + CASE WHEN kind = 2 THEN 0 ELSE coalesce(length(value), 0) END) AS BIGINT) AS bytes FROM p")
def kv_memtable_size(spark, sf_dir):
    return _pending(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>")).agg(merge.pending_size().alias("bytes"))


@query(f"{PENDING} SELECT count(*) AS entries, CAST(sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS BIGINT) AS tombstones FROM p")
def kv_memtable_len(spark, sf_dir):
    return _pending(spark, sf_dir).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).alias("tombstones"))


@query(f"WITH {OPS_E}, {LATEST} SELECT key, seq, kind, value FROM winner")
def kv_shadow_by_run(spark, sf_dir):
    """Winners of each run, then of the runs."""
    log = ops_e(spark, sf_dir)
    by_run = log.groupBy("run_id", "key").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*KV), "seq").alias("won")).select("key", "seq", "won.*")
    return merge.latest(by_run, KV)


@query(f"WITH {OPS_E}, {LATEST} SELECT key, seq, kind, value, row_number() OVER (ORDER BY key) AS pos FROM winner")
def kv_merge_sorted(spark, sf_dir):
    log = ops_e(spark, sf_dir).select("key", "seq", *KV, "run_id")
    return positions(merge.merge_runs([log.where(F.col("run_id") % 3 == i).drop("run_id") for i in range(3)], KV))


#: Keys that ranges are cut by, those least by a hash; rows of a range, about; most ranges, a power of two.
CUT_KEYS, RANGE_ROWS, RANGES = 16_384, 100_000, 1024


def positions(rows: DataFrame) -> DataFrame:
    """pos: the place of each row by key, counted a range at a time: no task holds all rows.

    Ranges are cut at values that are read first, so that a row's range follows from
    its key alone.  Rows are counted and numbered in two passes; the partitions of
    repartitionByRange can differ between those, by its sample or by how they are merged.
    """
    hashed = rows.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(CUT_KEYS).collect()
    keys = sorted(r.key for r in hashed if r.key is not None)
    # the least hashes' span tells how many rows there are
    about = len(hashed) if len(hashed) < CUT_KEYS else len(hashed) * 2**64 // (hashed[-1].h + 2**63 + 1)
    n = max(1, min(RANGES, len(keys), -(-about // RANGE_ROWS)))
    cuts = sorted({keys[len(keys) * i // n] for i in range(1, n)})
    part = F.lit(0)
    if cuts:
        steps = [2**i for i in reversed(range(len(cuts).bit_length()))]  # a binary search; past the end is null
        part = F.aggregate(F.array(*map(F.lit, steps)), part, lambda at, step: F.when(F.get(F.array(*map(F.lit, cuts)), at + step - 1) <= F.col("key"), at + step).otherwise(at))
    dealt = rows.withColumn("part", part)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return dealt.withColumn("within", within).join(F.broadcast(starts), "part").withColumn("pos", (F.col("before") + F.col("within")).cast("long")).drop("part", "within", "before")


@query(f"WITH {OPS_E}, {LATEST} SELECT key, seq, kind, value FROM winner WHERE kind <> 2")
def kv_compact_l0_l1(spark, sf_dir):
    return merge.compacted(ops_e(spark, sf_dir), True, KV)


@query(f"WITH {OPS_E} SELECT key, seq, kind, value FROM ops_e WHERE run_id > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def kv_compact_keep_tombstones(spark, sf_dir):
    return merge.compacted(ops_e(spark, sf_dir).where("run_id > 0"), False, KV)


def catalog_rows(spark, sf_dir):
    """A run catalog: every run of the log, each fourth of them at level 1."""
    return ops_e(spark, sf_dir).select("run_id").distinct().select(F.when(F.col("run_id") % 4 == 3, 1).otherwise(0).cast("long").alias("level"), "run_id")


RUN_CATALOG = f"WITH {OPS_E}, cat AS (SELECT DISTINCT CAST(CASE WHEN run_id % 4 = 3 THEN 1 ELSE 0 END AS BIGINT) AS level, run_id FROM ops_e), b AS (SELECT coalesce(max(run_id) FILTER (level = 1), -1) AS l1 FROM cat)"


@query(f"{RUN_CATALOG} SELECT level, count(*) AS runs FROM cat GROUP BY level")
def kv_level_counts(spark, sf_dir):
    return catalog_rows(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("runs"))


@query(f"{RUN_CATALOG} SELECT count(*) FILTER (level = 0) >= 4 AS due FROM cat")
def kv_compaction_due(spark, sf_dir):
    return catalog_rows(spark, sf_dir).agg((F.count(F.when(F.col("level") == 0, 1)) >= 4).alias("due"))


@query(f"{RUN_CATALOG} SELECT level, run_id, CASE WHEN level = 1 THEN run_id = l1 ELSE run_id > l1 END AS keep FROM cat, b")
def kv_run_reconcile(spark, sf_dir):
    return runs.reconcile(catalog_rows(spark, sf_dir))


@query(f"{RUN_CATALOG} SELECT concat('sst_L', level, '_', lpad(CAST(run_id AS VARCHAR), 20, '0'), '.sst') AS name, level, run_id FROM cat")
def kv_run_names(spark, sf_dir):
    names = catalog_rows(spark, sf_dir).select(F.concat(F.lit("sst_L"), F.col("level"), F.lit("_"), F.lpad(F.col("run_id").cast("string"), 20, "0"), F.lit(".sst")).alias("name"))
    return runs.parse_names(names)


@query(f"WITH {OPS_E}, {LATEST} SELECT key, seq, row_number() OVER (ORDER BY key) AS pos FROM winner")
def kv_sorted_scan(spark, sf_dir):
    return positions(merge.latest(ops_e(spark, sf_dir), KV).select("key", "seq"))


@query(f"WITH {OPS_E}, {LATEST} SELECT key, value FROM winner WHERE kind <> 2 AND key >= 'user_1' AND key < 'user_2'")
def kv_range_scan(spark, sf_dir):
    return merge.live(ops_e(spark, sf_dir).where("key >= 'user_1' AND key < 'user_2'"), KV).select("key", "value")


@query(f"WITH {OPS_E} SELECT r.key, r.seq, w.value FROM ops_e r LEFT JOIN LATERAL (SELECT CASE WHEN kind <> 2 THEN value END AS value FROM ops_e w WHERE w.key = r.key AND w.seq < r.seq AND w.seq % 2 = 0 ORDER BY w.seq DESC LIMIT 1) w ON true WHERE r.seq % 2 = 1")
def kv_ycsb_mix(spark, sf_dir):
    """Odd operations read what the even ones before them wrote."""
    log = ops_e(spark, sf_dir)
    return merge.reads_of(log.where("seq % 2 = 0"), log.where("seq % 2 = 1"))


# vector queries

PAIR_DOT = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: p[1] * p[2]))"


def d_sql(a: str, b: str, metric: str) -> str:
    dot_of = lambda x, y: PAIR_DOT.format(a=x, b=y)
    if metric == COSINE:
        return f"round(1 - {dot_of(a, b)} / (sqrt({dot_of(a, a)}) * sqrt({dot_of(b, b)})), 6) + 0.0"
    if metric == INNER_PRODUCT:
        return f"round(-{dot_of(a, b)}, 6) + 0.0"
    return f"round(list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0"


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("distance", F.round("distance", 6) + 0.0)  # no negative zero


def _query_vector(spark, sf_dir) -> list[float]:
    """The embedding of the least vec_id."""
    return list(embeddings(spark, sf_dir).orderBy("vec_id").limit(1).collect()[0].embedding)


Q = "q AS (SELECT embedding AS query FROM embeddings ORDER BY vec_id LIMIT 1)"


def _nearest(metric: str = COSINE, parts: str = "", predicate: str | None = None, k: int = 10):
    def run(spark, sf_dir):
        test = F.expr(predicate) if predicate else None
        return rounded(knn.nearest(live_vectors(spark, sf_dir, parts), _query_vector(spark, sf_dir), k, metric, test, "double"))

    sql = f"WITH {ops_v_sql(parts)}, {Q} SELECT key, {d_sql('embedding', 'query', metric)} AS distance FROM live, q{f' WHERE {predicate}' if predicate else ''} ORDER BY distance, key LIMIT {k}"
    return run, sql


for _name, _args in {
    "vec_nearest_cosine": {}, "vec_nearest_l2sq": {"metric": EUCLIDEAN_SQUARED}, "vec_nearest_ip": {"metric": INNER_PRODUCT},
    "vec_nearest_after_delete": {"parts": "d"}, "vec_nearest_after_overwrite": {"parts": "r"}, "vec_nearest_after_plain_put": {"parts": "p"}, "vec_snapshot_plus_delta": {"parts": "dpr"},
    "vec_filtered_prefix": {"predicate": "key LIKE 'user_1:%'"}, "vec_filtered_suffix": {"predicate": "key LIKE '%7'"}, "vec_filtered_none": {"predicate": "key LIKE 'nobody%'"}, "vec_filtered_underfill": {"predicate": "key LIKE '%:vec_11%'", "k": 500}, "vec_nearest_k_zero": {"k": 0},
}.items():
    QUERIES[_name], ORACLES[_name] = _nearest(**_args)


@query(f"WITH {ops_v_sql()} SELECT key, embedding FROM live")
def vec_live(spark, sf_dir):
    return live_vectors(spark, sf_dir)


@query(f"WITH {ops_v_sql()} SELECT count(*) AS vectors FROM live")
def vec_count(spark, sf_dir):
    return live_vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("vectors"))


@query("SELECT vec_id, i AS pos, round(embedding[i + 1]::DOUBLE / sqrt(" + PAIR_DOT.format(a="embedding", b="embedding") + "), 6) AS x FROM embeddings, range(0, 64) r(i)")
def vec_normalize(spark, sf_dir):
    unit = distance.normalize(F.col("embedding"), "double")
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(unit).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


#: The rows that searches query with: all with an id divisible by 50, and the five that some queries' SQL names.
ASKED, FIVE = "vec_id % 50 = 0", "vec_id < 5"
#: Digits of distances in SQL, which ranks the rounded ones.
DIGITS = 6


def _queries(spark, sf_dir, which: str = ASKED) -> DataFrame:
    return embeddings(spark, sf_dir).where(which).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def _knn_sql(metric: str = COSINE, which: str = FIVE) -> str:
    return f"WITH {ops_v_sql('')}, d AS (SELECT e.vec_id AS qid, l.key, {d_sql('l.embedding', 'e.embedding', metric)} AS distance FROM live l, embeddings e WHERE e.{which}) SELECT qid, key, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, key) AS rank FROM d QUALIFY rank <= 10"


def _knn(join, metric: str, which: str):
    def run(spark, sf_dir):
        return join(live_vectors(spark, sf_dir, ""), _queries(spark, sf_dir, which), 10, metric, DIGITS).withColumn("rank", F.col("rank").cast("long"))

    return run, _knn_sql(metric, which)


for _name, _args in {
    "vec_knn_join": (knn.knn_join, COSINE, FIVE), "vec_knn_join_l2sq": (knn.knn_join_columns, EUCLIDEAN_SQUARED, FIVE),
    "vec_knn_join_all": (knn.knn_join, COSINE, ASKED), "vec_knn_join_l2sq_all": (knn.knn_join, EUCLIDEAN_SQUARED, ASKED),
}.items():
    QUERIES[_name], ORACLES[_name] = _knn(*_args)


@query("SELECT * FROM (VALUES (1, NULL), (2, 'empty'), (3, 'non-finite'), (4, 'non-finite'), (5, 'dimension'), (6, 'zero norm'), (7, 'empty')) t(id, problem)")
def vec_validate(spark, sf_dir):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, []), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [0.0, 0.0]), (7, None)]
    return spark.createDataFrame(rows, "id int, v array<float>").select("id", distance.problem(F.col("v"), COSINE, 2).alias("problem"))


def _ivf(spark, sf_dir, share: float = 0.75):
    """Every fiftieth row's nearest over a built index of 16 cells, of which that share is read: vectors without clusters need so many for a recall of 0.9."""
    rows = embeddings(spark, sf_dir).select(_key(), F.col("vec_id").alias("seq"), "embedding")
    index = ivf.IvfIndex.build(rows, f"{files.scratch(spark, 'ivf')}/index", LATER, cells=16)
    return ivf.ivf_join(index, _queries(spark, sf_dir), 10, max(1, round(len(index.centroids) * share)), rows, DIGITS)


@query()
def vec_ivf_nearest(spark, sf_dir):
    return _ivf(spark, sf_dir)


@query(_knn_sql(COSINE, ASKED))
def vec_ivf_exhaustive(spark, sf_dir):
    """All cells read: what an exact search finds."""
    return _ivf(spark, sf_dir, 1.0).withColumn("rank", F.col("rank").cast("long"))


def _ivf_recall(spark, sf_dir):
    return knn.recall(_ivf(spark, sf_dir), knn.knn_join(live_vectors(spark, sf_dir, ""), _queries(spark, sf_dir), 10, digits=DIGITS), 10)


@query()
def vec_ivf_recall(spark, sf_dir):
    return _ivf_recall(spark, sf_dir)


@query("SELECT true AS nine_tenths")
def vec_ivf_recall_holds(spark, sf_dir):
    return _ivf_recall(spark, sf_dir).select((F.col("recall") >= 0.9).alias("nine_tenths"))


# the store: written, closed, opened again and read


def _ops(spark, sf_dir) -> DataFrame:
    """All operations, in order of ordinal."""
    log = ops_e(spark, sf_dir)
    return log.select(F.col("key").cast("binary").alias("key"), F.col("kind").cast("byte").alias("kind"), F.when(F.col("kind") == 1, F.coalesce(F.col("value"), F.lit(""))).cast("binary").alias("value"), F.col("seq").alias("ordinal"))


def _store(spark, sf_dir, batches: int = 3, trigger: int = 100) -> str:
    """A store of all operations, written as so many batches of them in order; closed."""
    path = files.scratch(spark, "store")
    s = Store(spark, StoreOptions(path, l0_compaction_trigger=trigger))
    ops = _ops(spark, sf_dir)
    last = ops.agg(F.max("ordinal")).first()[0] + 1
    for b in range(batches):
        s.put_many(ops.where((F.col("ordinal") >= last * b // batches) & (F.col("ordinal") < last * (b + 1) // batches)))
    s.close()
    return path


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


STORED = f"WITH {OPS_E}, {LATEST}, stored AS (SELECT key, CASE WHEN kind <> 2 THEN coalesce(value, '') END AS value, kind FROM winner)"


@query(f"{STORED} SELECT key, value FROM stored WHERE kind <> 2")
def store_reopen(spark, sf_dir):
    """Three runs of level 0 behind a manifest."""
    return _text(Store.open(spark, _store(spark, sf_dir)).live())


@query(f"{STORED} SELECT key, value, CAST(0 AS BIGINT) AS level_0, CAST(1 AS BIGINT) AS level_1 FROM stored WHERE kind <> 2")
def store_compacted(spark, sf_dir):
    """The second batch sets off a compaction, and so does the fourth."""
    s = Store.open(spark, _store(spark, sf_dir, 3, 2))
    s.compact()
    zero, one = s.level_counts()
    return _text(s.log()).withColumns({"level_0": F.lit(zero).cast("long"), "level_1": F.lit(one).cast("long")})


LAST = 30


def _single_writes(spark, sf_dir) -> Store:
    """A store with all operations but the last LAST as a batch, and those one by one; closed and opened again."""
    path = files.scratch(spark, "store")
    s = Store.open(spark, path)
    ops = _ops(spark, sf_dir)
    last = ops.agg(F.max("ordinal")).first()[0]
    s.put_many(ops.where(F.col("ordinal") <= last - LAST))
    for r in ops.where(F.col("ordinal") > last - LAST).orderBy("ordinal").collect():  # LAST rows
        s.delete(bytes(r.key)) if r.kind == 2 else s.put(bytes(r.key), bytes(r.value))
    s.close()
    return Store.open(spark, path)


@query(f"{STORED} SELECT key, value, (SELECT CAST(count(DISTINCT key) AS BIGINT) FROM ops_e WHERE seq > (SELECT max(seq) FROM ops_e) - {LAST}) AS pending FROM stored WHERE kind <> 2")
def store_replay(spark, sf_dir):
    """What the log of single writes holds after a reopen, over a run."""
    s = _single_writes(spark, sf_dir)
    return _text(s.live()).withColumn("pending", F.lit(s.pending_len()).cast("long"))


@query(f"{STORED} SELECT key, value, CAST(0 AS BIGINT) AS pending, CAST(2 AS BIGINT) AS runs FROM stored WHERE kind <> 2")
def store_flush(spark, sf_dir):
    """The replayed buffer as a run."""
    s = _single_writes(spark, sf_dir)
    s.flush()
    s = Store.open(spark, s.path)
    return _text(s.live()).withColumns({"pending": F.lit(s.pending_len()).cast("long"), "runs": F.lit(s.run_count()).cast("long")})


@query(f"{STORED}, k AS (SELECT concat('user_', i // 7 + 1, ':slot_', i % 8) AS key FROM range(0, 200) r(i)) SELECT k.key, s.value FROM k LEFT JOIN stored s ON s.key = k.key")
def store_multi_get(spark, sf_dir):
    keys = spark.range(200).select(F.concat(F.lit("user_"), F.floor(F.col("id") / 7) + 1, F.lit(":slot_"), F.col("id") % 8).cast("binary").alias("key"))
    return _text(Store.open(spark, _store(spark, sf_dir)).multi_get(keys))


@query(f"{STORED}, p AS (SELECT min(key) FILTER (kind <> 2) AS hit, min(key) FILTER (kind = 2) AS deleted FROM stored) SELECT 'hit' AS case_name, (SELECT value FROM stored WHERE key = hit) AS value FROM p UNION ALL SELECT 'deleted', NULL UNION ALL SELECT 'missing', NULL")
def store_get(spark, sf_dir):
    """Point reads, by key bounds and Bloom filters of the runs."""
    s = Store.open(spark, _store(spark, sf_dir))
    first = merge.latest(ops_e(spark, sf_dir), KV).agg(F.min(F.when(F.col("kind") != 2, F.col("key"))).alias("hit"), F.min(F.when(F.col("kind") == 2, F.col("key"))).alias("deleted")).first()
    found = {"hit": first.hit and s.get(first.hit.encode()), "deleted": first.deleted and s.get(first.deleted.encode()), "missing": s.get(b"user_none:slot_0")}
    return spark.createDataFrame([(k, v.decode() if v is not None else None) for k, v in found.items()], "case_name string, value string")


@query(f"{STORED} SELECT key, value FROM stored WHERE kind <> 2 AND key >= 'user_1' AND key < 'user_2'")
def store_scan(spark, sf_dir):
    return _text(Store.open(spark, _store(spark, sf_dir)).scan(b"user_1", b"user_2"))


def _vector_store(spark, sf_dir) -> Store:
    """A store of the vectors with an index, and the operations after them as a newer run; opened again."""
    path = files.scratch(spark, "vectors")
    s = Store(spark, StoreOptions(path, vectors=VectorOptions(cells=16, probes=16)))
    rows = ops_v(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), F.col("kind").cast("byte").alias("kind"), F.col("value").cast("binary").alias("value"), "embedding", F.col("seq").alias("ordinal"))
    s.put_many(rows.where(F.col("ordinal") < LATER))
    s.build_index()
    s.put_many(rows.where(F.col("ordinal") >= LATER))
    s.close()
    return Store(spark, StoreOptions(path, vectors=VectorOptions(cells=16, probes=16)))


def _store_nearest(approximate: bool):
    def run(spark, sf_dir):
        s = _vector_store(spark, sf_dir)
        found = s.nearest(_query_vector(spark, sf_dir), 10, approximate)
        return spark.createDataFrame([(k.decode(), round(d, 4) + 0.0) for k, d in found], "key string, distance double")

    return run, f"SELECT key, round(distance, 4) + 0.0 AS distance FROM ({ORACLES['vec_snapshot_plus_delta']})"


QUERIES["store_nearest"], ORACLES["store_nearest"] = _store_nearest(False)
QUERIES["store_nearest_index"], ORACLES["store_nearest_index"] = _store_nearest(True)


@query(f"WITH {ops_v_sql()} SELECT (SELECT count(*) FROM live) AS vectors, (SELECT count(DISTINCT key) FROM ops_v WHERE kind = 3) AS with_deleted, CAST(64 AS BIGINT) AS dim, 'cosine' AS metric")
def store_counters(spark, sf_dir):
    s = _vector_store(spark, sf_dir)
    return spark.createDataFrame([(s.vector_count(), s.vector_count_with_deleted(), s.dim, s.metric)], "vectors long, with_deleted long, dim long, metric string")


# quantizer

BOUNDS = "b AS (SELECT CAST(i AS INTEGER) AS dim, min(embedding[i + 1]) AS low, max(embedding[i + 1]) AS high FROM embeddings, range(0, 64) r(i) GROUP BY i)"
CODE = "CASE WHEN high::DOUBLE - low::DOUBLE = 0 THEN 0 ELSE greatest(0, least(255, round((embedding[dim + 1]::DOUBLE - low) / (high::DOUBLE - low::DOUBLE) * 255))) END"


def _quantizer(spark, sf_dir) -> quantize.ScalarQuantizer:
    return quantize.ScalarQuantizer.train(embeddings(spark, sf_dir))


@query("SELECT CAST(i AS INTEGER) AS dim, min(embedding[i + 1]) AS min, max(embedding[i + 1]) AS max FROM embeddings, range(0, 64) r(i) GROUP BY i")
def q_train(spark, sf_dir):
    return quantize.extremes(embeddings(spark, sf_dir))


@query(f"WITH {BOUNDS} SELECT vec_id, dim, CAST({CODE} AS INTEGER) AS code FROM embeddings, b")
def q_quantize(spark, sf_dir):
    codes = _quantizer(spark, sf_dir).quantize(F.col("embedding"), "double")
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(codes).alias("dim", "code")).withColumn("code", F.col("code").cast("int"))


@query(f"WITH {BOUNDS}, c AS (SELECT dim, low, high, embedding[dim + 1]::DOUBLE AS x, {CODE} AS code FROM embeddings, b) SELECT dim, round(max(abs(low + code / 255 * (high::DOUBLE - low::DOUBLE) - x)), 6) AS error, bool_and(abs(low + code / 255 * (high::DOUBLE - low::DOUBLE) - x) <= (high::DOUBLE - low::DOUBLE) / 510 + 1e-9) AS within FROM c GROUP BY dim")
def q_roundtrip_error(spark, sf_dir):
    q = _quantizer(spark, sf_dir)
    both = embeddings(spark, sf_dir).select(F.posexplode(F.arrays_zip(F.col("embedding").alias("x"), q.round_trip(F.col("embedding"), "double").alias("y"))).alias("dim", "p"))
    error = F.abs(F.col("p.y") - F.col("p.x").cast("double"))
    span = F.get(F.array(*[F.lit(float(b) - float(a)) for a, b in zip(q.low, q.high)]), F.col("dim"))
    return both.groupBy("dim").agg(F.round(F.max(error), 6).alias("error"), F.bool_and(error <= span / 510 + 1e-9).alias("within"))


@query("SELECT CAST(sum(4 * len(embedding)) AS BIGINT) AS bytes, CAST(sum(len(embedding)) AS BIGINT) AS quantized_bytes, sum(4 * len(embedding))::DOUBLE / sum(len(embedding)) AS ratio FROM embeddings")
def q_compression(spark, sf_dir):
    code = _quantizer(spark, sf_dir).quantize(F.col("embedding"))
    whole, small = F.sum(4 * F.size("embedding")), F.sum(F.size(code))
    return embeddings(spark, sf_dir).agg(whole.alias("bytes"), small.alias("quantized_bytes"), (whole / small).alias("ratio"))


def _quantized_recall(which: str):
    def run(spark, sf_dir):
        v = embeddings(spark, sf_dir).select(F.col("vec_id").alias("key"), "embedding")
        coded = v.select("key", _quantizer(spark, sf_dir).round_trip(F.col("embedding"), "double").alias("embedding"))
        asked = _queries(spark, sf_dir, which)
        got = knn.recall(knn.knn_join(coded, asked, 10, digits=DIGITS), knn.knn_join(v, asked, 10, digits=DIGITS), 10)
        return got.select(F.round("recall", 6).alias("recall"))

    sql = (
        f"WITH {BOUNDS}, c AS (SELECT vec_id, list(low + {CODE} / 255 * (high::DOUBLE - low::DOUBLE) ORDER BY dim) AS embedding FROM embeddings, b GROUP BY vec_id), "
        f"e AS (SELECT q.vec_id AS qid, v.vec_id AS id, {d_sql('v.embedding', 'q.embedding', COSINE)} AS d FROM embeddings q, embeddings v WHERE q.{which} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id) <= 10), "
        f"a AS (SELECT q.vec_id AS qid, v.vec_id AS id, {d_sql('v.embedding', 'q.embedding', COSINE)} AS d FROM embeddings q, c v WHERE q.{which} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id) <= 10) "
        "SELECT round(avg(r), 6) AS recall FROM (SELECT e.qid, count(a.id) / 10.0 AS r FROM e LEFT JOIN a ON a.qid = e.qid AND a.id = e.id GROUP BY e.qid)"
    )
    return run, sql


for _name, _which in {"q_recall": FIVE, "q_recall_all": ASKED}.items():
    QUERIES[_name], ORACLES[_name] = _quantized_recall(_which)


# filter and codecs


def _filter(spark, sf_dir):
    keys = ops_e(spark, sf_dir).select("key").distinct()
    return keys, bloom.Bloom.build(keys, keys.count())


@query(f"WITH {OPS_E} SELECT count(DISTINCT key) AS keys, CAST(0 AS BIGINT) AS missed FROM ops_e")
def bloom_no_false_negative(spark, sf_dir):
    keys, f = _filter(spark, sf_dir)
    return f.probe(keys).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.when(F.col("maybe"), 0).otherwise(1)).cast("long").alias("missed"))


@query("SELECT CAST(10000 AS BIGINT) AS probes, true AS under_5_percent")
def bloom_fpp(spark, sf_dir):
    _, f = _filter(spark, sf_dir)
    absent = spark.range(10_000).select(F.concat(F.lit("absent_"), F.col("id")).alias("key"))
    return f.probe(absent).agg(F.count(F.lit(1)).alias("probes"), (F.sum(F.when(F.col("maybe"), 1).otherwise(0)) < 500).alias("under_5_percent"))


@query(f"WITH {OPS_E} SELECT seq, true AS crc_same, true AS parts_same, CAST(13 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) AS INTEGER) AS n_bytes FROM ops_e")
def wal_record_crc(spark, sf_dir):
    """Every operation as a log record: its checksum as the JVM computes it, and its parts read back."""
    log = ops_e(spark, sf_dir).select("seq", F.col("kind").cast("int").alias("kind"), F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))
    log = log.withColumn("bytes", codec.record(F.col("kind"), F.col("key"), F.col("value")))
    stored = F.concat(*[F.hex(F.substring("bytes", i, 1)) for i in (4, 3, 2, 1)])
    same = F.conv(stored, 16, 10).cast("long") == codec.record_crc(F.col("kind"), F.col("key"), F.col("value"))
    parts = codec.record_parts(F.col("bytes"))
    log = log.withColumn("crc_same", same).withColumn("parts", parts)
    whole = (F.col("parts.kind") == F.col("kind")) & (F.col("parts.key") == F.col("key")) & (F.col("parts.value") == F.col("value"))
    return log.select("seq", "crc_same", whole.alias("parts_same"), F.octet_length("bytes").alias("n_bytes"))


@query("SELECT vec_id, true AS same, CAST(4 * len(embedding) AS INTEGER) AS n_bytes FROM embeddings")
def vec_codec_roundtrip(spark, sf_dir):
    v = embeddings(spark, sf_dir).withColumn("bytes", codec.vector_bytes("embedding"))
    return v.select("vec_id", (codec.bytes_vector("bytes") == F.col("embedding")).alias("same"), F.length("bytes").alias("n_bytes"))


@query("SELECT vec_id, round(" + PAIR_DOT.format(a="embedding", b="embedding") + ", 6) AS squared_norm FROM embeddings")
def vec_squared_norm(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding"), "double"), 6).alias("squared_norm"))
