import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from foreunc.llm import queries, topk, toxicity

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def brute(rows, ids, k, scale=1024):
    whole = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    out = []
    for q in ids:
        asked = min(v for i, v in rows if i == q)
        a = [int(np.floor(scale * float(x))) for x in asked]
        found = [(-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, v, strict=True)))), i)
                 for i, v in whole if i != q and len(v) == len(a)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_top_k_of_odd_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-3, 4, 4) / 4]) for i in range(60)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (100, [0.5, 0.25, 1.0, 1.0]), (100, [0.25, 0.0, -1.0, 1.0])]
    rows += [(200, [1e30, -1e30, 1e15, 3.0]), (201, [1.0, 2.0]), (202, [0.5, -2.0]), (203, []), (204, [])]
    bad = [(None, [1.0] * 4), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4)]
    frame = spark.createDataFrame(
        [(i, v, "l", 1) for i, v in rows + bad], "vec_id bigint, embedding array<double>, lane string, rank int"
    )
    asked = F.col("vec_id").isin(0, 7, 100, 200, 201, 203, 300)
    for lanes in (1, 3, 40):
        got = topk.top_k(frame, asked, k=5, lanes=lanes).collect()
        assert sorted(map(tuple, got)) == brute(rows, [0, 7, 100, 200, 201, 203], 5)
    assert topk.top_k(frame.filter("false"), asked).collect() == []
    whole = spark.createDataFrame([(0, [1, 2]), (1, [3, -1])], "vec_id bigint, embedding array<int>")
    assert [tuple(r) for r in topk.top_k(whole, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 1024)]


def test_tiles_smaller_than_the_table(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_TILE", 16)
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 3)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, range(0, 200, 10), 7)


def test_copies_of_queries_do_not_outgrow_the_rows(spark):
    """Every lane gets all queries, so there are no more lanes than rows for a query, whatever the session deals to."""
    vectors = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 0.5).alias("embedding"))
    key, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 900)
        assert topk.lanes_for(vectors, F.col("vec_id") % 100 == 0) == max(100, cores)
        assert topk.lanes_for(vectors, F.col("vec_id") >= 0) == cores
        assert topk.lanes_for(vectors, F.lit(False)) == 900
        spark.conf.set(key, 1)
        assert topk.lanes_for(vectors, F.col("vec_id") % 100 == 0) == 1
    finally:
        spark.conf.set(key, before)


def test_best_of_many_tiles(monkeypatch):
    """What a lane holds after some tiles are the best of all, by each way of taking products, ties too."""
    monkeypatch.setattr(topk, "BLOCK", 3)
    draw = np.random.default_rng(8)
    for scale, kind in ((1.0, np.float32), (1e5, np.float64), (1e8, np.int64)):
        rows = [(int(i), [float(x) for x in v]) for i, v in zip(draw.permutation(40).repeat(2), draw.integers(-3, 4, (80, 3)), strict=True)]
        asks = np.array([rows[i][1] for i in range(7)]) * scale
        best = topk.Best(np.array([rows[i][0] for i in range(7)]), 4)
        for at in range(0, 80, 9):
            some = sorted(rows[at : at + 9])
            tile = np.array([v for _, v in some]) * scale
            best.meet(asks, np.array([i for i, _ in some]), tile)
        assert topk.products(asks, tile).dtype == kind
        for n in range(7):
            found = [(-sum(int(x) * int(y * scale) for x, y in zip(asks[n], v, strict=True)), i) for i, v in rows if i != rows[n][0]]
            assert [(-s, i) for s, i in zip(best.score[n].tolist(), best.vec_id[n].tolist(), strict=True)] == sorted(found)[:4]
        told = best.rows(5)
        assert told.num_rows == 28 and set(told.column("branch").to_pylist()) == {5}


def test_top_k_matches_sql(spark):
    for name in ("op4_top_k",):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
        want = con.sql(queries.ORACLES[name])
        got = queries.REGISTRY[name](spark, SMALL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pooling_matches_a_plain_loop(monkeypatch):
    draw = np.random.default_rng(2)
    model = toxicity.Classifier(
        draw.standard_normal((toxicity.BUCKETS, toxicity.DIMS)).astype(np.float32),
        [draw.standard_normal((w, toxicity.DIMS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
        np.zeros(24, np.float32), np.ones(24, np.float32), 0.0, np.zeros((toxicity.BUCKETS, 1)), np.zeros(1),
    )
    counts = np.array([0, 1, 2, 5, 40, 0, 3])
    pairs = draw.integers(0, toxicity.BUCKETS, (counts.sum(), 2))
    want, at = [], 0
    for n in counts:
        words = model.embedding[pairs[at : at + n]].sum(axis=1).reshape(-1, toxicity.DIMS)
        padded = np.concatenate([words, np.zeros((toxicity.WIDTHS[-1], toxicity.DIMS))])
        at += n
        row = []
        for w, f in zip(toxicity.WIDTHS, model.filters, strict=True):
            places = range(len(padded) - w + 1)
            row.append(np.max([sum(padded[i + j] @ f[j] for j in range(w)) for i in places], axis=0))
        want.append(np.concatenate(row))
    for part in (1 << 15, 7, 1):
        monkeypatch.setattr(toxicity, "PART_WORDS", part)
        got = model.pooled(pairs, counts, model.tables())
        assert np.allclose(got, want, atol=1e-4)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.REGISTRY["op9_toxicity"](spark, SMALL).collect()}
    docs = queries.table(spark, SMALL, "documents")
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    marks = [r for r in queries.table(spark, SMALL, "labels").collect() if got[r.doc_id].held_out]
    right = np.mean([got[r.doc_id].predicted == r.toxic for r in marks])
    assert right >= 0.9


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "you idiot moron" if i % 2 else "a fine day", None) for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (None, "idiot", "en"), (1, "you idiot moron", None), (102, "idiot " * 90000, "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 7), (999, 1)], "doc_id bigint, toxic int"
    )
    model = toxicity.train(docs, labels, F.lit(True))
    got = [(r.doc_id, r.predicted) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows)
    assert all(p == i % 2 for i, p in got if i is not None and i < 40)
    assert dict(got)[102] == 1 and dict(got)[100] == dict(got)[101] == 0
    assert toxicity.score(docs.filter("false"), model).collect() == []
    none = toxicity.train(docs, labels.filter("false"), F.lit(True))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def plain_cut(logit, marks, weight):
    best = None
    edges = sorted(set(logit))
    for low, high in zip([edges[0] - 1, *edges], [*edges, edges[-1] + 1]):
        errors = round(sum(weight[m] for x, m in zip(logit, marks) if (x > low) != m), 6)
        if best is None or (errors, low - high, low) < best[0]:
            best = (errors, low - high, low), (low + high) / 2
    return best[1]


def test_cuts_against_loops(spark):
    draw = np.random.default_rng(4)
    rows = [(int(draw.integers(0, 3)), float(draw.integers(-40, 40)) / 8 + 2 * m, m) for m in (0, 1) for _ in range(150 * (3 - m))]
    rows += [(3, 0.5, 0), (3, 0.75, 0)]
    shares = np.array([5000.0, 200.0])
    weight = shares / np.array([sum(m == c for _, _, m in rows) for c in (0, 1)])
    frame = spark.createDataFrame([(s, x, m) for t, x, m in rows for s in (t, -1)], "spoken bigint, logit double, m int")
    frame = frame.groupBy("spoken", "logit").agg(F.sum("m").alias("toxic"), F.sum(1 - F.col("m")).alias("clean"))
    got = toxicity.cuts(frame, shares)
    assert sorted(got) == [-1, 0, 1, 2]
    for s, cut in got.items():
        mine = [(x, m) for t, x, m in rows if s in (t, -1)]
        assert abs(cut - plain_cut([x for x, _ in mine], [m for _, m in mine], weight)) < 1e-9


def test_rare_languages_have_words_and_thresholds(spark, monkeypatch):
    """A language that is absent from the sample is told apart by its words and gets its own cut."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 16)
    common = [(i, "fool day walk tree" if i % 2 else "fine day walk tree", "en") for i in range(400)]
    ids = [r[0] for r in spark.range(1000, 3000).orderBy(F.xxhash64("id").desc()).limit(40).collect()]
    # In the other language, the word that is toxic in the first is a common one.
    rare = [(i, "fool haus baum weg" if n % 2 else "fool haus baum weg idiota", "de") for n, i in enumerate(ids)]
    marks = [(i, i % 2) for i, _, _ in common] + [(i, 1 - n % 2) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(common + rare, "doc_id bigint, text string, lang string").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.languages.shape[1] == len(model.thresholds) == 2
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    wrong_clean = sum(got[i] != m for i, m in marks if m == 0)
    assert wrong_clean == 0 and all(got[i] == m for i, m in marks if i < 400)
