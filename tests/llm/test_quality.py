import math
import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from foreunc.llm import quality, queries

SF = "/root/testdata/sf0.1"


def plain_numbers(text):
    """Numbers of n-grams one by one."""
    mask, mix, found = (1 << 64) - 1, int(quality.MIX), []
    tokens = [zlib.crc32(t) for t in quality.TOKENS.findall(text)]
    for i, t in enumerate(tokens):
        found.append((t * mix & mask) >> (64 - quality.BITS))
        if i:
            two = ((tokens[i - 1] * mix + t + 1) & mask) * mix & mask
            found.append(two >> (64 - quality.BITS))
            if tokens[i - 1] == t:
                found.append(quality.TWICE)
    return sorted(found)


def test_ngrams_equal_a_loop_whatever_the_pieces(monkeypatch):
    texts = [b"", b" \n", b"one", "Ünï ünï  a!!! a!!!\tb b b".encode(), b"x,y" * 400, b"word " * 300, b"##" * 1000]
    want = [plain_numbers(t) for t in texts]
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(quality, "PIECE", size)
        cache = quality.TokenHashes()
        assert [sorted(x for part in quality.grams(t, cache) for x in part.tolist()) for t in texts] == want


def test_updates_equal_a_loop():
    draw = np.random.default_rng(0)
    texts = [(np.sort(draw.choice(30, 6, replace=False)), draw.random(6)) for _ in range(20)]
    marks = draw.integers(0, 2, 20)
    got = quality.follow_leader(texts, marks, np.random.default_rng(3))
    order, z, n = np.random.default_rng(3), {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        shrunk = z[k] - math.copysign(quality.L1, z[k])
        return -shrunk / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for i in order.permutation(20):
            row = {**dict(zip(texts[i][0].tolist(), texts[i][1].tolist(), strict=True)), 1 << quality.BITS: 1.0}
            w = {k: weight(k) for k in row}
            p = 1 / (1 + math.exp(-sum(w[k] * x for k, x in row.items())))
            for k, x in row.items():
                g, old = (p - marks[i]) * x, n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / quality.ALPHA * w[k]
    assert np.allclose([got[k] for k in sorted(z)], [weight(k) for k in sorted(z)])
    assert np.count_nonzero(got) <= len(z)


def rows(draw, count):
    words = ["tree", "river", "stone", "cloud", "été"]
    out = []
    for i in range(count):
        good = draw.random() < 0.7
        ends = [""] if good else ["!!", "##"]
        text = " ".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.randint(3, 30)))
        out.append((i, text, int(good)))
    return out


def test_labels_nulls_and_copies(spark):
    found = rows(random.Random(2), 300)
    texts = [(i, t, "x", 1.0) for i, t, _ in found] + [(5, found[5][1], "x", 1.0)] * 50
    texts += [(None, "tree", "", 0.0), (900, None, "", 0.0), (901, "", "", 0.0)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, quality string, score double")
    marks = [(i, q, 0) for i, _, q in found[:200]] + [(None, 0, 0), (3, None, 0), (4, 7, 0)]
    marks += [(900, 1, 0), (901, 0, 0), (901, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels, F.col("doc_id") < 250)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(texts) and len({r.score for r in scored if r.doc_id == 5}) == 1
    by_id = {r.doc_id: r for r in scored}
    assert all(by_id[i].predicted == q for i, _, q in found)
    assert by_id[900].score == by_id[901].score and 0 < by_id[900].score < 1
    again = quality.train(docs.repartition(7), labels, F.col("doc_id") < 250)
    assert np.array_equal(again.weights, model.weights) and again.intercept == model.intercept


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    one = [r.score for r in quality.score(docs, quality.train(docs, labels, F.lit(True))).collect()]
    none = [r.score for r in quality.score(docs, quality.train(docs, labels.limit(0), F.lit(True))).collect()]
    assert np.allclose(one, 2 / 3)
    assert none == [0.5, 0.5]
    empty = quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0), F.lit(True)))
    assert empty.count() == 0


def test_texts_that_do_not_fit_are_passed_over(spark, monkeypatch):
    texts = [(i, "good " * (2 + i)) for i in range(30)] + [(99, "bad!! " * 500)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(99, 0)], "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "TRAIN_BYTES", 300)
    model = quality.train(docs, labels, F.lit(True))
    assert not model.weights.any() and np.isclose(model.intercept, math.log(31 / 2))


def test_held_out_rows_are_told_apart(spark):
    scored = queries.op13_quality(spark, SF).toPandas().set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df().set_index("doc_id")
    held = scored.join(labels, how="inner")
    held = held[held.held_out]
    assert len(scored) == 10_000 and len(held) > 500
    assert (held.predicted == held.quality).mean() > 0.97
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.99
