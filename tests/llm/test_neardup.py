import random

import duckdb
import numpy as np
import pytest

from foreunc.llm import common, neardup, queries

SMALL = "/root/testdata/sf0.01"


def plain_set(text, words):
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def plain_components(nodes, links):
    head = {n: n for n in nodes}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, words, similarity=80):
    sets = [(i, plain_set(t, words)) for i, t in rows]
    usable = [(i, s) for i, s in sets if i is not None and s]
    links = [
        (a, b) for n, (a, x) in enumerate(usable) for b, y in usable[:n]
        if 100 * len(x & y) >= similarity * len(x | y)
    ]
    head = plain_components([i for i, _ in sets if i is not None], links)
    out = []
    for i, s in sets:
        component = None if i is None else head[i] if s else i
        out.append((i, len(s), component, i is None or component == i))
    return sorted(out, key=repr)


def corpus():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, seeds = [], [[draw.choice(vocabulary) for _ in range(draw.randint(1, 80))] for _ in range(40)]
    for i in range(400):
        words = list(seeds[i % 40])
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((i * 3, draw.choice([" ", "\n", "  "]).join(words).title() if i % 7 == 0 else " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (None, "w1 w2 w3"), (None, rows[0][1]), rows[6], rows[6]]
    rows += [(6000, "A"), (6001, "a"), (6002, "a b"), (6003, "É x"), (6004, "é x"), (7000, "long " * 60000)]
    return rows


@pytest.mark.parametrize("words", [1, 2, 5])
def test_against_brute_force(spark, words):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, node int, bands string")
    got = neardup.near_duplicates(docs, words=words).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, words)
    assert neardup.near_duplicates(docs.filter("false"), words=words).collect() == []


@pytest.mark.parametrize("small", [0, 16, 1000])
def test_links_between_components_of_a_bucket_count(spark, monkeypatch, small):
    """With one coarse band everything shares a bucket, whose pivots are like few others."""
    monkeypatch.setattr(common, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "band_keys", lambda value, counts: np.zeros((len(counts), 1), dtype=np.int64))
    rows = [r for r in corpus() if r[0] is not None and r[0] < 300] + [(-1, "nothing like it at all here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, neardup.near_duplicates(docs, 2).collect()), key=repr) == brute(rows, 2)


def test_texts_of_one_id_are_judged_each(spark):
    draw = random.Random(3)
    words = lambda: [f"w{draw.randrange(10**6)}" for _ in range(60)]
    a, other = words(), words()
    near = [*a[:-1], "changed"]
    rows = [(1, a, 0), (5, near, 1), (5, other, 2), (5, other, 3), (7, [*other[:-1], "new"], 4), (None, a, 5), (6, None, 6)]
    docs = spark.createDataFrame([(i, t and " ".join(t), n) for i, t, n in rows], "doc_id bigint, text string, key1 int")
    got = neardup.near_duplicates(docs, 2).select("doc_id", "component_id", "kept").collect()
    want = [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (6, 6, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = neardup.without_near_duplicates(docs, 2)
    assert kept.columns == docs.columns and sorted(r.key1 for r in kept.collect()) == [0, 2, 3, 5, 6]


def test_components_of_random_graphs(spark):
    draw = random.Random(9)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = common.components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint"), "a", "b").collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == plain_components(nodes, links)
    assert len(got) == len(nodes)
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert common.components(none, "a", "b").collect() == []


def test_op8_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(queries.ORACLES["op8_near_duplicates"])
    got = queries.REGISTRY["op8_near_duplicates"](spark, SMALL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_far_members_of_a_large_group_make_no_pairs(spark):
    """Copies that each lack other members of one original are far from each other; similar ones are all found."""
    base, rows = range(200), {}
    for i in range(80):
        edits = 22 if i < 60 else 8
        draw = random.Random(i)
        gone = set(draw.sample(base, edits))
        rows[i] = {*(x for x in base if x not in gone), *range(1000 * (i + 1), 1000 * (i + 1) + edits)}
    members = spark.createDataFrame(
        [(i, i, h) for i, s in rows.items() for h in s], "node bigint, component bigint, hash bigint"
    )
    got = {(r.a, r.b) for r in common.across_components(members, 80).collect()}
    near = {
        (i, j) for i in rows for j in rows if i < j and 100 * len(rows[i] & rows[j]) >= 80 * len(rows[i] | rows[j])
    }
    assert near and near <= got and len(got) < 2 * len(near)


def test_components_end_once_all_links_are_stars(spark, monkeypatch):
    """The driver keeps what each table and job leaves; a round that changes nothing isn't run."""
    names = []
    monkeypatch.setattr(common, "written", lambda df, name, keep=common.written: names.append(name) or keep(df, name))
    star = spark.createDataFrame([(1, i) for i in range(2, 9)], "a bigint, b bigint")
    got = {r.node: r.component for r in common.components(star, "a", "b").collect()}
    assert got == dict.fromkeys(range(1, 9), 1)
    assert names.count("links") == 1
    chain = spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "u bigint, v bigint")
    assert not common._are_stars(chain) and not common._are_stars(chain.filter("u = 3"))
    assert not common._are_stars(chain.filter("v <> 1 OR u = 2")) and common._are_stars(chain.filter("v = 1"))
