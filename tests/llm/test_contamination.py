import random

import duckdb
import pytest

from foreunc.llm import contamination, queries

SMALL = "/root/testdata/sf0.01"


def shingles(text, words):
    w = (text or "").lower().replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, items, words=5, share=80):
    def by_id(rows):
        sets = {}
        for i, t in rows:
            if i is not None:
                sets.setdefault(i, set()).update(shingles(t, words))
        return sets

    out = []
    for i, s in by_id(items).items():
        for d, t in by_id(docs).items():
            if s and 100 * len(s & t) >= share * len(s):
                out.append((d, i, len(s & t), len(s)))
    return sorted(out)


def tables():
    draw = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [text(draw.randint(5, 60)) for _ in range(25)]
    docs = []
    for i in range(120):
        words = text(draw.randint(0, 200))
        for item in draw.sample(items, draw.randint(0, 3)):
            planted = list(item)
            for _ in range(draw.randint(0, 3)):
                planted[draw.randrange(len(planted))] = draw.choice(vocabulary)
            at = draw.randint(0, len(words))
            words[at:at] = planted
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, " \n"), (None, " ".join(items[0])), (202, "V1 v2"), docs[3], (3, docs[4][1])]
    docs += [(203, " \n" + "filler " * 50000 + "\n".join(items[1]) + "\n")]
    rows = [(i, " ".join(x)) for i, x in enumerate(items)]
    return docs, [*rows, rows[0], (50, None), (51, ""), (52, "v1 v2"), (None, "v1 v2 v3 v4 v5 v6"), (53, " ".join(items[2]))]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", broadcast_rows)
    docs, items = tables()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, words string, item_id int")
    b = spark.createDataFrame([(*r, 7) for r in items], "item_id bigint, text string, doc_id int")
    got = sorted(map(tuple, contamination.contaminated(d, b).collect()))
    assert got == brute(docs, items) and len(got) > 50
    left = contamination.without_contaminated(d, b)
    bad = {g[0] for g in got}
    assert left.columns == d.columns
    assert sorted(map(repr, left.collect())) == sorted(repr(r) for r in d.collect() if r.doc_id not in bad)
    assert contamination.contaminated(d.filter("false"), b).collect() == []
    assert contamination.contaminated(d, b.filter("false")).collect() == []


def test_op5_matches_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    want = con.sql(queries.ORACLES["op5_decontamination"])
    got = queries.REGISTRY["op5_decontamination"](spark, SMALL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
