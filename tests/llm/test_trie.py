import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foreunc.llm import queries, trie

SMALL = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows, rebuild):
    """The trie as dictionaries of prefixes."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for conv, own in convs.items():
        h = zlib.crc32(str(conv).encode()) % 9 if rebuild else 0
        base = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        whole[conv] = tuple(convs.get(base, [])[:h] + own[h:])
    members, kids = {}, {}
    for conv, said in whole.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(conv)
    sums, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node, convs_in in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs_in if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs_in), len(node), parent, len(convs_in), len(kids.get(node, [])), *sums[node], digest))
    return sorted(out, key=lambda r: r[:2])


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[:2])


def built(turns, rebuild):
    ordered = trie.ordered_turns(turns)
    if not rebuild:
        return trie.trie(trie.whole(ordered))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return trie.trie(trie.rebuilt(ordered, F.col("conv_id") - F.col("conv_id") % 5, head, 8))


def short(draw):
    rows = [
        (c, t, draw.choice(["user", "a"]), draw.choice(["", "b", "çé"]))
        for c in range(200)
        for t in range(draw.randint(0, 12))
    ]
    odd = [(None, 1, "u", "x"), (400, None, None, None), (401, None, "u", "é"), (401, None, "a", "é"), (401, 0, "a", None)]
    return [*rows, *odd, (-7, 1, "u", "q"), (-7, 2, "u", "q"), rows[3], rows[3]]


def long():
    """Conversations over several segments that part in the first, the second or never."""
    return [
        *((1000, t, "u", str(t % 3)) for t in range(700)),
        *((1005, t, "u", str(t % 3)) for t in range(650)),
        *((1010, t, "u", str(t % 3) if t < 300 else "z") for t in range(400)),
        *((1015, t, "u", str(t % 3)) for t in range(2 * trie.DEPTH)),
    ]


@pytest.mark.parametrize("rebuild", [False, True])
def test_equals_dictionaries(spark, rebuild):
    rows = short(random.Random(5)) + long()
    assert result(built(spark.createDataFrame(rows, SCHEMA), rebuild)) == plain(rows, rebuild)


def test_copies_across_tasks_and_divided_matrices(spark, monkeypatch):
    rows = short(random.Random(6)) + [(c, t, "u", f"{t}") for c in range(2000, 2400) for t in range(5)] + long()
    monkeypatch.setattr(trie, "CELLS", 400)
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(trie, "BLOCK", 2)
    assert result(built(spark.createDataFrame(rows, SCHEMA), True)) == plain(rows, True)


def test_other_columns_and_no_rows(spark):
    rows = [(1, 1, "u", "x"), (2, 1, "u", "x")]
    turns = spark.createDataFrame([(*r, 5, "y", 0) for r in rows], SCHEMA + ", depth bigint, x string, total int")
    assert result(trie.conversation_trie(turns)) == plain(rows, False)
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    got = result(queries.op12_conversation_trie(spark, SMALL))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
        want = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op12_conversation_trie']})").fetchall()
    assert got == sorted(want, key=lambda r: r[:2])
