import random
import re
import zlib

import duckdb

from foreunc.llm import queries, spelling

SMALL = "/root/testdata/sf0.01"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def edits(word, alphabet):
    """All words one edit away."""
    places = range(len(word) + 1)
    found = {word[:i] + c + word[i:] for i in places for c in alphabet}
    found |= {word[:i] + c + word[i + 1 :] for i in places[:-1] for c in alphabet}
    return (found | {word[:i] + word[i + 1 :] for i in places[:-1]}) - {word}


def plain_counts(rows, shortest, fewest, slip):
    counts = {}
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}


def plain(counts, times):
    alphabet = {c for w in counts for c in w}
    forms, out = {}, []
    near = {w: [x for x in edits(w, alphabet) if x in counts] for w in counts}
    for word, n in counts.items():
        best = min(near[word], key=lambda x: (-counts[x], x), default=None)
        forms[word] = best if best and counts[best] >= times * n else None
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        out.append((word, forms[word], root, n, len(near[word]), counts.get(forms[word])))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def corpus():
    draw = random.Random(1)
    base = ["".join(draw.choices("abcéÉÿ×", k=draw.randint(5, 9))) for _ in range(40)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(draw.randint(0, 60)):
            w = base[min(int(draw.expovariate(0.2)), 39)]
            if draw.random() < 0.3:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("ab") + w[at:], w[:at] + "c" + w[at + 1 :]])
            words.append(draw.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, draw.choice([" ", ", ", "1", "\n"]).join(words)))
    return [*rows, (None, rows[0][1]), (None, None), (500, None), (501, ""), rows[5], rows[5]]


def test_variants_equal_plain_search(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n bigint")
    for slip in (3, None):
        got = result(spelling.spelling_variants(docs, 4, 2, 3, slip))
        assert got == plain(plain_counts(rows, 4, 2, slip), 3)
        assert any(r[1] for r in got)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 3000
    words = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "caaaaa": 5, "aaaaaaa": 7, "zzzzzz": 9}
    # Equal letters in a row: leaving out any of them is one neighbour. Digests from 64 letters on.
    words |= {"x" * 63: 2, "x" * 64: 20, "x" * 65: 200, "x" * 62 + "yx": 3}
    words |= {long: 4, long[:700] + long[701:]: 40, long[:2000] + "é" + long[2001:]: 400}
    got = result(spelling.variants(spark.createDataFrame([*words.items(), (None, 3)], "word string, n bigint"), 5))
    assert got == plain(words, 5)
    by_word = {r[0]: r for r in got}
    assert by_word["aaaaaa"][1:3] == ("aaaaaaa", "aaaaaaa")
    assert by_word["aaaaab"][1:3] == ("aaaabb", "aaabbb")
    assert by_word["x" * 63][1:3] == ("x" * 64, "x" * 65)
    assert by_word[long][1] == long[:2000] + "é" + long[2001:]


def test_digests_and_slices_agree():
    for word in (b"abcabc", b"aaaa", b"a", bytes(range(97, 123)) * 4):
        skip, full = spelling.prefix_digests(word)
        twice = (word + b"\0") * 2
        slices = [twice[i + 1 : i + 1 + len(word)] for i in range(len(word))]
        assert len(set(skip)) == len(set(slices)) and len(set(full)) == len(word) + 1
        changed, _ = spelling.prefix_digests(b"z" + word[1:])
        assert changed[0] == skip[0] and (word[:1] == b"z" or not set(changed[1:]) & set(skip[1:]))
        shorter = spelling.prefix_digests(word[1:])[1] if len(word) > 1 else []
        assert not shorter or skip[0] in shorter


def test_long_texts_in_pieces(spark, monkeypatch):
    rows = [(1, "hello World " * 500), (2, "a" * 3000 + " world"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(spelling, "PIECE", 100)
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 2)
    got = {tuple(r) for r in spelling.count_words(docs, 1, 1, 7).collect()}
    assert got == set(plain_counts(rows, 1, 1, 7).items())


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_equals_sql(spark):
    got = result(queries.op11_spelling_variants(spark, SMALL))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
        want = db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op11_spelling_variants']})").fetchall()
    assert got == sorted(want, key=lambda r: r[0])
