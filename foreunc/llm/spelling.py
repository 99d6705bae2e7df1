"""Spelling variants: words that differ by one letter, grouped under their most frequent form.

Every word gets a terminator and all its rotations are listed, as in a permuterm index. Rotated so
that an edited letter comes last, two words that differ by a replacement share all that comes before
it; a word that lacks the letter has just that prefix as a rotation of its own. So the rotations are
dealt by that prefix and sorted, and one scan over them meets all neighbours. A prefix fixes the place
of the edit, so at most one word per letter, and one that lacks it, share it: no group grows with the
data.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreunc.llm.common import raw_texts, slices, written

LETTERS = "A-Za-zÀ-ÿ"
#: Code points of a text that are searched at a time.
PIECE = 1 << 20
#: Distinct words a task counts before it hands the counts on.
COUNTED_WORDS = 200_000
#: Longest prefix that stands for itself; a longer one is a digest, so that long words cost no squares.
LITERAL = 64
TERMINATOR = b"\0"
#: Rows that a task hands on at a time.
ROWS = 1 << 16
#: Primes and bases of the digests.
MODULI = ((2147483647, 48271), (2147483629, 69621), (2147483587, 16807), (2147483579, 1226874159))


def pieces(text: str, run: re.Pattern) -> Iterator[tuple[int, int]]:
    """Parts of a text that no run of letters crosses."""
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        cut = run.match(text, to) if to < len(text) else None
        to = cut.end() if cut else to
        yield at, to
        at = to


def count_words(docs: DataFrame, shortest: int, fewest: int, slip: int | None = None) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that stand ``fewest`` times in all texts.

    Words are maximal runs of letters up to U+00FF, of which only A-Z is lower-cased. With ``slip``, one
    letter is left out where the crc32 h of ``<doc_id>:<run>`` is a multiple of it, the one at h modulo
    the run's length; a null id counts as empty there. Null and empty texts have no words, repeated
    rows count each. Tasks count before anything is shuffled, in dictionaries of bounded size; a long
    text is searched piece by piece.
    """
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")
    any_run = re.compile(f"[{LETTERS}]+")

    def total(found: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(found), type=pa.string()), pa.array(list(found.values()), type=pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in slices(batches, "text"):
            for doc_id, raw in zip(part.column("doc_id").to_pylist(), raw_texts(part), strict=True):
                text = raw.lower().decode()
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for at, to in pieces(text, any_run):
                    for word, n in Counter(run.findall(text, at, to)).items():
                        if slip:
                            h = zlib.crc32(word.encode(), start)
                            if h % slip == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                                if len(word) < shortest:
                                    continue
                        found[word] += n
                    if len(found) > COUNTED_WORDS:
                        yield total(found)
                        found.clear()
        if found:
            yield total(found)

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def _powers(base: int, modulus: int, count: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), modulus)) % np.uint64(modulus)])
    return out[:count]


def prefix_digests(word: bytes) -> tuple[list[bytes], list[bytes]]:
    """Digests of what precedes each letter in the rotation that ends with it, and of each rotation.

    Polynomials over the letters, of which all rotations take one pass; two prefixes of a million letters
    get the same digest with probability 1e-13.
    """
    length = len(word)
    codes = np.frombuffer(word, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    skip, full = [], []
    i = np.arange(length + 1)
    for modulus, base in MODULI:
        p = np.uint64(modulus)
        power, inverse = _powers(base, modulus, length + 2), _powers(pow(base, -1, modulus), modulus, length + 2)
        sums = np.zeros(length + 1, dtype=np.uint64)
        np.cumsum(codes * power[:length] % p, out=sums[1:])
        sums %= p
        tail = (sums[-1] + p - sums) % p * inverse[: length + 1] % p
        skip.append((tail[1:] + power[length - 1 - i[:-1]] + sums[:-1] * power[length - i[:-1]] % p) % p)
        full.append((tail + power[length - i] + sums * power[length - i + 1] % p) % p)
    out = []
    for size, parts in ((length, skip), (length + 1, full)):
        rows = np.stack(parts, axis=1).astype("<u4")
        mark = b"\1" + size.to_bytes(8, "little")
        out.append([mark + row.tobytes() for row in rows])
    return out[0], out[1]


def rotated(word: bytes) -> tuple[list[bytes], list[bytes]]:
    """What precedes each letter in the rotation that ends with it, and all rotations."""
    length = len(word)
    twice = (word + TERMINATOR) * 2
    skip = full = None
    if length <= LITERAL:
        skip = [twice[i + 1 : i + 1 + length] for i in range(length)]
    if length < LITERAL:
        full = [twice[i : i + 1 + length] for i in range(length + 1)]
    if skip is None or full is None:
        digests = prefix_digests(word)
        skip, full = skip or digests[0], full or digests[1]
    return skip, full


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edited, once, rank, n): all rotations of ``words`` (word, rank, n).

    ``edited`` is the letter after the prefix, -1 where the prefix is the whole rotation. Of equal letters
    in a row only the first is marked ``once``, as leaving out either gives the same word.
    """
    names = ["prefix", "edited", "once", "rank", "n"]
    kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for part in slices(batches, "word"):
            columns = (part.column(c).to_pylist() for c in ("word", "rank", "n"))
            for word, rank, n in zip(*columns, strict=True):
                raw = word.encode("latin-1")
                skip, full = rotated(raw)
                rows += [(key, raw[i], not i or raw[i] != raw[i - 1], rank, n) for i, key in enumerate(skip)]
                rows += [(key, -1, False, rank, n) for key in full]
                while len(rows) > ROWS:
                    yield batch(rows[:ROWS])
                    del rows[:ROWS]
        if rows:
            yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return words.select("word", "rank", "n").mapInArrow(
        run, "prefix binary, edited int, once boolean, rank bigint, n bigint"
    )


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, near, best_n, best): from sorted rotations each word's neighbours in a group, and the best of them.

    Rows come by prefix, in it the greatest n first, then the least rank. A group's rows are not paired:
    the best neighbour of each is the group's first row, or the second for the first one itself.
    """
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        starts = _starts(batch)
        rest = batch.slice(starts[-1])
        if starts[-1]:
            yield _neighbours(batch.slice(0, starts[-1]), starts[:-1])
    if rest is not None:
        yield _neighbours(rest, np.zeros(1, dtype=np.int64))


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    key = batch.column("prefix")
    other = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], other]))


def _neighbours(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    edited, once, rank, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("edited", "once", "rank", "n"))
    group = np.zeros(batch.num_rows, dtype=np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    out = []

    def add(of: np.ndarray, near: np.ndarray, best: np.ndarray) -> None:
        out.append((rank[of], near, n[best], rank[best]))

    # Replacements: all that share the prefix and have another letter after it.
    rows = np.flatnonzero(edited >= 0)
    size = np.bincount(group[rows], minlength=len(starts))
    rows = rows[size[group[rows]] > 1]
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], group[rows][1:] != group[rows][:-1]]))
        best = np.repeat(rows[first], np.diff(np.append(first, len(rows))))
        best[first] = rows[first + 1]
        add(rows, size[group[rows]] - 1, best)
    # Letters more or less: those that share the prefix, and the word it is a rotation of.
    whole = np.full(len(starts), -1)
    full = np.flatnonzero(edited < 0)
    whole[group[full]] = full
    rows = np.flatnonzero((edited >= 0) & once)
    rows = rows[whole[group[rows]] >= 0]
    if len(rows):
        shorter = whole[group[rows]]
        add(rows, np.ones(len(rows), dtype=np.int64), shorter)
        first = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
        add(shorter[first], np.diff(np.append(first, len(rows))), rows[first])
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(np.int64)) for c in columns], names=["rank", "near", "best_n", "best"]
    )


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), whose words are distinct.

    Near words differ by one inserted, deleted or replaced letter. ``form`` is the near word of greatest n
    (ties: the least in code-point order) if that is at least ``times`` the word's n, else null; ``root``
    is where the forms lead to. Words need letters up to U+00FF; null words are left out.
    """
    ranked = words.filter("word IS NOT NULL").select("word", "n").orderBy("word")
    ranked = written(ranked.withColumn("rank", F.monotonically_increasing_id()), "words")
    sorted_rows = rotations(ranked).repartition("prefix").sortWithinPartitions("prefix", F.desc("n"), "rank")
    near = (
        sorted_rows.mapInArrow(scan, "rank bigint, near bigint, best_n bigint, best bigint")
        .groupBy("rank")
        .agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("top"))
    )
    joined = written(
        ranked.join(near, "rank", "left").select(
            "rank",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(F.col("top.best_n") >= F.col("n") * times, -F.col("top.best")).alias("form_rank"),
        ),
        "near",
    )
    names = ranked.select(F.col("rank").alias("at"), F.col("word").alias("name"), F.col("n").alias("name_n"))
    formed = joined.join(
        names.select(F.col("at").alias("form_rank"), F.col("name").alias("form"), F.col("name_n").alias("form_n")),
        "form_rank",
        "left",
    )
    roots = _roots(joined.filter("form_rank IS NOT NULL").select("rank", F.col("form_rank").alias("root")))
    roots = roots.join(names, F.col("root") == F.col("at")).select("rank", F.col("name").alias("root"))
    return formed.join(roots, "rank", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(rank, root): the last one on the way from each word; every round doubles the steps taken.

    Counts grow on the way by a factor, so that its length is at most the logarithm of the greatest one.
    """
    while True:
        forms = written(forms, "forms")
        after = forms.select(F.col("rank").alias("root"), F.col("root").alias("later"))
        further = forms.join(after, "root", "left")
        if forms.join(after, "root", "left_semi").isEmpty():
            return forms
        forms = further.select("rank", F.coalesce("later", "root").alias("root"))


def spelling_variants(
    docs: DataFrame, shortest: int = 6, fewest: int = 5, times: int = 5, slip: int | None = None
) -> DataFrame:
    """Variants among the words of all texts of ``docs`` (doc_id, text); other columns are ignored.

    See :func:`count_words` and :func:`variants`. Without words the result has no rows.
    """
    return variants(count_words(docs, shortest, fewest, slip), times)
