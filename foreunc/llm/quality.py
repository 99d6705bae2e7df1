"""Quality of documents by a logistic regression over hashed word n-grams.

Weights are fitted with the follow-the-regularised-leader rule, one document at a time: coordinates
keep a sum of gradients and of their squares, and a weight is what these give under an absolute and a
square penalty, zero for n-grams that tell little. A document is its n-grams by their shares, and its
score their sparse dot product with the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreunc.llm.common import lists, raw_texts, slices, written

#: Weights of n-grams, by the bits of their number; the intercept follows them.
BITS = 20
#: Bound of the sample that weights are fitted on: labelled texts of each class, the first by hash that fit in
#: so many rows and bytes. The classes' shares are counted over all labelled rows.
TRAIN_ROWS = 3_000
TRAIN_BYTES = 1 << 23
EPOCHS = 4
#: Rate and penalties of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.1
#: What the shares of a document's n-grams add up to.
SCALE = 20.0
#: Score from which a document counts as good.
CUT = 0.3
WORD = rb"0-9A-Za-z\x80-\xff"
#: Words and runs of signs, and the places between two of them.
TOKENS = re.compile(rb"[%b]+|[^%b\s]+" % (WORD, WORD))
BREAK = re.compile(rb"(?=\s)|(?<=\s)|(?<=[%b])(?![%b])|(?<![%b])(?=[%b])" % (WORD, WORD, WORD, WORD))
#: Bytes of a text whose tokens are taken at a time, and distinct ones a task keeps the hashes of.
PIECE = 1 << 20
CACHE_WORDS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Number of the n-gram that marks a token said twice.
TWICE = 7


class TokenHashes(dict):
    """Hashes of tokens."""

    def __missing__(self, token: bytes) -> int:
        self[token] = value = zlib.crc32(token)
        return value


def numbers(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers of n-grams: the tokens, each with the one before it (-1: none), and a mark where both are the same."""
    place = np.uint64(64 - BITS)
    one = tokens.astype(np.uint64) * MIX
    some = before >= 0
    two = (before[some].astype(np.uint64) * MIX + tokens[some].astype(np.uint64) + np.uint64(1)) * MIX
    again = np.full(int((before == tokens).sum()), TWICE, dtype=np.int64)
    return np.concatenate([(one >> place).astype(np.int64), (two >> place).astype(np.int64), again])


def pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a text that cut no token."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def grams(text: bytes, cache: TokenHashes) -> Iterator[np.ndarray]:
    """Numbers of all n-grams of a text, piece by piece."""
    last = -1
    for piece in pieces(text):
        if len(cache) > CACHE_WORDS:
            cache.clear()
        tokens = np.array([cache[t] for t in TOKENS.findall(piece)], dtype=np.int64)
        if len(tokens):
            yield numbers(tokens, np.concatenate([[last], tokens[:-1]]))
            last = tokens[-1]


@dataclass
class Regression:
    """Weights by number of n-gram, four megabytes whatever the data."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[bytes], cache: TokenHashes) -> np.ndarray:
        """Probability that each text is good; a text without tokens has the intercept's."""
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            total, count = 0.0, 0
            for numbered in grams(text, cache):
                total += float(self.weights[numbered].sum(dtype=np.float64))
                count += len(numbered)
            out[i] = SCALE * total / max(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -30, 30)))


def _sample(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(numbers, shares, quality) of the sample, and labelled rows of each class.

    Ids, hashes and sizes of all labelled rows are written first; the texts that these choose are read then.
    """
    key = F.xxhash64("doc_id", "text").alias("hash")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")
    labelled = written(docs.select("doc_id", key, size).join(marks, "doc_id"), "labelled")
    rows = np.zeros(2)
    for r in labelled.groupBy("quality").count().collect():
        rows[r.quality] = r["count"]
    chosen = []
    for mark in (0, 1):
        first = labelled.filter(F.col("quality") == mark).groupBy("hash", "doc_id").agg(F.max("bytes").alias("bytes"))
        room = TRAIN_BYTES
        for r in first.orderBy("hash", "doc_id").limit(TRAIN_ROWS).collect():
            if r.bytes <= room:
                room -= r.bytes
                chosen.append((r.doc_id, r.hash, mark))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, hash bigint, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenHashes()
        for part in slices(batches, "text"):
            found = []
            for text in raw_texts(part):
                numbered = np.concatenate([np.zeros(0, dtype=np.int64), *grams(text, cache)])
                found.append(np.unique(numbered, return_counts=True))
            sizes = np.array([len(n) for n, _ in found])
            shares = [SCALE * c / max(c.sum(), 1) for _, c in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("hash"),
                    part.column("doc_id"),
                    part.column("quality"),
                    lists(np.concatenate([n for n, _ in found]), sizes, pa.int32()),
                    lists(np.concatenate(shares), sizes, pa.float32()),
                ],
                names=["hash", "doc_id", "quality", "numbers", "shares"],
            )

    texts = docs.select("doc_id", "text", key).join(F.broadcast(chosen), ["doc_id", "hash"])
    columns = f"hash bigint, doc_id {kind}, quality int, numbers array<int>, shares array<float>"
    found = texts.dropDuplicates(["doc_id", "hash"]).select("hash", "doc_id", "quality", "text")
    return found.mapInArrow(run, columns), rows


def train(docs: DataFrame, labels: DataFrame, usable: Column, seed: int = 5) -> Regression:
    """Fit on rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks.

    Rows with a null id, another label than 0 or 1, or outside ``usable`` (a condition on doc_id) are left
    out; of contradicting labels of one id the greater one counts. The sample holds up to TRAIN_ROWS
    texts and TRAIN_BYTES bytes of each class, a text that doesn't fit any more being passed over; the
    classes are weighed back to their shares among all labelled rows. Without texts of both classes
    every document has the share of good rows, one half if there are no labels.
    """
    marks = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    sample, rows = _sample(docs, marks)
    table = sample.toArrow().combine_chunks()
    order = np.lexsort((np.array(table["doc_id"].to_pylist(), dtype=object).astype(str), table["hash"].to_numpy()))
    marked = table["quality"].to_numpy()[order].astype(np.int64)
    seen = np.bincount(marked, minlength=2)
    share = np.log((rows[1] + 1) / (rows[0] + 1))
    model = Regression(np.zeros(1 << BITS, dtype=np.float32), float(share))
    if seen.all():
        texts = [(np.array(table["numbers"][i].values), np.array(table["shares"][i].values)) for i in order.tolist()]
        weights = follow_leader(texts, marked, np.random.default_rng(seed))
        model.weights = weights[:-1].astype(np.float32)
        model.intercept = float(weights[-1] + share - np.log(seen[1] / seen[0]))
    return model


def follow_leader(texts: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray, draw) -> np.ndarray:
    """Weights after EPOCHS passes, that of the intercept last; it alone has no absolute penalty."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at) -> np.ndarray:
        out = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -out / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in draw.permutation(len(texts)):
            at, shares = np.append(texts[i][0], 1 << BITS), np.append(texts[i][1], 1.0)
            now = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(now @ shares, -30, 30))) - marks[i]) * shares
            square = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(square) - np.sqrt(n[at])) / ALPHA * now
            n[at] = square
    return weights(slice(None))


def score(docs: DataFrame, model: Regression) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts have no n-grams and get the intercept's score; repeated rows and null ids stay.
    ``predicted`` is 1 from a score of CUT on. A long text is scored piece by piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Regression(*shared.value), TokenHashes()
        for part in slices(batches, "text"):
            scores = model.scores(raw_texts(part), cache)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
