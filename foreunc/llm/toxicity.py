"""Toxic documents by a convolutional classifier over hashed words, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first letters. Filters
of several widths run over the words, the greatest value of each filter enters a logistic output.
Embeddings start from class counts of the training sample. The document's language is guessed from
its words, which are counted over the whole corpus, and the threshold that was calibrated for that
language on all labelled rows but those of the fit becomes a score of one half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreunc.llm.common import raw_texts, slices, written

BUCKETS = 1 << 17
PREFIX = 4
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bound of the sample that weights are fitted on: labelled texts of each class, the first by hash that fit
#: in so many rows and bytes. Words by language are counted, and thresholds set, on all rows.
TRAIN_ROWS = 2_000
TRAIN_BYTES = 1 << 23
#: Languages with labels of both classes that get a threshold of their own, those of most labelled rows first.
LANGUAGES = 64
#: Labels, under 50 bytes each, up to which they are broadcast; above it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
EPOCHS = 6
STEP = 0.02
#: Share of the sample that takes no part in the fit, so that small corpora have rows for thresholds too.
HELD_BACK = 4
#: Ranges of logits that are summed up by themselves when thresholds are set.
BINS = 64
PUNCTUATION = b".,!?;:\"'()[]{}|#*$%&<>=+/\\~^_-"
#: Distinct words a task keeps the buckets of before it starts anew.
CACHE_WORDS = 200_000
#: Words scored at a time; a longer document is pooled over its parts.
PART_WORDS = 1 << 15


class WordBuckets(dict):
    """Buckets of a word and of its first letters."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        stem = b"^" + word.decode(errors="ignore")[:PREFIX].encode()
        self[word] = pair = (zlib.crc32(word) % BUCKETS, zlib.crc32(stem) % BUCKETS)
        return pair


def bucket_pairs(texts: list[bytes], buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """(words, 2) buckets of all texts in turn, and words per text."""
    if len(buckets) > CACHE_WORDS:
        buckets.clear()
    words = [t.lower().translate(None, PUNCTUATION).split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = [buckets[w] for ws in words for w in ws]
    return np.array(flat, dtype=np.int32).reshape(-1, 2), counts


def bucketed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``buckets``, the pairs of buckets of the whole text in turn, as the bytes of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordBuckets()
        for part in slices(batches, "text"):
            pairs, counts = bucket_pairs(raw_texts(part), cache)
            ends = np.cumsum(counts)
            found = [pairs[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(found, pa.binary())], names=[*keep, "buckets"]
            )

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, buckets binary")


@dataclass
class Classifier:
    """All parameters, a few megabytes whatever the data."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    intercept: float
    languages: np.ndarray
    thresholds: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Per filter width and place in the filter: each bucket's share of the filter's value."""
        return [np.ascontiguousarray(self.embedding @ f[j]) for f in self.filters for j in range(f.shape[0])]

    def pooled(self, pairs: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Greatest value of every filter in every text; texts shorter than a filter are padded."""
        out = np.full((len(counts), len(self.bias)), -np.inf, dtype=np.float32)
        firsts = np.cumsum(counts) - counts
        longest = WIDTHS[-1] - 1
        for text in np.flatnonzero(counts > PART_WORDS):
            for at in range(0, counts[text], PART_WORDS):
                part = pairs[firsts[text] + at : firsts[text] + min(counts[text], at + PART_WORDS + longest)]
                last = at + PART_WORDS >= counts[text]
                pooled = self._pool(part, np.array([len(part)]), tables, None if last else PART_WORDS)
                out[text] = np.maximum(out[text], pooled[0])
        rest = np.flatnonzero(counts <= PART_WORDS)
        at = 0
        while at < len(rest):
            to = at + max(1, int(np.searchsorted(np.cumsum(counts[rest[at:]]), PART_WORDS, side="right")))
            some = rest[at:to]
            words = np.concatenate([pairs[firsts[i] : firsts[i] + counts[i]] for i in some])
            out[some] = self._pool(words, counts[some], tables)
            at = to
        return out

    def _pool(
        self, pairs: np.ndarray, counts: np.ndarray, tables: list[np.ndarray], limit: int | None = None
    ) -> np.ndarray:
        """Zeros stand after every text, as many as the widest filter reaches.

        With a ``limit``, filters start before it only, the words after it being the next part's.
        """
        pad = WIDTHS[-1]
        size = counts + pad
        ends = np.cumsum(size)
        place = np.arange(len(pairs)) + np.repeat(np.arange(len(counts)) * pad, counts)
        starts = ends - size
        out = np.empty((len(counts), len(self.bias)), dtype=np.float32)
        table = iter(tables)
        for n, width in enumerate(WIDTHS):
            value = np.zeros((int(ends[-1]) + width, FILTERS), dtype=np.float32)
            for j in range(width):
                share = next(table)
                # The word at place p is word j of the filter that starts at p - j.
                value[place - j + width] += share[pairs[:, 0]] + share[pairs[:, 1]]
            # Starts before a text's first word fall into the padding before it and are dropped.
            value = value[width : width + int(ends[-1])]
            dropped = (starts[:, None] - 1 - np.arange(width - 1)[None, :]).ravel()
            value[dropped[dropped >= 0]] = 0
            pooled = np.maximum.reduceat(value[:limit], starts, axis=0)
            out[:, n * FILTERS : (n + 1) * FILTERS] = pooled
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.output + self.intercept

    def language(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Language of each text by its words; the first one for texts without words."""
        firsts = np.cumsum(counts) - counts
        out = np.zeros((len(counts), self.languages.shape[1]))
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(self.languages[pairs[:, 0]], firsts[some], axis=0)
        return out.argmax(axis=1)

    def scores(self, pairs: np.ndarray, counts: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        shifted = self.logits(self.pooled(pairs, counts, tables)) - self.thresholds[self.language(pairs, counts)]
        return 1 / (1 + np.exp(-np.clip(shifted.astype(np.float64), -30, 30)))


def _class_counts(texts: list[np.ndarray], marked: np.ndarray) -> np.ndarray:
    """Documents of each class with each bucket."""
    toxic = np.zeros((2, BUCKETS))
    for pairs, mark in zip(texts, marked, strict=True):
        toxic[mark, np.unique(pairs)] += 1
    return toxic


def _sample(docs: DataFrame, labelled: DataFrame) -> tuple[list, list[np.ndarray], np.ndarray]:
    """Ids, buckets and marks of the sample; only its hashes are sorted, then its texts are read."""
    chosen = []
    for mark in (0, 1):
        first = labelled.filter(F.col("toxic") == mark).groupBy("hash", "doc_id").agg(F.max("bytes").alias("bytes"))
        room = TRAIN_BYTES
        for r in first.orderBy("hash", "doc_id").limit(TRAIN_ROWS).collect():
            if r.bytes <= room:
                room -= r.bytes
                chosen.append((r.doc_id, r.hash, mark))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, hash bigint, toxic int")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    texts = keyed.join(F.broadcast(rows), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    found = bucketed(texts, ["doc_id", "hash", "toxic"]).toArrow().combine_chunks()
    ids, hashes = found["doc_id"].to_pylist(), found["hash"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), str(ids[i]), hashes[i]))
    buckets = found["buckets"]
    return (
        [ids[i] for i in order],
        [np.frombuffer(buckets[i].as_py(), dtype=np.int32).reshape(-1, 2) for i in order],
        found["toxic"].to_numpy().astype(np.int64)[order],
    )


def _spoken(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log share of each language's documents with each bucket, over all rows of ``docs`` (text, lang).

    Only words are counted, as a language is guessed by them; one more column stands for all languages
    that aren't listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, places = WordBuckets(), {name: i for i, name in enumerate(languages)}
        found = np.zeros((len(languages) + 1, BUCKETS + 1), dtype=np.int64)
        for part in slices(batches, "text"):
            pairs, counts = bucket_pairs(raw_texts(part), cache)
            spoken = np.array([places.get(x, len(languages)) for x in part.column("lang").to_pylist()])
            owner = np.repeat(np.arange(len(counts)), counts)
            seen = pd.unique(owner * BUCKETS + pairs[:, 0])
            at = spoken[seen // BUCKETS] * found.shape[1] + seen % BUCKETS
            found += np.bincount(at, minlength=found.size).reshape(found.shape)
            found[:, BUCKETS] += np.bincount(spoken, minlength=len(found))
        where = np.nonzero(found)
        columns = [pa.array(where[0]), pa.array(where[1]), pa.array(found[where])]
        yield pa.RecordBatch.from_arrays(columns, names=["spoken", "bucket", "n"])

    counted = docs.mapInArrow(run, "spoken bigint, bucket bigint, n bigint").groupBy("spoken", "bucket")
    found = counted.agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((BUCKETS + 1, len(languages) + 1))
    total[found["bucket"].to_numpy(), found["spoken"].to_numpy()] = found["n"].to_numpy()
    if languages and not total[BUCKETS, -1]:
        total = total[:, :-1]
    # In place: a copy takes megabytes of the driver for each few languages.
    spoken, rows = total[:BUCKETS], total[BUCKETS] + 1
    spoken += 0.5
    spoken /= rows
    np.log(spoken, out=spoken)
    spoken[spoken.max(axis=1) == spoken.min(axis=1)] = 0
    return spoken.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, usable: Column, seed: int = 11) -> Classifier:
    """Fit on rows of ``docs`` (doc_id, text, lang) that ``labels`` (doc_id, toxic) marks.

    Rows with a null id, another label than 0 or 1, or outside ``usable`` (a condition on doc_id) are
    left out; of contradicting labels of one id the greater one counts. Weights are fitted on a sample of
    up to TRAIN_ROWS texts and TRAIN_BYTES bytes of each class, a text that doesn't fit any more being
    passed over, whose ids are broadcast. The words of each language are counted over all usable rows of
    ``docs``, and all labelled rows that the fit didn't see are scored for the thresholds. Without texts
    of both classes the classifier scores every text below one half. ``lang`` only tells languages apart
    in training; languages without labels of both classes, and those beyond LANGUAGES, are one, as they
    share the common threshold.
    """
    marks = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    marks = written(marks, "marks")
    rows = np.zeros(2)
    for r in marks.groupBy("toxic").count().collect():
        rows[r.toxic] = r["count"]
    if rows.sum() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")
    keys = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), size, lang)
    labelled = written(keys.join(marks, "doc_id"), "labelled")
    ids, texts, marked = _sample(docs, labelled)
    toxic = _class_counts(texts, marked)
    both = labelled.groupBy("lang").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"), F.count("*").alias("n"))
    both = both.filter("low < high").orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    languages = sorted(r.lang for r in both.collect())
    own = docs.select("doc_id", "text", lang).filter(F.col("doc_id").isNotNull() & usable)
    spoken = _spoken(own.select("text", "lang"), languages) if len(set(marked.tolist())) == 2 else np.zeros((BUCKETS, 1))
    draw = np.random.default_rng(seed)
    model = Classifier(
        embedding=(0.1 * draw.standard_normal((BUCKETS, DIMS))).astype(np.float32),
        filters=[(0.3 * draw.standard_normal((w, DIMS, FILTERS))).astype(np.float32) for w in WIDTHS],
        bias=np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        output=(0.3 * draw.standard_normal(FILTERS * len(WIDTHS))).astype(np.float32),
        intercept=0.0,
        languages=spoken,
        thresholds=np.zeros(spoken.shape[1], dtype=np.float32),
    )
    if len(set(marked.tolist())) < 2:
        model.intercept, model.output = -30.0, np.zeros_like(model.output)
        return model
    seen = np.bincount(marked, minlength=2)
    odds = np.log((toxic[1] + 0.1) / (seen[1] + 0.2)) - np.log((toxic[0] + 0.1) / (seen[0] + 0.2))
    odds *= toxic.sum(axis=0) / (toxic.sum(axis=0) + 2.0)
    model.embedding[:, 0] = 0.25 * odds
    for f in model.filters:
        f[:, 0, 0] = 1.0
    model.output[::FILTERS] = 1.0
    back = np.arange(len(texts)) % HELD_BACK == 0
    _descend(model, [t for t, b in zip(texts, back, strict=True) if not b], marked[~back], draw)
    fitted = sorted({i for i, b in zip(ids, back, strict=True) if not b})
    del texts
    _calibrate(model, own.select("doc_id", "text").join(marks, "doc_id"), fitted, rows)
    return model


def _descend(model: Classifier, texts: list[np.ndarray], marks: np.ndarray, draw) -> None:
    """Adaptive gradient steps, one text at a time; only the places that were pooled get a gradient."""
    squares: dict[str, np.ndarray] = {}

    def step(name: str, array: np.ndarray, gradient: np.ndarray, at=...) -> None:
        seen = squares.setdefault(name, np.full(array.shape, 1e-3, dtype=np.float32))
        seen[at] += gradient**2
        array[at] -= STEP * gradient / np.sqrt(seen[at])

    weight = len(marks) / (2.0 * np.maximum(np.bincount(marks, minlength=2), 1))
    empty = np.zeros((0, DIMS), dtype=np.float32)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(texts)):
            pairs = texts[i]
            words = model.embedding[pairs].sum(axis=1) if len(pairs) else empty
            padded = np.concatenate([words, np.zeros((WIDTHS[-1], DIMS), dtype=np.float32)])
            places, pooled = [], []
            for width, f in zip(WIDTHS, model.filters, strict=True):
                count = len(padded) - width + 1
                value = sum(padded[j : j + count] @ f[j] for j in range(width))
                places.append(value.argmax(axis=0))
                pooled.append(value.max(axis=0))
            before = np.concatenate(pooled) + model.bias
            active = np.maximum(before, 0)
            logit = float(active @ model.output) + model.intercept
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - marks[i]) * weight[marks[i]]
            back = (error * model.output * (before > 0)).astype(np.float32)
            step("output", model.output, (error * active).astype(np.float32))
            step("bias", model.bias, back)
            model.intercept -= STEP * error
            touched = np.zeros_like(padded)
            for n, (width, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                share = back[n * FILTERS : (n + 1) * FILTERS]
                gradient = np.zeros_like(f)
                for j in range(width):
                    gradient[j] = padded[places[n] + j].T * share
                    np.add.at(touched, places[n] + j, (f[j] * share).T)
                step(f"filter {width}", f, gradient)
            rows = np.flatnonzero(touched[: len(pairs)].any(axis=1))
            for side in (0, 1):
                where, inverse = np.unique(pairs[rows, side], return_inverse=True)
                gradient = np.zeros((len(where), DIMS), dtype=np.float32)
                np.add.at(gradient, inverse, touched[rows])
                step("embedding", model.embedding, gradient, where)


def _calibrate(model: Classifier, labelled: DataFrame, fitted: list, rows: np.ndarray) -> None:
    """Per language: the cut of fewest errors on all of ``labelled`` (doc_id, text, toxic) but the fitted ids, weighed to the classes' true shares.

    Ties go to the middle of the widest gap; a language without both classes takes the cut of all.
    """
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(dict(vars(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Classifier(**shared.value), WordBuckets()
        tables = model.tables()
        for part in slices(batches, "text"):
            pairs, counts = bucket_pairs(raw_texts(part), cache)
            logit = model.logits(model.pooled(pairs, counts, tables)).astype(np.float64)
            columns = [pa.array(model.language(pairs, counts)), pa.array(logit)]
            yield pa.RecordBatch.from_arrays(
                [*columns, part.column("toxic"), part.column("fitted")], names=["spoken", "logit", "toxic", "fitted"]
            )

    kind = labelled.schema["doc_id"].dataType.simpleString()
    seen = spark.createDataFrame([(i,) for i in fitted], f"doc_id {kind}").withColumn("fitted", F.lit(True))
    scored = (
        labelled.join(F.broadcast(seen), "doc_id", "left")
        .select("text", "toxic", F.coalesce("fitted", F.lit(False)).alias("fitted"))
        .mapInArrow(run, "spoken bigint, logit double, toxic int, fitted boolean")
        .select(F.explode(F.array("spoken", F.lit(-1))).alias("spoken"), "logit", "toxic", "fitted")
        .groupBy("spoken", "logit", "fitted")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    )
    scored = written(scored, "logits")
    shared.destroy()
    common = cuts(scored.filter("NOT fitted"), rows)
    if -1 not in common:
        common = cuts(scored.groupBy("spoken", "logit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), rows)
    for language in range(len(model.thresholds)):
        model.thresholds[language] = common.get(language, common[-1])


def cuts(scored: DataFrame, rows: np.ndarray) -> dict[int, float]:
    """By ``spoken``: the cut of fewest errors of ``scored`` (spoken, logit, toxic, clean), where both classes are.

    ``spoken`` of -1 holds all rows. Counts up to each logit are those of its range, in order, and the sums
    of the ranges before it, so that no language is sorted as one.
    """
    edges = sorted(set(scored.approxQuantile("logit", [k / BINS for k in range(1, BINS)], 0.25 / BINS)))
    bins = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e < F.col("logit"))) if edges else F.lit(0)
    placed = scored.withColumn("bin", bins)
    sums = placed.groupBy("spoken", "bin").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.min("logit").alias("low")
    ).collect()
    of: dict[int, list] = {}
    for r in sorted(sums, key=lambda r: (r.spoken, r.bin)):
        of.setdefault(r.spoken, []).append(r)
    totals = {k: np.array([sum(r.clean for r in v), sum(r.toxic for r in v)]) for k, v in of.items()}
    if -1 not in totals or not totals[-1].all():
        return {}
    weight = [float(w) for w in rows / totals[-1]]
    offsets = []
    for spoken, parts in of.items():
        toxic = clean = 0
        for r, after in zip(parts, [*parts[1:], None], strict=True):
            offsets.append((spoken, r.bin, toxic, clean, after and after.low))
            toxic, clean = toxic + r.toxic, clean + r.clean
    before = scored.sparkSession.createDataFrame(
        offsets, "spoken bigint, bin int, toxic_before bigint, clean_before bigint, next double"
    )
    order = Window.partitionBy("spoken", "bin").orderBy("logit")
    best = (
        placed.join(F.broadcast(before), ["spoken", "bin"])
        .withColumn("toxic", F.sum("toxic").over(order) + F.col("toxic_before"))
        .withColumn("clean", F.sum("clean").over(order) + F.col("clean_before"))
        .withColumn("gap", F.coalesce(F.lead("logit").over(order), "next", F.col("logit") + 1) - F.col("logit"))
        .withColumn("errors", F.round(F.col("toxic") * weight[1] - F.col("clean") * weight[0], 6))
        .groupBy("spoken")
        .agg(F.min(F.struct("errors", (-F.col("gap")).alias("gap"), "logit")).alias("best"))
        .collect()
    )
    out = {}
    for r in best:
        if totals[r.spoken].all():
            found = min((r.best.errors, r.best.gap, r.best.logit), (0.0, -1.0, of[r.spoken][0].low - 1))
            out[r.spoken] = found[2] - found[1] / 2
    return out


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts have no words and are scored like any other; repeated rows and null ids
    stay. ``predicted`` is 1 from a score of one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Classifier(**shared.value), WordBuckets()
        tables = model.tables()
        for part in slices(batches, "text"):
            pairs, counts = bucket_pairs(raw_texts(part), cache)
            scores = model.scores(pairs, counts, tables)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def filter_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """Rows of ``docs`` whose text isn't predicted toxic, with all their columns.

    Nothing is joined: each row is kept or dropped by its own text, in one pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = Classifier(**shared.value), WordBuckets()
        tables = model.tables()
        for part in slices(batches, "text"):
            pairs, counts = bucket_pairs(raw_texts(part), cache)
            yield part.filter(pa.array(model.scores(pairs, counts, tables) < 0.5))

    return docs.mapInArrow(run, docs.schema)
