"""Near-duplicate documents by min-max hashing over word shingles.

Each permutation of the hashed shingles yields two values, its least and its greatest, so half the
permutations give a signature of the same length. Bands of the signature are the buckets in which
candidates meet; every link is confirmed on the full sets; linked documents form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreunc.llm.common import linked, only, raw_texts, slices, written

#: 128 permutations, 256 values, 42 bands of 6: at similarity 0.8 one pair in 300,000 is missed.
PERMUTATIONS = 128
BAND_ROWS = 6
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PLANE = np.random.default_rng(20)
BYTE_VALUES = _PLANE.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
PLACE_FACTORS = _PLANE.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
FACTORS = _PLANE.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _PLANE.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
#: Base of the rolling hash and its inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, by doubling."""
    out = np.ones(max(count, 1), dtype=np.uint64)
    size = 1
    while size < count:
        more = min(size, count - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, 2**64))
        size += more
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lowered, parted by ASCII white space), and words per text."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[joined] * powers(BASE, len(joined)), out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * powers(INVERSE, len(joined) + 1)[start])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text in turn, ascending, and their number per text.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    hashes, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    firsts = np.cumsum(counts) - counts
    found, owners = [], []
    for size in range(1, words + 1):
        if size < words:
            at = firsts[counts == size]
        else:
            at = np.flatnonzero(owner[: max(len(owner) - size + 1, 0)] == owner[size - 1 :])
        value = np.full(len(at), size, dtype=np.uint64)
        for j in range(size):
            value = value * _GOLDEN + hashes[at + j] * PLACE_FACTORS[j]
        found.append(mixed(value))
        owners.append(owner[at])
    value, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def set_keys(value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprint of each set, as two columns; zeros for an empty one."""
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(mixed(value * PLACE_FACTORS[salt] + np.uint64(salt)), out=sums[1:])
        ends = np.cumsum(counts)
        out.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return out[0], out[1]


def band_keys(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sets, bands) bucket keys of non-empty sets."""
    firsts = np.cumsum(counts) - counts
    signature = np.empty((2 * PERMUTATIONS, len(counts)), dtype=np.uint64)
    for k in range(PERMUTATIONS):
        moved = value * FACTORS[k] + SHIFTS[k]
        np.minimum.reduceat(moved, firsts, out=signature[2 * k])
        np.maximum.reduceat(moved, firsts, out=signature[2 * k + 1])
    bands = 2 * PERMUTATIONS // BAND_ROWS
    keys = np.empty((len(counts), bands), dtype=np.int64)
    for b in range(bands):
        key = np.full(len(counts), b, dtype=np.uint64)
        for j in range(BAND_ROWS):
            key = mixed(key * _GOLDEN + signature[b * BAND_ROWS + j])
        keys[:, b] = key.view(np.int64)
    return keys


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, bands) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            value, counts = shingle_sets(raw_texts(part), words)
            key1, key2 = set_keys(value, counts)
            full = counts > 0
            keys = band_keys(value, counts[full]) if full.any() else np.empty((0, 0), dtype=np.int64)
            sizes = np.where(full, keys.shape[1], 0)
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(counts.astype(np.int64)),
                    pa.array(key1),
                    pa.array(key2),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "key1", "key2", "bands"],
            )

    schema = "doc_id bigint, n_shingles bigint, key1 bigint, key2 bigint, bands array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def full_sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the sets of the nodes in ``asked`` (node), ascending 64-bit hashes as bytes."""
    wanted = nodes.select("node", "doc_id", "key1", "key2").join(asked.distinct(), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            value, counts = shingle_sets(raw_texts(part), words)
            key1, key2 = set_keys(value, counts)
            same = (key1 == part.column("key1").to_numpy()) & (key2 == part.column("key2").to_numpy())
            ends = np.cumsum(counts)
            rows = [value[e - c : e].tobytes() for e, c in zip(ends[same], counts[same], strict=True)]
            found = part.column("node").filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([found, pa.array(rows, pa.binary())], names=["node", "hashes"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.join(wanted, "doc_id").mapInArrow(run, "node bigint, hashes binary")


def exploded(sets: DataFrame) -> DataFrame:
    """(node, component, hash) rows of ``full_sets`` with a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[i].as_buffer(), dtype=np.int64)
                same = (np.full(len(hashes), batch.column(c)[i].as_py()) for c in ("node", "component"))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, same), pa.array(hashes)], names=["node", "component", "hash"]
                )

    return sets.select("node", "component", "hashes").mapInArrow(run, "node bigint, component bigint, hash bigint")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar: 100 intersection >= similarity union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(right[i].as_buffer(), dtype=np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * shared >= similarity * (len(x) + len(y) - shared))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    full = written(full_sets(asked, nodes, docs, words), "full")
    return (
        pairs.join(full.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
        .join(full.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a")
        .select("a", "b", "left", "right")
        .mapInArrow(compare, "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Texts count as sets of distinct shingles of ``words`` words (A-Z lowered, parted by ASCII white
    space); sets link where 100 * intersection >= similarity * union; ``component_id`` is the least
    doc_id reachable over links, and the row of that id is kept. Null and blank texts have no
    shingles and link with nothing. Rows without an id take no part: their component is null and
    they are kept. Repeated rows give repeated results; texts of one id that differ are judged each by
    itself, though they share what the id gives them. Other columns are ignored.
    """
    return judged(docs, words, similarity).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """:func:`near_duplicates` with the fingerprint (key1, key2) of each row's set.

    Rows with equal sets are one node; ``linked`` compares nodes that share a bucket. Nodes are numbered
    in order of their least doc_id, so that the least node of a component has its least doc_id.
    """
    found = written(sketches(docs, words), "sketches")
    usable = found.filter("doc_id IS NOT NULL AND n_shingles > 0")

    def headed() -> DataFrame:
        nodes = written(
            usable.groupBy("key1", "key2")
            .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first"))
            .select(
                "key1", "key2", "first.doc_id", F.col("first.n_shingles").alias("size"), F.col("first.bands").alias("bands")
            )
            .orderBy("doc_id", "key1", "key2")
            .withColumn("node", F.monotonically_increasing_id()),
            "nodes",
        )
        group = linked(
            nodes.select("node", "size", F.explode("bands").alias("bucket")),
            lambda pairs: confirmed(pairs, nodes, docs, words, similarity),
            # Repeated rows of one id and text have one set.
            lambda asked: exploded(full_sets(asked.select("node"), nodes, docs, words).distinct().join(asked, "node")),
            similarity,
        )
        firsts = nodes.select(F.col("node").alias("component"), F.col("doc_id").alias("head"))
        heads = nodes.select("key1", "key2", "node", "doc_id").join(group, "node", "left").join(firsts, "component", "left")
        return heads.select("key1", "key2", F.coalesce("head", "doc_id").alias("component"))

    heads = only(headed, "heads")
    return (
        found.drop("bands")
        .join(heads, ["key1", "key2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component")))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
            "key1",
            "key2",
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """Rows of ``docs`` that are kept by ``near_duplicates``, with all their columns.

    Rows without an id stay; of rows that repeat an id with different texts, each stays or goes by its own.
    """
    rows = only(
        lambda: judged(docs, words, similarity)
        .filter("doc_id IS NOT NULL")
        .select("doc_id", "key1", "key2", "kept")
        .distinct(),
        "judged",
    )
    by_id = rows.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    by_id = written(by_id.filter("NOT every"), "dropped")
    kept = docs.join(by_id.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    mixed = by_id.filter("some").select("doc_id")
    if mixed.isEmpty():
        return kept
    # Ids with texts of both kinds: their rows are told apart by the fingerprints of their texts.
    names = [f"__{i}" for i in range(len(docs.columns))]
    texts = docs.join(mixed, "doc_id", "left_semi").select(*docs.columns, "text").toDF(*names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            key1, key2 = set_keys(*shingle_sets(raw_texts(part), words))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(key1), pa.array(key2)], names=[*names, "key1", "key2"]
            )

    schema = T.StructType([*texts.drop("text").schema.fields, T.StructField("key1", T.LongType()), T.StructField("key2", T.LongType())])
    at = names[docs.columns.index("doc_id")]
    gone = rows.filter("NOT kept").select(F.col("doc_id").alias(at), "key1", "key2")
    rest = texts.mapInArrow(run, schema).join(gone, [at, "key1", "key2"], "left_anti")
    return kept.union(rest.select(*names).toDF(*docs.columns))
