"""Helpers the operators share: written tables, bounded slices of Arrow batches, components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreunc.session import ensure_checkpoint_dir

#: Bytes of text that a Python task works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Nodes of a bucket whose pairs are listed.
SMALL_BUCKET = 16
#: 64-bit words of the bitmap that a set is folded into, to bound what two sets can share.
BITMAP_WORDS = 8


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder on the storage that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow batches hold at most so many rows, as whole texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


#: Folders that were written since ``only`` was entered, and the folder of each table that is still used.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files at their end.

    Else these stay until the driver's memory happens to be cleared, which many tables may be written before.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; later uses read it, lost executors don't matter."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    if (passing := _PASSING.get()) is not None:
        passing.append(folder)
    with _shuffles_dropped(spark):
        df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[table] = folder
    return table


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a written table; the tables that were written for it are deleted."""
    outer, mine = _PASSING.get(), []
    token = _PASSING.set(mine)
    try:
        table = written(make(), name)
    finally:
        _PASSING.reset(token)
    folder = _FOLDERS[table]
    _delete(table.sparkSession, [x for x in mine if x != folder])
    if outer is not None:
        outer.append(folder)
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` or ``only`` that nothing reads any more; others are left alone."""
    for table in tables:
        if folder := _FOLDERS.pop(table, None):
            _delete(table.sparkSession, [folder])


def _delete(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def slices(
    batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``size`` bytes in ``column`` and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in turn, parted by ASCII white space, and words per text; null is empty."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = parts.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
        words = words.filter(pa.array(full))
    return words, counts


def numbered_words(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the place of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column whose row i holds the next ``counts[i]`` values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def spread_runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (counts[i] of them) for all i in turn."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _low_neighbours(edges: DataFrame) -> DataFrame:
    """Each link with the least of u and its neighbours.

    The least ones are written, so that both sides of the join are shuffled for it and adaptive
    execution can split a node that a large part of all links hang on.
    """
    low = written(edges.groupBy("u").agg(F.min("v").alias("low")), "low")
    return edges.join(low.withColumn("low", F.least("u", "low")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        _low_neighbours(both)
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _low_neighbours(down)
    return (
        near.select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Union-find over links: (node, component), component being its least node.

    Alternates large and small stars until every node hangs on the least node of its component,
    which takes a number of rounds logarithmic in the nodes. Each round is a table in the shared
    folder. Null ends and links of a node with itself are left out; nodes without links have no row.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct()
    while True:
        before, links = links, only(lambda links=links: _small_star(_large_star(links)), "links")
        forget(before)
        if _are_stars(links):
            break
    low = links.select("v").distinct().select(F.col("v").alias("u"), "v")
    return links.union(low).toDF("node", "component")


def _are_stars(links: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: another round would change nothing."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(links.select("v", F.lit(0)))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return by_node.filter("up > 1 OR (up = 1 AND low = 0)").isEmpty()


def _close(x: str, y: str, similarity: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return (F.col(x) * 100 >= F.col(y) * similarity) & (F.col(y) * 100 >= F.col(x) * similarity)


def linked(
    placed: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    sets: Callable[[DataFrame], DataFrame],
    similarity: int,
    sized: bool = True,
) -> DataFrame:
    """Components (node, component) of similar nodes that share a bucket.

    ``placed`` has (node, size, bucket), size being that of the node's set if ``sized``; ``confirm``
    takes pairs (a, b) of nodes and returns those that are similar; ``sets`` takes (node, component)
    and returns (node, component, hash), the members of the nodes' sets. In a bucket every node is first compared
    with two members: the one that meets most others in all its buckets, which is the original that
    copies were made from, and one chosen by hash, another one in each bucket that a group shares.
    That joins nearly all of a large group. Where a bucket then still holds several components, the
    nodes of different components are compared with each other too: all pairs of a bucket of at most
    SMALL_BUCKET nodes, and by an exact join of their sets in larger ones, see ``across_components``. So
    the pairs of a large group are not listed and no link between components is passed over. Nodes
    without links have no row.
    """
    def bucketed() -> DataFrame:
        shared = written(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        meets = written(placed.join(shared, "bucket"), "meets")
        degree = written(meets.groupBy("node").agg(F.least(F.sum("n"), F.lit(1 << 42)).alias("degree")), "degrees")
        draw = F.xxhash64("node", "bucket")
        return (
            meets.drop("n")
            .join(degree, "node")
            .withColumn("rank", F.col("degree") * (1 << 20) + draw.bitwiseAND((1 << 20) - 1))
            .withColumn("draw", draw)
            .drop("degree")
        )

    members = only(bucketed, "members")

    def led() -> DataFrame:
        chosen = written(members.groupBy("bucket").agg(F.max("rank").alias("most"), F.min("draw").alias("low")), "chosen")
        leads = written(
            members.join(chosen, "bucket")
            .filter("rank = most OR draw = low")
            .select("bucket", F.col("node").alias("lead_node"), F.col("size").alias("lead_size")),
            "leads",
        )
        return (
            members.join(leads, "bucket")
            .filter(_close("size", "lead_size", similarity if sized else 0) & (F.col("node") != F.col("lead_node")))
            .select(F.least("node", "lead_node").alias("a"), F.greatest("node", "lead_node").alias("b"))
            .distinct()
        )

    pairs = only(led, "pairs")
    links = only(lambda: confirm(pairs), "links")
    group = components(links, "a", "b")

    def left_over() -> DataFrame:
        placed = members.join(group, "node", "left").select(
            "bucket", "node", "size", F.coalesce("component", "node").alias("component")
        )
        mixed = written(
            placed.groupBy("bucket")
            .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
            .filter("low <> high")
            .select("bucket", "n"),
            "mixed",
        )
        return placed.join(mixed, "bucket")

    rest = only(left_over, "rest")
    forget(members)
    few = rest.filter(F.col("n") <= SMALL_BUCKET)
    left = few.select("bucket", *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "component")))
    right = few.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "component")))
    inside = (
        left.join(right, "bucket")
        .filter((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")))
        .filter(_close("size_a", "size_b", similarity if sized else 0))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )

    def missed() -> DataFrame:
        many = written(rest.filter(F.col("n") > SMALL_BUCKET).select("node", "component").distinct(), "many")
        found = inside.union(across_components(sets(many), similarity)).distinct()
        return found.join(pairs, ["a", "b"], "left_anti")

    across = only(missed, "across")
    forget(rest, pairs)
    if across.isEmpty():
        return group
    more = only(lambda: confirm(across), "links")
    return components(links.union(more), "a", "b")


def across_components(members: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar; none that is gets lost.

    ``members`` has (node, component, hash). The members of all sets are put in one order, the rarest
    first. Of n, so many come first that a similar set must hold one of them; where two sets first
    meet, at most what follows in both can be shared too. Sets are folded into bitmaps as well: as many
    bits as differ, at least so many members are in one set only. Both together rule out, inside the
    join, nearly all pairs that only share what is common to a whole group.
    """
    members = written(members.select("node", "component", "hash"), "sets")
    often = written(members.groupBy("hash").agg(F.count("*").alias("often")), "often")
    each = Window.partitionBy("node")
    words = [f"word{i}" for i in range(BITMAP_WORDS)]
    bit = "IF(pmod(shiftright(fold, 6), {n}) = {i}, shiftleft(1L, cast(fold & 63 AS int)), 0L)"
    first = written(
        members.join(often, "hash")
        # First what needs the rows in order, as the rest takes them in any.
        .withColumn("place", F.row_number().over(each.orderBy("often", "hash")))
        .withColumn("n", F.count("*").over(each))
        .withColumn("fold", F.xxhash64("hash"))
        .withColumns({w: F.bit_xor(F.expr(bit.format(n=BITMAP_WORDS, i=i))).over(each) for i, w in enumerate(words)})
        .filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1)
        .drop("often", "fold"),
        "firsts",
    )
    kept = ("node", "component", "n", "place", *words)
    left = first.select("hash", *(F.col(c).alias(f"{c}_a") for c in kept))
    right = first.select("hash", *(F.col(c).alias(f"{c}_b") for c in kept))
    most = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    both = F.col("n_a") + F.col("n_b")
    apart = F.expr(" + ".join(f"bit_count({w}_a ^ {w}_b)" for w in words))
    return (
        left.join(right, "hash")
        .filter((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")))
        .filter(_close("n_a", "n_b", similarity))
        .filter((100 + similarity) * most >= similarity * both)
        .filter((100 + similarity) * (both - apart) >= 2 * similarity * both)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
