"""Prefix trie of conversations: which turns a batch of conversations has in common, and what that saves.

Conversations are cut into segments of DEPTH turns, and the segments are dealt to tasks by ranges of
their turns, so that neighbours in a task share prefixes. A task lays its segments out as a padded matrix
of turn numbers and sorts it with ``lexsort``. Where a column differs from the row above, or-ed from left
to right, a node starts; ``reduceat`` over the starts of a depth adds up what its nodes hold. A node on
the path of a task's first or last row, or one whose conversations go on in another segment, may have a
part elsewhere: those few nodes, called open, are put together afterwards, and what hangs below them is
added up over steps of doubling length.

Turns and prefixes are told apart by two 64-bit hashes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreunc.llm.common import written

#: Turns of a segment, the widest matrix.
DEPTH = 128
#: Cells of a matrix; a task that gets more segments works them off in parts, whose nodes are all open.
CELLS = 1 << 21
#: Segments a task should get.
TASK_ROWS = 1 << 14
#: Rows of a conversation that are joined by one key, and segments whose hashes are added up at a time.
BLOCK = 1 << 10
#: Open nodes that are broadcast to the nodes below them; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Parts that the children of a node are dealt to in that shuffle.
SALTS = 16

CLOSED, OPEN, END = 0, 1, 2
NODES = (
    "kind int, depth bigint, x bigint, y bigint, px bigint, py bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, bytes bigint, ends_sha256 string"
)
NAMES = [part.split(" ")[0] for part in NODES.split(", ")]
KEY = ["depth", "x", "y"]
TURN = "struct<position:bigint,a:bigint,b:bigint,bytes:bigint>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, a, b, bytes): the turns of each conversation numbered from 0, as a written table.

    They stand in order of turn, null first; turns of one number in order of role, then text. ``a`` and
    ``b`` are hashes of role and text, null being empty, ``bytes`` the UTF-8 length of the text. Rows
    without a conv_id are left out. Rows are dealt by ranges of that order, so a long conversation lies in
    several tasks: each numbers its part, and the few parts of divided conversations are moved up by the
    sizes of those before.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    dealt = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv_id",
            F.xxhash64("role", "text").alias("a"),
            F.xxhash64(F.lit("b"), "text", "role").alias("b"),
            F.octet_length("text").cast("bigint").alias("bytes"),
        )
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            sizes = np.diff(np.append(starts, len(conv)))
            place = np.arange(len(conv)) - np.repeat(starts, sizes)
            if conv[0] == last:
                place[: sizes[0]] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(conv), task)), pa.array(place)],
                names=[*batch.schema.names, "task", "place"],
            )

    kinds = "conv_id bigint, a bigint, b bigint, bytes bigint, task bigint, place bigint"
    numbered = written(dealt.mapInArrow(number, kinds), "turns")
    by_conv = Window.partitionBy("conv_id")
    before = F.sum("n").over(by_conv.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # A border between two tasks divides at most one conversation: no more rows than twice the tasks.
    moved = (
        numbered.groupBy("conv_id", "task")
        .agg(F.count("*").alias("n"))
        .withColumn("parts", F.count("*").over(by_conv))
        .filter("parts > 1")
        .select("conv_id", "task", F.coalesce(before, F.lit(0)).alias("before"))
    )
    return numbered.join(F.broadcast(moved), ["conv_id", "task"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("position"), "a", "b", "bytes"
    )


def whole(ordered: DataFrame) -> DataFrame:
    """(conv_id, position, total, a, b, bytes) of conversations as they are."""
    sizes = ordered.groupBy("conv_id").agg(F.count("*").alias("total"))
    return _with_conversation(ordered, sizes.withColumn("rows", F.col("total")))


def rebuilt(ordered: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """As :func:`whole`, each conversation beginning with the first turns of another one.

    ``base`` and ``head``, of conv_id, name that other one and how many of its turns are taken (all if it
    has fewer, none if there is no such conversation), ``most`` at most; the conversation's own turns
    after its first ``head`` follow. One that is left without turns has a single row with null position.
    """
    convs = ordered.groupBy("conv_id").agg(F.count("*").alias("rows"))
    turn = F.struct("position", "a", "b", "bytes")
    heads = (
        ordered.filter(F.col("position") < most)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    convs = (
        convs.withColumn("head", head.cast("int"))
        .withColumn("base", base)
        .join(heads, "base", "left")
        .withColumn("turns", F.slice(F.coalesce("turns", F.array().cast(f"array<{TURN}>")), 1, F.col("head")))
        .withColumn("taken", F.size("turns"))
        .withColumn("total", F.col("taken") + F.greatest(F.col("rows") - F.col("head"), F.lit(0)))
    )
    convs = written(convs.select("conv_id", "rows", "head", "taken", "total", "turns"), "conversations")
    fronts = convs.select("conv_id", "total", F.inline_outer("turns")).select(
        "conv_id", "position", "total", "a", "b", "bytes"
    ).filter("position IS NOT NULL OR total = 0")
    own = (
        _with_conversation(ordered, convs.select("conv_id", "rows", "head", "taken", "total"))
        .filter(F.col("position") >= F.col("head"))
        .withColumn("position", F.col("position") - F.col("head") + F.col("taken"))
    )
    return fronts.unionByName(own.select(fronts.columns))


def _with_conversation(ordered: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns with the columns of their conversation (``rows`` turns long), BLOCK turns by one key."""
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor(F.col("rows") / BLOCK))))
    return ordered.withColumn("block", F.floor(F.col("position") / BLOCK)).join(
        blocks.drop("rows"), ["conv_id", "block"]
    ).drop("block")


def segments(sequences: DataFrame) -> DataFrame:
    """(level, gx, gy, turns, conv_id, more) of (conv_id, position, total, a, b, bytes), as a written table.

    A segment holds DEPTH turns, in order, as (x, y, bytes); x and y are hashes of the turn and its place, and
    those of a prefix are the exclusive or of all its turns'. gx and gy are the prefix before the segment,
    ``more`` tells that others follow.
    """
    keyed = sequences.withColumn("level", F.floor(F.coalesce("position", F.lit(0)) / DEPTH))
    keyed = keyed.withColumn("x", F.xxhash64("position", "a", "b"))
    keyed = keyed.withColumn("y", F.xxhash64(F.lit("y"), "position", "b", "a"))
    turn = F.when(F.col("position").isNotNull(), F.struct("position", "x", "y", "bytes"))
    parts = written(
        keyed.groupBy("conv_id", "level").agg(
            F.array_sort(F.collect_list(turn)).alias("turns"),
            F.bit_xor("x").alias("sx"),
            F.bit_xor("y").alias("sy"),
            F.max("total").alias("total"),
        ),
        "segments",
    )
    turns = F.transform("turns", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["bytes"].alias("bytes")))
    more = (F.col("total") > (F.col("level") + 1) * DEPTH).alias("more")
    short = parts.filter(F.col("total") <= DEPTH).withColumn("gx", F.lit(0).cast("bigint")).withColumn("gy", F.col("gx"))
    # Hashes before a segment: within a block of segments, and of the blocks before.
    long = parts.filter(F.col("total") > DEPTH).withColumn("block", F.floor(F.col("level") / BLOCK))
    past = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "block").orderBy("level").rowsBetween(*past)
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(*past)
    blocks = long.groupBy("conv_id", "block").agg(F.bit_xor("sx").alias("bx"), F.bit_xor("sy").alias("by"))
    blocks = blocks.select("conv_id", "block", *(F.bit_xor(c).over(over).alias(c) for c in ("bx", "by")))
    long = long.withColumn("ix", F.bit_xor("sx").over(inside)).withColumn("iy", F.bit_xor("sy").over(inside))
    long = long.join(blocks, ["conv_id", "block"])
    for c in ("x", "y"):
        long = long.withColumn(f"g{c}", F.coalesce(f"i{c}", F.lit(0)).bitwiseXOR(F.coalesce(f"b{c}", F.lit(0))))
    columns = ["level", "gx", "gy", turns.alias("turns"), "conv_id", more]
    return short.select(*columns).unionByName(long.select(*columns))


def _codes(*keys: np.ndarray) -> np.ndarray:
    """Dense numbers of the rows of ``keys``, in their order, the first key being the greatest."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else NO_ENDS


def matrix_nodes(rows: pa.Table, parted: bool) -> Iterator[pa.RecordBatch]:
    """Nodes of a run of segments, all of them open if it is ``parted`` from others of its range."""
    level, gx, gy, conv = (rows.column(c).to_numpy() for c in ("level", "gx", "gy", "conv_id"))
    more = rows.column("more").to_numpy()
    column = rows.column("turns").combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    fx, fy, fbytes = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "bytes"))
    count, width = len(conv), int(lengths.max())
    row = np.repeat(np.arange(count), lengths)
    place = np.arange(len(fx)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    turn = np.full((count, width), -1, dtype=np.int64)
    turn[row, place] = _codes(fx, fy)
    group = _codes(level, gx, gy)
    order = np.lexsort((conv, *(turn[:, j] for j in range(width - 1, -1, -1)), group))
    back = np.empty(count, dtype=np.int64)
    back[order] = np.arange(count)
    row = back[row]
    level, gx, gy, conv, more = (v[order] for v in (level, gx, gy, conv, more))
    lengths, turn, group = lengths[order], turn[order], group[order]

    def prefixes(first: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros((count, width + 1), dtype=np.int64)
        out[:, 0] = first
        out[row, place + 1] = values
        return np.bitwise_xor.accumulate(out, axis=1)

    x, y = prefixes(gx, fx), prefixes(gy, fy)
    size = np.zeros((count, width + 1), dtype=np.int64)
    size[row, place + 1] = fbytes
    starts_at = np.ones((count, width + 1), dtype=bool)
    starts_at[1:, 0] = group[1:] != group[:-1]
    starts_at[1:, 1:] = turn[1:] != turn[:-1]
    np.logical_or.accumulate(starts_at, axis=1, out=starts_at)
    open_row = more | parted
    open_row[[0, -1]] = True

    leaves = np.zeros(count, dtype=np.int64)
    saved = np.zeros(count, dtype=np.int64)
    kids = np.zeros(count, dtype=np.int64)
    waiting: tuple | None = None
    for j in range(width, -1, -1):
        starts = np.flatnonzero(starts_at[:, j])
        real = lengths[starts] >= j
        is_open = (np.logical_or.reduceat(open_row, starts) | (j == 0)) & real
        n = np.diff(np.append(starts, count))
        least = np.minimum.reduceat(conv, starts)
        n_kids, n_leaves, n_saved = (np.add.reduceat(v, starts) for v in (kids, leaves, saved))
        if waiting is not None:
            yield from _emit(*waiting, starts, least, is_open)
        closed = real & ~is_open
        own_leaves = np.where(closed, n_leaves + (n_kids == 0), n_leaves)
        own_saved = np.where(closed, n_saved + (n - 1) * size[starts, j], n_saved)
        leaves, saved, kids = (np.zeros(count, dtype=np.int64) for _ in range(3))
        leaves[starts[closed]], saved[starts[closed]], kids[starts[closed]] = own_leaves[closed], own_saved[closed], 1
        ends = (lengths == j) & ~more
        n_ends = np.add.reduceat(ends.astype(np.int64), starts)
        # A conversation that only goes on here was counted, up to its last segment, there.
        counted = (j > 0) | (level[starts] == 0)
        parent = j - 1 if j else 0
        has = np.flatnonzero(real)
        at = starts[has]
        mask = is_open[has]
        table = {
            "kind": np.where(mask, OPEN, CLOSED),
            "depth": level[at] * DEPTH + j,
            "x": x[at, j],
            "y": y[at, j],
            "px": pa.array(x[at, parent], mask=np.full(len(at), j == 0)),
            "py": pa.array(y[at, parent], mask=np.full(len(at), j == 0)),
            "conv_id": pa.array(least[has], mask=~counted[has]),
            "n_convs": np.where(counted[has], n[has], 0),
            "n_children": n_kids[has],
            "n_leaves": own_leaves[has],
            "saved_tokens": own_saved[has],
            "bytes": pa.array(size[at, j], mask=np.full(len(at), j == 0)),
            "ends_sha256": [
                None if o else digest(conv[s : s + e])
                for s, e, o in zip(at.tolist(), n_ends[has].tolist(), mask.tolist(), strict=True)
            ],
        }
        waiting = (table, at, j)
        node = np.repeat(np.arange(len(starts)), n)
        over = np.flatnonzero(ends & is_open[node])
        if len(over):
            yield _batch(
                {
                    "kind": np.full(len(over), END),
                    "depth": level[over] * DEPTH + j,
                    "x": x[over, j],
                    "y": y[over, j],
                    "conv_id": conv[over],
                }
            )
    yield from _emit(*waiting, None, None, None)


def _emit(table: dict, at: np.ndarray, j: int, starts, least, is_open) -> Iterator[pa.RecordBatch]:
    """Nodes of depth j, with their parent's conversation where the parent is closed."""
    if starts is not None and len(at):
        parent = np.searchsorted(starts, at, side="right") - 1
        table["parent_conv_id"] = pa.array(least[parent], mask=is_open[parent])
    if len(at):
        yield _batch(table)


def _batch(table: dict) -> pa.RecordBatch:
    count = len(table["kind"])
    columns = []
    for name in NAMES:
        kind = pa.int32() if name == "kind" else pa.string() if name == "ends_sha256" else pa.int64()
        values = table.get(name)
        columns.append(pa.nulls(count, kind) if values is None else pa.array(values).cast(kind))
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def task_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all segments of a task."""
    kept: list[pa.RecordBatch] = []
    count = width = 0
    parted = False
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, 1 << 12)
            at += part.num_rows
            longest = pc.max(part.column("turns").value_lengths()).as_py()
            if kept and (count + part.num_rows) * (max(width, longest) + 1) > CELLS:
                parted = True
                yield from matrix_nodes(pa.Table.from_batches(kept), parted)
                kept, count, width = [], 0, 0
            kept.append(part)
            count, width = count + part.num_rows, max(width, longest)
    if kept:
        yield from matrix_nodes(pa.Table.from_batches(kept), parted)


def _end_digests(rows: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of ids in ascending order.

    A digest is read from front to back, so the ids of one node pass through one task, sorted outside
    the memory and eight bytes each; nothing is collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids_hash = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, x, y, conv = (batch.column(c).to_numpy() for c in (*KEY, "conv_id"))
            new = (depth[1:] != depth[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            starts = np.flatnonzero(np.concatenate([[True], new]))
            done = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(conv)], strict=True):
                node, ids = (int(depth[s]), int(x[s]), int(y[s])), ",".join(map(str, conv[s:e].tolist())).encode()
                if node == now:
                    ids_hash.update(b"," + ids)
                    continue
                if now is not None:
                    done.append((*now, ids_hash.hexdigest()))
                now, ids_hash = node, hashlib.sha256(ids)
            if done:
                yield finished(done)
        if now is not None:
            yield finished([(*now, ids_hash.hexdigest())])

    def finished(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*KEY, "ends_sha256"])

    dealt = rows.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return dealt.mapInArrow(run, "depth bigint, x bigint, y bigint, ends_sha256 string")


def _totals(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of everything below added, given each node's own and (px, py).

    A round adds what the descendants up to 2^r steps further down have gathered, and doubles the step.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state = nodes.select(*KEY, F.col("px").alias("ax"), F.col("py").alias("ay"), "n_leaves", "saved_tokens")
    step = 1
    while step <= deepest:
        state = written(state, "totals")
        above = [(F.col("depth") - step).alias("depth"), F.col("ax").alias("x"), F.col("ay").alias("y")]
        gain = state.filter("ax IS NOT NULL").groupBy(*above).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
        )
        further = state.select(
            (F.col("depth") + step).alias("depth"),
            F.col("x").alias("ax"),
            F.col("y").alias("ay"),
            F.col("ax").alias("fx"),
            F.col("ay").alias("fy"),
        )
        state = (
            state.join(gain, KEY, "left")
            .join(further, ["depth", "ax", "ay"], "left")
            .select(
                *KEY,
                F.col("fx").alias("ax"),
                F.col("fy").alias("ay"),
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            )
        )
        step *= 2
    return nodes.drop("n_leaves", "saved_tokens").join(state.drop("ax", "ay"), KEY)


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences``, see :func:`whole` and :func:`rebuilt`.

    A node is a distinct sequence of the first ``depth`` turns (role and text) of a conversation; its members
    are the conversations that begin with it. Columns: conv_id, the least member; depth, 0 for the root,
    which all share; parent_conv_id, the parent's conv_id, null for the root; n_convs, its members; n_children;
    n_leaves, the childless nodes of its subtree, itself included; saved_tokens, the UTF-8 bytes of its
    subtree's last turns that members after the first needn't send again; ends_sha256, the SHA-256 of the
    ids, ascending and joined by commas, of members that end there. Without conversations there are no nodes.
    """
    spark = sequences.sparkSession
    parts = written(segments(sequences), "parts")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // TASK_ROWS))
    dealt = parts.repartitionByRange(tasks, "level", "gx", "gy", "turns", "conv_id")
    found = written(dealt.mapInArrow(task_nodes, NODES), "nodes")
    merged = (
        found.filter(F.col("kind") == OPEN)
        .groupBy(*KEY)
        .agg(
            *(F.max(c).alias(c) for c in ("px", "py", "bytes")),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        )
    )
    merged = written(merged, "open")
    below = merged.filter("px IS NOT NULL").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")
    ).agg(F.count("*").alias("open_children"))
    merged = (
        merged.join(below, KEY, "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
        .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0)))
        .drop("open_children")
    )
    merged = _totals(written(merged, "own")).join(_end_digests(found.filter(F.col("kind") == END)), KEY, "left")
    merged = written(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "merged")
    parents = merged.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("above")
    )
    rest = found.filter(F.col("kind") == CLOSED).select(*merged.columns, "parent_conv_id").unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    )
    link = ["depth", "px", "py"]
    if merged.count() <= BROADCAST_ROWS:
        rest = rest.join(F.broadcast(parents), link, "left")
    else:
        salted = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rest = rest.withColumn("salt", F.pmod("conv_id", F.lit(SALTS)).cast("int")).join(salted, [*link, "salt"], "left")
    return rest.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """:func:`trie` of the conversations of ``turns`` (conv_id, turn, role, text); other columns are ignored."""
    return trie(whole(ordered_turns(turns)))
