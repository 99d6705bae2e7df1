"""Exact top-k by inner product: tiles of queries times tiles of rows, merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a tile.
QUERY_TILE = 4096
ROW_TILE = 4096
#: Queries whose scores with a tile of rows are held at a time.
BLOCK = 256
#: Queries whose best rows so far a task holds.
HELD_QUERIES = 1 << 20
#: Partial lists that one step of the tree merges.
FAN_IN = 16
EXACT_SINGLE = 2.0**24
EXACT = 2.0**53
#: A score below all others, and the id that goes with it: a place of a list that is still free.
FREE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
TILES = "dims int, ids binary, data binary"


def _packed(size: int):
    """Pack rows (id, vector) into tiles of vectors of one length; vectors with a null or non-finite part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def tile(dims: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in waiting[dims]])
            data = np.concatenate([d for _, d in waiting.pop(dims)])
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dims], pa.int32()),
                    pa.array([ids[order].tobytes()], pa.binary()),
                    pa.array([data[order].tobytes()], pa.binary()),
                ],
                names=["dims", "ids", "data"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            counts = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            # A null is NaN here.
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            usable = bad[ends] == bad[ends - counts]
            for dims in np.unique(counts[usable]).tolist():
                rows = np.flatnonzero((counts == dims) & usable)
                for at in range(0, len(rows), size):
                    some = rows[at : at + size]
                    data = flat[(ends[some] - dims)[:, None] + np.arange(dims)]
                    waiting.setdefault(dims, []).append((ids[some], data))
                    if sum(len(i) for i, _ in waiting[dims]) >= size:
                        yield tile(dims)
        for dims in list(waiting):
            yield tile(dims)

    return run


def integers(data: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in double precision, as whole numbers held in doubles."""
    return np.floor(scale * data.astype(np.float64))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: a matrix product in single or double precision where that is exact, else int64.

    No sum of some of a product's terms exceeds the product of both lengths. Products beyond 64 bits
    are cut to 2^63 - 1 with their sign.
    """
    with np.errstate(over="ignore"):
        most = np.sqrt(np.square(queries).sum(axis=1).max(initial=0.0) * (1 + 1e-9))
        most *= np.sqrt(np.square(rows).sum(axis=1).max(initial=0.0) * (1 + 1e-9))
    if most < EXACT_SINGLE:
        return queries.astype(np.float32) @ rows.astype(np.float32).T
    if most < EXACT:
        return queries @ rows.T
    whole = np.vectorize(int, otypes=[object])
    exact = np.dot(whole(queries), whole(rows).T)
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def best_of_tile(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best scores, ties to the lower column; ``own`` is left out."""
    width = scores.shape[1]
    keep = ~own
    if width > k:
        # One more than k, and one more for each own column, as those may be among the best.
        spare = min(width, k + int(own.sum(axis=1).max(initial=0)))
        least = -np.partition(-scores, spare - 1, axis=1)[:, spare - 1]
        keep &= scores >= least[:, None]
    row, column = np.nonzero(keep)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[rank < k], column[rank < k]


class Best:
    """The best rows so far of each query of a tile: scores descending, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids = ids
        self.score = np.full((len(ids), k), FREE)
        self.vec_id = np.full((len(ids), k), LAST)

    def meet(self, queries: np.ndarray, vec_ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in a tile of rows, whose ids ascend. Only what beats a query's last place is sorted."""
        k = self.score.shape[1]
        for at in range(0, len(self.ids) if k else 0, BLOCK):
            part = slice(at, at + BLOCK)
            scores = products(queries[part], rows)
            ids, last, last_id = self.ids[part], self.score[part, -1], self.vec_id[part, -1]
            if (last == FREE).any():
                row, column = best_of_tile(scores, ids[:, None] == vec_ids[None, :], k)
            else:
                least = last.astype(scores.dtype)
                if scores.dtype != np.int64:
                    least = np.where(least.astype(np.float64) > last, np.nextafter(least, least.dtype.type(-np.inf)), least)
                row, column = np.divmod(np.flatnonzero(scores >= least[:, None]), scores.shape[1])
            score, found = scores[row, column].astype(np.int64), vec_ids[column]
            better = (score > last[row]) | ((score == last[row]) & (found < last_id[row]))
            better &= found != ids[row]
            row, score, found = row[better], score[better], found[better]
            some, number = np.unique(row, return_inverse=True)
            if not len(some):
                continue
            number = np.concatenate([number, np.repeat(np.arange(len(some)), k)])
            score = np.concatenate([score, self.score[at + some].ravel()])
            found = np.concatenate([found, self.vec_id[at + some].ravel()])
            # ~ turns the order of whole numbers round, that of the least one too.
            order = np.lexsort((found, ~score, number))
            first = np.searchsorted(number[order], np.arange(len(some)))
            kept = order[(first[:, None] + np.arange(k)).ravel()]
            self.score[at + some] = score[kept].reshape(-1, k)
            self.vec_id[at + some] = found[kept].reshape(-1, k)

    def rows(self, lane: int) -> pa.RecordBatch:
        query, place = np.nonzero(self.score != FREE)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[query]),
                pa.array(self.vec_id[query, place]),
                pa.array(self.score[query, place]),
                pa.array(np.full(len(query), lane, dtype=np.int32)),
            ],
            names=["query_id", "vec_id", "score", "branch"],
        )


def lanes_for(vectors: DataFrame, is_query: Column) -> int:
    """As many lanes as the session has shuffle partitions, but no more than keep the copies of the
    queries below the rows in number, and at least one for each core."""
    spark = vectors.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, asked = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    return max(1, min(most, max(n // max(asked, 1), spark.sparkContext.defaultParallelism)))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, lanes: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each query, ties to smaller vec_id.

    ``vectors`` has (vec_id, embedding); other columns are ignored. Components become
    floor(scale * x); the score is their inner product. Rows with a null id, a null vector, or a
    null or non-finite component take no part; vectors of different lengths have no score. A query's
    own id is no candidate. Of repeated query ids the least vector asks; repeated candidates each
    count. Fewer than ``k`` candidates give fewer rows, an empty table none.

    Rows are dealt to ``lanes`` as packed tiles; the query tiles, a stated share of the rows, are sent
    to every lane (not to one task, nor to all tasks at once). By default there are no more lanes than make
    the copies of the queries as many as the rows, so that what is sent grows as the input, see
    ``lanes_for``. A lane keeps each query's best rows so far and tells them at its end. Its lists meet those
    of other lanes in a tree, ``FAN_IN`` lanes a step, so no task holds more lists.
    """
    if vectors.schema["embedding"].dataType.elementType.typeName() not in ("float", "double"):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    x = F.col("embedding")
    known = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL")
    lanes = lanes or lanes_for(known, is_query)
    known = known.filter(x.isNotNull())
    rows = known.mapInArrow(_packed(ROW_TILE), TILES).withColumn(
        "lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")
    )
    # Here the parts are tested first, as the least vector of an id must be a usable one.
    usable = known.filter(is_query).filter(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    asked = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asking = asked.mapInArrow(_packed(QUERY_TILE), TILES).select(
        "dims",
        F.col("ids").alias("query_ids"),
        F.col("data").alias("query_data"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
    )
    kind = np.dtype({"float": "f4", "double": "f8"}[vectors.schema["embedding"].dataType.elementType.typeName()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(batch: pa.RecordBatch, i: int, ids: str, data: str) -> tuple[np.ndarray, np.ndarray]:
            number = np.frombuffer(batch.column(ids)[i].as_buffer(), dtype=np.int64)
            block = np.frombuffer(batch.column(data)[i].as_buffer(), dtype=kind)
            return number, integers(block.reshape(len(number), batch.column("dims")[i].as_py()), scale)

        held: dict[tuple[int, int], Best] = {}
        at, queries, last, found = None, 0, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                lane, ids = batch.column("lane")[i].as_py(), batch.column("ids")[i]
                if lane != at or queries > HELD_QUERIES:
                    yield from (best.rows(at) for best in held.values())
                    held, at, queries, last = {}, lane, 0, None
                if last is None or not ids.equals(last):
                    # The tile of rows stays the same while tiles of queries meet it.
                    last, found = pa.scalar(ids.as_py(), ids.type), tile(batch, i, "ids", "data")
                query_ids, asks = tile(batch, i, "query_ids", "query_data")
                key = (asks.shape[1], int(query_ids[0]))
                if key not in held:
                    held[key] = Best(query_ids.copy(), k)
                    queries += len(query_ids)
                if found[1].shape[1] != asks.shape[1]:
                    found = tile(batch, i, "ids", "data")
                held[key].meet(asks, *found)
        yield from (best.rows(at) for best in held.values())

    best = (
        rows.join(asking, ["dims", "lane"])
        .select("dims", "lane", "query_ids", "query_data", "ids", "data")
        .mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, branch int")
    )
    width = lanes
    while width > 1:
        width = -(-width // FAN_IN)
        best = best.withColumn("branch", (F.col("branch") / FAN_IN).cast("int"))
        order = Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
