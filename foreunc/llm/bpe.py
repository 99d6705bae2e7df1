"""Byte-level BPE without regular expressions on the text.

Every code point has a class; a symbol is a class with what follows it (an apostrophe that opens a
contraction, white space before a word). Each symbol is a transition function over eight states,
functions compose associatively, and a doubling scan over the composed functions gives the state
before every code point at once, hence the starts of all pre-tokens. The slices between them go
through pair merging once per distinct slice and task; token offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from foreunc.llm.common import lists, slices, spread_runs

LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, END = range(7)
#: Symbols: a letter, number or other sign; a quote that opens a contraction of one or two letters;
#: a blank or other white space before a sign; white space before white space or the end; a break.
S_LETTER, S_NUMBER, S_OTHER, S_ONE, S_TWO, S_BLANK, S_LAST, S_INNER, S_BREAK = range(9)
#: States: what the code point before was part of.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
#: Distinct slices a task keeps the merges of before it starts anew.
CACHE_SLICES = 300_000
#: Bytes of a slice up to which a plain search for the next pair is the quicker way.
SHORT = 48
NO_RANK = 1 << 62


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token starts, by symbol and state."""
    target = np.zeros((9, STATES), dtype=np.uint8)
    starts = np.ones((9, STATES), dtype=bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        target[symbol] = state
        starts[symbol, [state, AFTER_BLANK]] = False
    target[S_LETTER, ONE_LEFT], target[S_LETTER, TWO_LEFT] = FREE, ONE_LEFT
    starts[S_LETTER, [ONE_LEFT, TWO_LEFT]] = False
    for symbol, state in ((S_ONE, ONE_LEFT), (S_TWO, TWO_LEFT)):
        target[symbol] = state
        target[symbol, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_BLANK]] = False
    target[S_BLANK], target[S_LAST], target[S_INNER] = AFTER_BLANK, FREE, IN_WHITE
    starts[S_INNER, IN_WHITE] = False
    return target, starts


def _monoid(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the transition functions, numbered.

    Returns the number of each symbol's function, the table of compositions (first row, then
    column), the image of state FREE, and whether a function is constant.
    """
    functions = {tuple(row): None for row in target.tolist()}
    functions = {f: i for i, f in enumerate(functions)}
    known = list(functions)
    for f in known:
        for g in target.tolist():
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = len(known)
                known.append(h)
    size = len(known)
    table = np.empty((size, size), dtype=np.uint8 if size <= 256 else np.uint16)
    for i, f in enumerate(known):
        for j, g in enumerate(known):
            table[i, j] = functions[tuple(g[x] for x in f)]
    number = np.array([functions[tuple(row)] for row in target.tolist()], dtype=table.dtype)
    image = np.array([f[FREE] for f in known], dtype=np.uint8)
    return number, table, image, np.array([len(set(f)) == 1 for f in known])


TARGET, STARTS = _machine()
NUMBER_OF, COMPOSED, IMAGE, CONSTANT = _monoid(TARGET)


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own engine has them."""
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(letters)
    singles = {bytes([i]): i for i in range(256)}
    classes = np.full(0x110001, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        matched = bytes(found.encode_ordinary(everything)).decode()
        classes[np.frombuffer(matched.encode("utf-32-le"), dtype=np.uint32)] = kind
    classes[ord(" ")], classes[ord("'")], classes[0x110000] = SPACE, QUOTE, END
    return classes


def symbols(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of every code point; 0x110000 marks the break after each text."""
    kind = classes[codes]
    after = np.append(kind[1:], np.uint8(END))
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_LAST, S_OTHER, S_BREAK], dtype=np.uint8)[kind]
    white = (kind == SPACE) | (kind == WHITE)
    ends = (after == SPACE) | (after == WHITE) | (after == END)
    out[white & ends] = S_INNER
    quotes = np.flatnonzero((kind == QUOTE) & (after == LETTER))
    if len(quotes):
        padded = np.append(codes, np.array([0x110000, 0x110000], dtype=codes.dtype))
        first, second = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = (np.isin(first, [ord("r"), ord("v")]) & (second == ord("e"))) | (
            (first == ord("l")) & (second == ord("l"))
        )
        out[quotes[one]], out[quotes[two]] = S_ONE, S_TWO
    return out


def slice_starts(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token, or a break, starts at each code point.

    Prefix scan by doubling over composed transition functions. It ends as soon as every prefix is
    known: where the composition over the last 2^k symbols is constant, what came before is moot.
    """
    symbol = symbols(codes, classes)
    scan = NUMBER_OF[symbol]
    step = 1
    while step < len(scan) and not CONSTANT[scan[step:]].all():
        scan[step:] = COMPOSED[scan[:-step], scan[step:]]
        step *= 2
    state = np.empty(len(scan), dtype=np.uint8)
    state[:1] = FREE
    state[1:] = IMAGE[scan[:-1]]
    return STARTS[symbol, state]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank of every token in a rank file (base64 token, blank, rank)."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one slice: again and again the pair of least rank, the leftmost first.

    Short slices are searched for that pair each time; longer ones keep a heap of pairs over a
    linked list, n log n in the slice's length.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    if size <= SHORT:
        parts = [piece[i : i + 1] for i in range(size)]
        pairs = [ranks.get(piece[i : i + 2], NO_RANK) for i in range(size - 1)]
        while pairs and (least := min(pairs)) < NO_RANK:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        return [ranks[x] for x in parts]
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    end = list(range(1, size + 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * size
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else size
        if j >= size or end[j] != to or not alive[j]:
            continue
        end[i], alive[j], after[i] = to, False, after[j]
        if after[i] < size:
            before[after[i]] = i
            rank = ranks.get(piece[i : end[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))
        if before[i] >= 0:
            rank = ranks.get(piece[before[i] : to])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], to))
    out, i = [], 0
    while i < size:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class SliceCache(dict):
    """Number of each distinct slice; its tokens lie at ``start[number]`` of a flat list."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.flat, self.start, self.count = ranks, [], [], []

    def __missing__(self, piece: str) -> int:
        tokens = merge_pairs(piece.encode(), self.ranks)
        self.start.append(len(self.flat))
        self.count.append(len(tokens))
        self.flat += tokens
        self[piece] = number = len(self.start) - 1
        return number


class Encoder:
    """Encodes lists of texts; one per task."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.cache = SliceCache(ranks)
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in turn, the byte offset of each in its text, ids per text."""
        if len(self.cache) > CACHE_SLICES:
            self.cache = SliceCache(self.ranks)
        joined = "\0".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).copy()
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[breaks] = 0x110000
        bounds = np.flatnonzero(slice_starts(codes, self.classes))
        real = codes[bounds] != 0x110000
        begin, end = bounds[real], bounds[np.flatnonzero(real) + 1]
        pieces = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        number = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        counts = np.array(self.cache.count, dtype=np.int64)[number]
        flat = np.array(self.cache.flat, dtype=np.int32)
        ids = flat[spread_runs(np.array(self.cache.start, dtype=np.int64)[number], counts)]
        text_of = np.searchsorted(breaks, begin)
        per_text = np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64)
        return ids, token_offsets(self.lengths[ids], per_text), per_text


def token_offsets(lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Byte offset of each token in its text."""
    offsets = np.cumsum(lengths) - lengths
    first = np.cumsum(per_text) - per_text
    base = np.append(offsets, 0)[np.minimum(first, len(offsets))]
    return (offsets - np.repeat(base, per_text)).astype(np.int32)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, offsets) of every row of ``docs`` (doc_id, text); other columns are ignored.

    ``path`` is a rank file on the driver; its vocabulary (bounded by the file, under 1 MB) is
    broadcast. ``offsets`` holds the byte at which each token starts. Null and empty texts have no
    ids. Every row stays, repeated rows and null ids included. One row is worked on at once however
    long it is, otherwise about 1 MB of text.
    """
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), code_point_classes().tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = shared.value
        encoder = Encoder(read_ranks(ranks), np.frombuffer(classes, dtype=np.uint8))
        for part in slices(batches, "text"):
            ids, offsets, counts = encoder([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), lists(ids, counts, pa.int32()), lists(offsets, counts, pa.int32())],
                names=["doc_id", "ids", "offsets"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, offsets array<int>"
    )


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of encoded rows: each token's bytes are put at its offset.

    ``decoded`` is binary; null ids give empty bytes. Offsets that don't follow from the ids, or ids
    without a token, are an error rather than a wrong text.
    """
    with open(path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(shared.value)
        tokens = [b""] * (max(ranks.values(), default=0) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        del ranks
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        places = np.cumsum(lengths) - lengths
        table = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts = flattened(part.column("ids"))
                offsets, _ = flattened(part.column("offsets"))
                if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens) or not lengths[ids].all()):
                    raise ValueError("an id has no token")
                size = lengths[ids]
                if not np.array_equal(token_offsets(size, counts), offsets):
                    raise ValueError("offsets and ids disagree")
                data = table[spread_runs(places[ids], size)]
                ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
                decoded = pa.Array.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ids"), decoded], names=["doc_id", "ids", "decoded"]
                )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids", "offsets").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded binary"
    )


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in turn and the number in each row."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), counts
