"""Token ids as files of compressed byte or bit planes.

A shard file is ``MAGIC``, the compressed chunks, the chunk index and a footer. A chunk holds a
fixed number of ids (the last one fewer); its ids are transposed so that all first bytes (or bits)
come first, then all second ones, and so on; each plane is compressed on its own. The index says
where each chunk lies, how many ids and planes it has, and the crc of its ids; the numbers of the
documents and their lengths follow in the same form. All integers are little-endian.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foreunc.llm.common import slices, split_words, spread_runs

MAGIC = b"IDPLANE1"
FOOTER = "<QQ8s"
ENTRY = "<QQIBBI"
CHUNK_IDS = 1 << 16
#: Distinct words a task keeps the ids of before it starts anew.
CACHE_WORDS = 1_000_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 4 << 20
#: Bytes of text in a shard, about: the larger, the fewer words are encoded in several tasks.
SHARD_BYTES = 64 << 20
IDS, DOC_IDS, VALID, LENGTHS = range(4)
KINDS = {IDS: np.dtype("<u4"), DOC_IDS: np.dtype("<i8"), VALID: np.dtype("u1"), LENGTHS: np.dtype("<u4")}


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or a URI."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def to_planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (or bit planes) of a block, the lowest first; upper planes of zeros are left out."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
    used = np.flatnonzero(rows.any(axis=0))
    planes = rows[:, : used[-1] + 1 if len(used) else 0].T
    return [np.packbits(p).tobytes() if bits else p.tobytes() for p in planes]


def from_planes(planes: list[bytes], count: int, kind: np.dtype, bits: bool = False) -> np.ndarray:
    """The block whose planes these are."""
    width = kind.itemsize * (8 if bits else 1)
    rows = np.zeros((count, width), dtype=np.uint8)
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        rows[:, i] = np.unpackbits(raw, count=count) if bits else raw
    if bits:
        rows = np.packbits(rows, axis=1, bitorder="little")
    return rows.reshape(-1).view(kind)


class ShardWriter:
    """Writes one shard; holds no more than a chunk of each kind."""

    def __init__(self, sink, chunk: int = CHUNK_IDS, bits: bool = False, level: int = 1):
        self.sink, self.chunk, self.bits = sink, chunk, bits
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting = {k: [] for k in KINDS}
        self.held = dict.fromkeys(KINDS, 0)
        self.total = dict.fromkeys(KINDS, 0)
        self.index: list[bytes] = []
        self.at = len(MAGIC)
        sink.write(MAGIC)

    def add(self, kind: int, values: np.ndarray) -> None:
        self.waiting[kind].append(values.astype(KINDS[kind], copy=False))
        self.held[kind] += len(values)
        if self.held[kind] >= self.chunk:
            every = np.concatenate(self.waiting[kind])
            full = len(every) // self.chunk * self.chunk
            for i in range(0, full, self.chunk):
                self._flush(kind, every[i : i + self.chunk])
            self.waiting[kind], self.held[kind] = [every[full:]], len(every) - full

    def _flush(self, kind: int, block: np.ndarray) -> None:
        packed = [self.packer.compress(p) for p in to_planes(block, self.bits)]
        data = struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)
        crc = zlib.crc32(block.tobytes())
        self.index.append(struct.pack(ENTRY, self.at, self.total[kind], len(block), kind, len(packed), crc))
        self.total[kind] += len(block)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        for kind in KINDS:
            block = np.concatenate([*self.waiting[kind], np.empty(0, KINDS[kind])])
            if len(block):
                self._flush(kind, block)
        index = b"".join(self.index)
        self.sink.write(index + struct.pack(FOOTER, self.at, len(self.index), MAGIC))


class ShardReader:
    """Reads a shard; decompresses one chunk at a time."""

    def __init__(self, source, bits: bool = False):
        self.source, self.bits = source, bits
        source.seek(source.size() - struct.calcsize(FOOTER))
        at, count, magic = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        source.seek(at)
        self.index = list(struct.iter_unpack(ENTRY, source.read(count * struct.calcsize(ENTRY))))
        self.unpacker = zstandard.ZstdDecompressor()

    def chunks(self, kind: int) -> Iterator[np.ndarray]:
        for at, _, count, what, planes, crc in self.index:
            if what != kind:
                continue
            self.source.seek(at)
            sizes = struct.unpack(f"<{planes}I", self.source.read(4 * planes))
            raw = [self.unpacker.decompress(self.source.read(n)) for n in sizes]
            block = from_planes(raw, count, KINDS[kind], self.bits)
            if zlib.crc32(block.tobytes()) != crc:
                raise ValueError("a chunk is damaged")
            yield block

    def column(self, kind: int) -> np.ndarray:
        return np.concatenate([*self.chunks(kind), np.empty(0, KINDS[kind])])


class WordCache(dict):
    """Number of each distinct stem; its ids, from the tokenizers library, lie in a flat list.

    A final stop or comma after a letter or digit is a token of its own under this pattern, and
    letters are lowered before the merges, so a word's forms share one stem. A stem of a-z alone
    passes the library's normaliser and pattern unchanged and goes straight to its merges.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.flat, self.start, self.count = array("I"), array("q"), array("q")
        self.stop, self.comma = (self.library(t)[0] for t in (".", ","))

    def library(self, stem: str) -> list[int]:
        if stem.isascii() and stem.isalpha():
            return [token.id for token in self.model.tokenize(stem)]
        return self.tokenizer.encode(stem, add_special_tokens=False).ids

    def __missing__(self, stem: str) -> int:
        ids = self.library(stem)
        self.start.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        self[stem] = number = len(self.start) - 1
        return number

    def stems(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The stem of each word, and the id of the stop or comma after it, or -1.

        Words with ``<`` may be special tokens and stay as they are.
        """
        plain = pc.invert(pc.match_substring(words, "<"))
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        tailed = pc.and_(plain, pc.match_substring_regex(words, r"[a-z0-9][.,]$"))
        stops = pc.ends_with(words, ".").to_numpy(zero_copy_only=False)
        tail = np.where(tailed.to_numpy(zero_copy_only=False), np.where(stops, self.stop, self.comma), -1)
        return pc.if_else(tailed, pc.utf8_slice_codeunits(words, 0, -1), words), tail

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each with ``end_id`` after it; ids per text."""
        found, words = split_words(texts)
        coded = found.dictionary_encode()
        stems, tail = self.stems(coded.dictionary)
        stems = stems.dictionary_encode()
        distinct = stems.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        number = number[stems.indices.to_numpy(zero_copy_only=False)][code]
        counts = np.frombuffer(self.count, dtype=np.int64)[number] if len(number) else number
        starts = np.frombuffer(self.start, dtype=np.int64)[number] if len(number) else number
        ids = np.frombuffer(self.flat, dtype=np.uint32)[spread_runs(starts, counts)] if len(number) else number
        after = np.append(0, np.cumsum(counts))
        tail = tail[code]
        tailed = np.flatnonzero(tail >= 0)
        last = np.cumsum(words)
        # The stop of a text's last word stands before its end.
        at = np.concatenate([after[tailed + 1], after[last]])
        put = np.concatenate([tail[tailed], np.full(len(last), end_id)])
        lengths = after[last] + np.append(0, np.cumsum(tail >= 0))[last]
        return np.insert(ids, at, put), np.diff(lengths, prepend=0) + 1


def write_ids(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, bits: bool = False
) -> DataFrame:
    """Encode every text and write its ids, then ``end_id``, in ascending doc_id order.

    Null and empty texts have ``end_id`` alone; null doc_ids come first; repeated rows are written
    each. Rows are dealt by ranges of doc_id, a task writes one shard under another name and renames
    it when it is whole, so a task that runs again does no harm. Blanks part words under this kind
    of tokenizer (it drops white space before it merges), so each distinct word is encoded once
    per task. Returns one row (shard, docs, ids) per shard; the rows also stand in
    ``manifest.json``, the only thing that passes through the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    files, root = place(folder)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        shard, writer, sink, cache = TaskContext.get().partitionId(), None, None, None
        name, draft = f"{root}/shard-{shard:06d}.planes", f"{root}/.draft-{uuid.uuid4().hex}"
        for part in slices(batches, "text", SLICE_BYTES):
            if writer is None:
                sink = files.open_output_stream(draft)
                writer = ShardWriter(sink, bits=bits)
                tokenizer = Tokenizer.from_buffer(shared.value)
                cache = WordCache(tokenizer)
            if len(cache) > CACHE_WORDS:
                cache = WordCache(tokenizer)
            ids, lengths = cache.encode(part.column("text"), end_id)
            keys = part.column("doc_id")
            writer.add(IDS, ids)
            writer.add(DOC_IDS, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            writer.add(VALID, keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            writer.add(LENGTHS, lengths)
        if writer is not None:
            writer.close()
            sink.close()
            files.move(draft, name)
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "docs": [writer.total[LENGTHS]], "ids": [writer.total[IDS]]}
            )

    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(1 + size // SHARD_BYTES, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "shard bigint, docs bigint, ids bigint")
        .collect()
    )
    manifest, start = [], 0
    for row in sorted(rows, key=lambda r: r.shard):
        manifest.append({"shard": row.shard, "docs": row.docs, "ids": row.ids, "start": start})
        start += row.ids
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"bits": bits, "shards": manifest}).encode())
    return spark.createDataFrame(
        [(m["shard"], m["docs"], m["ids"]) for m in manifest], "shard bigint, docs bigint, ids bigint"
    )


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a folder of shards.

    A task reads one shard, chunk by chunk. ``start`` counts the ids of all documents before.
    An empty folder of shards gives no rows.
    """
    files, root = place(folder)
    with files.open_input_stream(f"{root}/manifest.json") as f:
        shards = len(json.loads(f.read())["shards"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = place(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                with files.open_input_stream(f"{root}/manifest.json") as f:
                    manifest = json.loads(f.read())
                entry = manifest["shards"][number]
                with files.open_input_file(f"{root}/shard-{entry['shard']:06d}.planes") as source:
                    reader = ShardReader(source, manifest["bits"])
                    lengths = reader.column(LENGTHS).astype(np.int64)
                    ends = np.cumsum(lengths)
                    crcs = document_crcs(reader, ends)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.column(DOC_IDS), mask=reader.column(VALID) == 0),
                            pa.array(entry["start"] + ends - lengths),
                            pa.array(lengths),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return spark.range(0, shards, 1, max(shards, 1)).mapInArrow(run, schema)


def document_crcs(reader: ShardReader, ends: np.ndarray) -> list[int]:
    """crc32 of each document's ids, chunk by chunk."""
    crcs, doc, crc, at = [], 0, 0, 0
    for block in reader.chunks(IDS):
        raw, begin = memoryview(block.tobytes()), at
        stop = at + len(block)
        while doc < len(ends) and ends[doc] <= stop:
            crcs.append(zlib.crc32(raw[4 * (begin - at) : 4 * (int(ends[doc]) - at)], crc))
            begin, crc, doc = int(ends[doc]), 0, doc + 1
        crc = zlib.crc32(raw[4 * (begin - at) :], crc)
        at = stop
    return crcs
