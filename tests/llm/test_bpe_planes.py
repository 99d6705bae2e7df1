import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from foreunc.llm import bpe, planes, queries

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n x", "it's they'll 'tis 's're", "'" * 70, "a" * 3000, " " * 99 + "x\t", "漢字 ñß１２　é́",
       "<|endoftext|> x<|startoftext|>", "A B\x1cC\u0085D İ ΑΣ", "\U0001f600 ﬁ ½"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_documents(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(3, ODD[3], "x", "y"), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded string")


def test_random_texts_split_as_the_library_does(library):
    draw = random.Random(7)
    signs = [*"abstrevldm '’\n\t19é,.!　ßñ", "'s", "'ll", "'re", "  ", "\U0001f600", "漢"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(3000)]
    encoder = bpe.Encoder(library._mergeable_ranks, bpe.code_point_classes())
    ids, _, counts = encoder(texts)
    want = [library.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_merges_of_long_and_short_slices_agree(library, monkeypatch):
    draw, ranks = random.Random(3), library._mergeable_ranks
    pieces = [bytes(draw.choices(b"abetionsh", k=draw.randint(1, 90))) for _ in range(300)]
    plain = [bpe.merge_pairs(p, ranks) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.merge_pairs(p, ranks) for p in pieces] == plain


def test_encoding_round_trip_of_odd_rows(spark, library):
    docs = odd_documents(spark)
    encoded = bpe.encode_documents(docs, RANKS)
    got = bpe.decode_documents(encoded, RANKS).collect()
    assert len(got) == len(ODD) + 2
    texts = {**dict(enumerate(ODD)), None: "no id"}
    for row in got:
        text = texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text) and bytes(row.decoded) == text.encode()
    assert encoded.limit(0).count() == 0
    empty = bpe.decode_documents(bpe.encode_documents(docs.filter("false"), RANKS), RANKS)
    assert empty.collect() == []


def test_op1_against_the_library(spark, library):
    docs = {r.doc_id: r.text for r in queries.table(spark, FOLDER, "documents").collect()}
    got = queries.REGISTRY["op1_byte_bpe"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for row in got:
        ids = library.encode_ordinary(docs[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((docs[row.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    draw = np.random.default_rng(1)
    for kind in planes.KINDS.values():
        for count in (0, 1, 7, 1000):
            high = min(np.iinfo(kind).max, 60000) if count != 7 else np.iinfo(kind).max
            values = draw.integers(0, high, count, endpoint=True).astype(kind)
            assert planes.from_planes(planes.to_planes(values, bits), count, kind, bits).tolist() == values.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_shard_keeps_chunks_apart(bits):
    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    sink, values = io.BytesIO(), np.arange(1000, dtype=np.uint32) * 77
    writer = planes.ShardWriter(sink, chunk=64, bits=bits)
    for part in np.array_split(values, 9):
        writer.add(planes.IDS, part)
    writer.close()
    reader = planes.ShardReader(Source(sink.getvalue()), bits)
    assert [len(c) for c in reader.chunks(planes.IDS)] == [64] * 15 + [40]
    assert reader.column(planes.IDS).tolist() == values.tolist()
    assert len(sink.getvalue()) > 0 and reader.column(planes.DOC_IDS).tolist() == []


def wanted(rows, tokenizer):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_op10_against_the_library(spark):
    docs = queries.table(spark, FOLDER, "documents").collect()
    got = queries.REGISTRY["op10_id_planes"](spark, FOLDER).collect()
    rows = sorted((r.doc_id, r.text) for r in docs)
    assert sorted(map(tuple, got)) == wanted(rows, Tokenizer.from_file(WORDS))


def test_id_files_of_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    planes.write_ids(docs, str(tmp_path / "a"), WORDS, 2, bits=True)
    got = planes.read_ids(spark, str(tmp_path / "a")).collect()
    rows = [(None, "no id"), *((i, t) for i, t in enumerate(ODD[:4])), *((i, t) for i, t in enumerate(ODD) if i >= 3)]
    assert sorted(map(tuple, got), key=lambda r: r[1]) == wanted(rows, Tokenizer.from_file(WORDS))
    planes.write_ids(docs.filter("false"), str(tmp_path / "b"), WORDS, 2)
    assert planes.read_ids(spark, str(tmp_path / "b")).collect() == []
