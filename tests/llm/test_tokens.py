from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from burstselect.llm import queries, tokens  # noqa: E402
from burstselect.llm.bpe import tokenizer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bits(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1000, dtype=np.uint64).astype("<u4")
    packed = tokens.pack_bits(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    for first, count in ((0, 1000), (7, 100), (999, 1), (500, 0)):
        assert (tokens.unpack_bits(packed, bits, first, count) == ids[first : first + count]).all()


def test_bits_needed():
    assert [tokens.bits_needed(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("bits", [11, 16])
def test_random_access(bits):
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 90, 50)
    ids = rng.integers(0, 2**bits, sizes.sum()).astype("<u4")
    writer, lines, at = tokens._Writer(3, bits, 64), [], 0
    for i in range(0, 50, 7):
        some = sizes[i : i + 7]
        lines += writer.add(pa.array(range(i, i + len(some))), some, ids[at : at + some.sum()])
        at += some.sum()
    lines += writer.end()
    file = tokens.TokenFile(b"".join(x + b"\n" for x in lines))
    assert (file.number, file.ids, file.bits) == (3, len(ids), bits)
    begin = np.cumsum(sizes) - sizes
    for i in range(50):
        assert (file.document(i) == ids[begin[i] : begin[i] + sizes[i]]).all()
    for start, stop in ((0, len(ids)), (63, 65), (64, 64), (100, 500)):
        assert (file.stretch(start, stop) == ids[start:stop]).all()
    with pytest.raises(IndexError):
        file.stretch(0, len(ids) + 1)
    with pytest.raises(ValueError):
        tokens.TokenFile(b"x" * 200)


def texts():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "Über", "shine\n", "x1y2", "日本", "don't"]) for _ in range(rng.randint(0, 300)))) for i in range(200)]
    return [*rows, (1000, None), (1001, ""), (1002, "a" * 5000), (1003, "wide world " * 8000)]


def expected(rows):
    t, at, out = tokenizer(PATH), 0, []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), ids.tobytes()))
        at += len(ids)
    return out


def test_files(spark, tmp_path):
    rows = texts()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, salt string").repartition(5)
    tokens.write_tokens(docs, PATH, f"{tmp_path}/t", file_chars=20_000, block_ids=512)
    assert spark.read.parquet(f"{tmp_path}/t/files").count() > 3
    read = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_tokens(spark, f"{tmp_path}/t").orderBy("doc_id").collect()]
    assert read == expected(rows)
    some = tokens.read_tokens(spark, f"{tmp_path}/t", wanted=[7, 1003, 5555]).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start) for r in some] == [(d, s) for d, s, _, _ in read if d in (7, 1003)]


def test_odd_rows(spark, tmp_path):
    rows = [(None, "nobody"), (None, "nobody"), (None, "no one"), (5, "same"), (5, "same"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens.write_tokens(docs, PATH, f"{tmp_path}/t", file_chars=12)
    read = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in tokens.read_tokens(spark, f"{tmp_path}/t").collect())
    at = 0
    for start, _, n, _ in read:
        assert start == at
        at += n
    assert [r[1] for r in read] == [None] * 3 + [5] * 3
    assert sorted(r[3] for r in read) == sorted(x[3] for x in expected(rows))
    tokens.write_tokens(docs.where("1 = 0"), PATH, f"{tmp_path}/e")
    assert tokens.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_query(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_token_output(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == [(d, s, n, zlib.crc32(ids)) for d, s, n, ids in expected(rows)]
