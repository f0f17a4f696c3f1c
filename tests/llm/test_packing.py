from __future__ import annotations

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from burstselect.llm import packing  # noqa: E402
from burstselect.llm.bpe import tokenizer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_packer_places_every_id_once_within_bounds():
    rng = random.Random(1)
    packer, placed, most = packing.Packer(100, 5, 3), [], 0
    totals = [rng.choice([1, 7, 50, 99, 100, 101, 350]) for _ in range(400)]
    for key, n in enumerate(totals):
        placed += packer.add(key, n)
        most = max(most, len(packer.open))
    closed = {p[0] for p in placed}
    rest = list(packer.leftovers())
    assert most <= 5 and not closed & {p[0] for p in rest}
    ends, windows = {}, {}
    for number, offset, (key, start, length) in placed + rest:
        ends.setdefault(key, []).append((start, length))
        windows.setdefault(number, []).append((offset, length))
    for key, n in enumerate(totals):
        at = 0
        for start, length in sorted(ends[key]):
            assert start == at
            at += length
        assert at == n
    for number, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100 and (number not in closed or at >= 97)


def test_merge_windows():
    rng = random.Random(2)
    fills = [rng.randint(1, 100) for _ in range(300)]
    out = packing.merge_windows(fills, 100)
    space = {}
    for i, (host, base) in enumerate(out):
        space.setdefault(host, []).append((base, fills[i]))
    for pieces in space.values():
        at = 0
        for base, n in sorted(pieces):
            assert base == at
            at += n
        assert at <= 100
    assert len(space) <= sum(fills) / 100 * 1.1 + 1
    assert packing.merge_windows([]) == []


def test_tables(spark):
    rng = random.Random(3)
    words = ["the", "ein", "año", "x", "\n", "1234", " "]
    rows = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 200, 1500, 9000]))) for _ in range(60)] + [None, "", "same", "same"]
    df = spark.createDataFrame([(i if i != 5 else None, x, 1) for i, x in enumerate(rows)], "doc_id long, text string, open int")
    got = packing.pack(df.repartition(5), PATH).collect()
    t = tokenizer(PATH)
    whole = {i if i != 5 else None: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(rows)}
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert docs.keys() == whole.keys()
    for key, ids in whole.items():
        pieces = sorted(docs[key], key=lambda r: r.start)
        assert [i for r in pieces for i in memoryview(r.ids).cast("I")] == ids
        assert all(r.doc_tokens == len(ids) and r.length * 4 == len(r.ids) for r in pieces)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(map(len, whole.values()))
    assert len(seqs) <= total / 2048 * 1.05 + 3
    assert packing.pack(df.where("false"), PATH).count() == 0
