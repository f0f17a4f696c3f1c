from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from burstselect.llm import periodic, queries


def brute(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made_words(rng):
    alphabet, words = rng.choice([1, 2, 3, 10, 60]), []
    while len(words) < rng.choice([0, 5, 12, 40, 150, 500]):
        if rng.random() < 0.4:
            words += [rng.randrange(alphabet) for _ in range(rng.randint(1, 20))]
        else:
            block = [rng.randrange(alphabet) for _ in range(rng.randint(1, rng.choice([3, 10, 60])))]
            words += (block * 5)[: rng.randint(len(block), 4 * len(block))]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        texts = [made_words(rng) for _ in range(rng.randint(1, 6))]
        words = np.array([w for t in texts for w in t], np.int64)
        if not len(words):
            continue
        got = periodic.runs(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
        begin = np.cumsum([0, *(len(t) for t in texts)])
        want = [(s + b, s + n + b, q) for t, b in zip(texts, begin, strict=False) for s, n, q in brute(t)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_segments_hold_every_word_twice():
    rng = np.random.default_rng(1)
    words, text = rng.integers(0, 40, 3000), np.repeat(np.arange(30), 100)
    places, segment = periodic.segments(words, text, 12)
    for s in np.unique(segment):
        at = places[segment == s]
        assert len(at) >= 12 and len(set(text[at])) == 1 and (np.diff(at) == 1).all()
        assert (np.unique(words[at], return_counts=True)[1] > 1).all()


@pytest.mark.parametrize("period", [1, 7, 8, 9, 63, 64, 65, 5000])
def test_long_texts(period):
    words = np.concatenate([np.arange(10**6, 10**6 + 50), np.arange(120_000) % period, np.arange(2 * 10**6, 2 * 10**6 + 50)])
    got = periodic.runs(words, np.zeros(len(words), np.int64))
    assert got.tolist() == [[50, 120_050, period]]


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "x " * 30, "d"), (4, "x " * 30, "d"), (None, "p q\x0br\n" * 5, "e"), (6, "so it is", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, body string, text string").repartition(3)
    out = {(r.doc_id, r.text): r for r in periodic.periodic_runs(docs, "body", ["text"]).collect()}
    assert len(out) == 6 and [out[k].n_words for k in ((1, "a"), (2, "b"), (3, "c"))] == [0, 0, 0] and out[1, "a"].collapsed == ""
    assert [tuple(r) for r in out[4, "d"].runs] == [(0, 30, 1)] and out[4, "d"].collapsed == "x"
    assert [tuple(r) for r in out[None, "e"].runs] == [(0, 15, 3)] and out[None, "e"].collapsed == "p q r"
    assert out[6, "f"].runs == [] and out[6, "f"].collapsed == "so it is"
    assert periodic.periodic_runs(docs.where("1 = 0"), "body").count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{w}" for w in made_words(rng))) for i in range(400)] + [(400, None), (401, ""), (402, "é ß  ß\n" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            looped += 1
        found = brute(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        row = got[doc_id]
        assert row.n_runs == len(found)
        assert (row.start, row.length, row.period, row.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert looped and len(got) == len(rows)
