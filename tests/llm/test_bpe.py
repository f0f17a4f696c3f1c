"""Encoding and decoding against the library itself."""

from __future__ import annotations

import json
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from burstselect.llm import bpe  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["abcdefgh", "ab ", "the an'llvesd'", "a é́ü̧", "!?.,'#", "01ab", " \n\tab", "日本語ab", "a<|endoftext|>", "\x1c\x85 　 a", "İΣσß'S"]


def texts(seed, n, longest):
    rng = random.Random(seed)
    out = ["", " ", "\n", "a", "  a  b ", "x <|endoftext|> y", "<|startoftext|>a<|endoftext|>", "a  <|endoftext|>", "'S 'll we'LL", "́a"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            alphabet = rng.choice(ALPHABETS)
            parts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_token_is_what_its_bytes_become(path):
    """Under this condition merging by id equals merging by the file's list."""
    file = json.load(open(path, encoding="utf-8"))["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(file["merges"])}
    suffix = file["end_of_word_suffix"] or ""
    base = len(file["vocab"]) - len(rank)
    for token, i in file["vocab"].items():
        if i >= base and not token.startswith("<|"):
            ends = suffix and token.endswith(suffix)
            parts = list(token[: -len(suffix)] if ends else token)
            if ends:
                parts[-1] += suffix
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), 1 << 30))
                assert (parts[best], parts[best + 1]) in rank, token
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            assert rank[max_merge(file, token, rank)] == i - base


def max_merge(file, token, rank):
    """The merge that makes the token: the last one of its own encoding."""
    suffix = file["end_of_word_suffix"] or ""
    ends = suffix and token.endswith(suffix)
    parts = list(token[: -len(suffix)] if ends else token)
    if ends:
        parts[-1] += suffix
    last = None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), 1 << 30))
        last = (parts[best], parts[best + 1])
        parts[best : best + 2] = ["".join(last)]
    return last


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_character(path):
    kind = bpe.word_ends if path == WORD else bpe.whole_texts
    rows = ["".join(f"a{chr(c)}{chr(c)} {chr(c)}b\n" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 64)]
    want = [e.ids for e in bpe.tokenizer(path).encode_batch(rows, add_special_tokens=False)]
    got = [list(memoryview(x).cast("I")) for x in kind(path).encode(rows)]
    assert [i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b] == []


@pytest.mark.parametrize("kind,path", [(bpe.word_ends, WORD), (bpe.whole_texts, BYTE)])
def test_words_equal_whole_texts(kind, path):
    rows = texts(1, 400, 60) + ["a" * 100_000, " " * 50_000 + "b", "ab" * 30_000, "?" * 30_000]
    want = [e.ids for e in bpe.tokenizer(path).encode_batch(rows, add_special_tokens=False)]
    got = [list(memoryview(x).cast("I")) for x in kind(path).encode(rows)]
    assert got == want


def test_joins_equal_whole_texts():
    t = bpe.tokenizer(WORD)
    rng = random.Random(2)
    for row in texts(3, 150, 1500):
        size = rng.choice([40, 97, 300, 1000])
        want = t.encode(row, add_special_tokens=False).ids
        assert bpe.join_all(t, [row[i : i + size] for i in range(0, max(1, len(row)), size)]).tolist() == want


def test_window_stays_small_in_long_unsplit_text(monkeypatch):
    t = bpe.tokenizer(WORD)
    rng = random.Random(5)
    left, right = ("".join(rng.choice("abcdefghijklmnoprst") for _ in range(20_000)) for _ in range(2))
    parts = bpe.Part.of(t, left, 0), bpe.Part.of(t, right, len(left))
    sizes, of = [], bpe.Part.of
    monkeypatch.setattr(bpe.Part, "of", staticmethod(lambda t, x, at: sizes.append(len(x)) or of(t, x, at)))
    assert bpe.join_parts(t, *parts).ids.tolist() == t.encode(left + right, add_special_tokens=False).ids
    assert max(sizes) < 2000


def test_tables(spark):
    rows = texts(7, 40, 900) + ["a" * 5000, "word " * 900, None]
    rows += rows[:3]
    df = spark.createDataFrame([(i if i % 7 else None, x, "clash") for i, x in enumerate(rows)], "doc_id int, text string, rid string")
    coded = bpe.decode(bpe.encode(df, WORD, part_chars=500), WORD)
    assert coded.columns == ["doc_id", "rid", "ids", "decoded"]
    t = bpe.tokenizer(WORD)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in rows]
    got = [(r.doc_id, r.ids, r.decoded) for r in coded.collect()]
    key = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted(got, key=key) == sorted(
        ((i if i % 7 else None, ids, t.decode(ids, skip_special_tokens=False)) for i, ids in enumerate(want)), key=key
    )
    assert {r.rid for r in coded.collect()} == {"clash"}
    assert bpe.encode(df.where("1 = 0"), WORD).count() == 0
