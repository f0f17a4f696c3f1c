"""Exact, near and line deduplication against plain versions."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from burstselect.llm import blocks, exact_dedup, line_dedup, simhash_dedup
from burstselect.llm.common import bit_counts
from burstselect.llm.components import components
from burstselect.session import pin, scratch_path


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(parts)


def exact_rows():
    rng = random.Random(1)
    texts = [None, "", "a", "ä" * 9000, "x" * 4096, "x" * 4097, "x" * 8192, "ab" * 30_000]
    texts += ["".join(rng.choice("ab") for _ in range(rng.choice([5, 40, 200]))) for _ in range(30)]
    rows = [(i, rng.choice(texts), "n") for i in range(200)] + [(1000 + i, "hot", "n") for i in range(150)]
    return rows + [(7, "twice", "n"), (7, "twice", "n"), (None, "hot", "n"), (None, "alone", "n"), (None, "alone", "n")]


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_exact_groups(spark, block):
    rows = [r for r in exact_rows() if block > 4 or len(r[1] or "") < 300]
    got = exact_dedup.exact_groups(table(spark, rows), block_bytes=block, carry={"t": exact_dedup.text_or_empty()}).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert sorted((r.doc_id is not None, r.doc_id, r.t) for r in got) == sorted((i is not None, i, t or "") for i, t, _ in rows)
    kept = defaultdict(int)
    for r in got:
        ids = [i for i in groups[r.t] if i is not None]
        assert r.keep_id == (max(ids) if ids else None) and r.group_size == len(groups[r.t])
        kept[r.t] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_drop_copies_and_empty(spark):
    df = table(spark, exact_rows())
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in exact_rows()})
    assert exact_dedup.drop_copies(df.where("false")).count() == 0 == exact_dedup.exact_groups(df.where("false")).count()


def plain_print(text, n=3):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50, 600):
        text = "  ".join(rng.choice(["A", "bé", "É", "c\x1c", "d"]) for _ in range(n))
        assert simhash_dedup.fingerprint(text.encode()) == plain_print(text)
    text = " ".join(str(rng.random()) for _ in range(3000))
    want = simhash_dedup.fingerprint(text.encode())
    runs = simhash_dedup.word_runs
    monkeypatch.setattr(simhash_dedup, "word_runs", lambda t: runs(t, 100))
    assert simhash_dedup.fingerprint(text.encode()) == want


def test_bit_counts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    starts = np.array([0, 1, 300, 1500])
    want = [[int(((h[a:b] >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(64)] for a, b in zip(starts, [1, 300, 1500, 2000], strict=True)]
    assert bit_counts(h, starts).tolist() == want


def flipped(x, bits):
    for b in bits:
        x ^= 1 << b
    return x if x < 1 << 63 else x - (1 << 64)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    prints = {0}
    for _ in range(30):
        x = rng.getrandbits(64)
        prints |= {flipped(x, rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5]))) for _ in range(15)}
    prints |= {flipped(0, rng.sample(range(64), rng.choice([1, 3]))) for _ in range(40)}
    got = simhash_dedup.linked(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    m = (1 << 64) - 1
    want = {frozenset((a, b)) for a in prints for b in prints if a != b and bin((a ^ b) & m).count("1") <= 3}
    assert {frozenset((r.a, r.b)) for r in got} == want


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    pairs += [(1000, 1000 + i) for i in range(50)] + [(5, 5), (None, 3), (-4, -9), (-4, -9)]
    want = union([p for p in pairs if None not in p], {x for p in pairs if None not in p and p[0] != p[1] for x in p} | {5})
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want.pop(5)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for g in range(12):
        text = [rng.choice(words) for _ in range(200)]
        for k in range(4):
            copy = list(text)
            for _ in range(k):
                copy[rng.randrange(200)] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(copy), "x"))
        base.append(g * 10)
    rows += [(500, None, "x"), (501, "", "x"), (502, " \n", "x"), (0, rows[0][1], "x"), (503, "short one", "x"), (None, "nobody has this text at all", "x")]
    return rows, base


def test_near_groups(spark):
    rows, _ = near_rows()
    got = simhash_dedup.near_groups(table(spark, rows)).collect()
    prints = [(i, plain_print(t or "")) for i, t, _ in rows]
    nodes = {p for _, p in prints}
    root = union([(a, b) for a in nodes for b in nodes if a < b and bin(a ^ b).count("1") <= 3], nodes)
    low = {}
    for i, p in prints:
        if i is not None:
            low[root[p]] = min(low.get(root[p], i), i)
    want = sorted(((i is None, i or 0, p, low.get(root[p])) for i, p in prints), key=str)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint % (1 << 64), r.component_id) for r in got), key=str) == want
    assert simhash_dedup.near_groups(table(spark, rows).where("false")).count() == 0


def test_variants_are_never_broadcast(spark):
    """The table of fingerprints looks small enough to be, its variants are 66 times as many rows."""
    rng = random.Random(3)
    prints = sorted({rng.getrandbits(63) for _ in range(300)})
    prints += [p ^ 0b111 << 20 for p in prints[:20]]
    met = simhash_dedup.linked(pin(spark.createDataFrame([(p,) for p in prints], "fp long")))
    assert {tuple(sorted((r.a, r.b))) for r in met.collect()} == {tuple(sorted((p, p ^ 0b111 << 20))) for p in prints[:20]}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_drop_near_copies(spark):
    rows, base = near_rows()
    df = table(spark, rows)
    out = simhash_dedup.drop_near_copies(df)
    assert out.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert ids == sorted([(False, i) for i in [*base, 500, 503]] + [(True, 0)])
    assert simhash_dedup.drop_near_copies(df.where("false")).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain_distance(a, b)


def test_lines(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(25)]
    rows = []
    for i in range(30):
        own = rng.sample(lines, 4)
        changed = own[1].split()
        changed[7] = "otherword"
        rows.append((i, "\n".join([own[0], "", own[1].upper() + "!!", " ".join(changed), f"Page {i} of 99", "***", own[2]]), "s"))
    rows += [(40, None, "s"), (41, "", "s"), (42, "only here\n\n", "s"), (None, lines[0], "s"), (3, rows[3][1], "s")]
    df = table(spark, rows)
    got = line_dedup.duplicate_lines(df, carry=["name"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert len({str(r) for r in got if r.doc_id == 3}) == 1  # the same document twice
    where = defaultdict(list)  # each base line's occurrences, changed ones too, in order
    for i, t, _ in sorted((r for r in set(rows) if r[0] is not None and r[1]), key=lambda r: r[0]):
        for no, line in enumerate(t.split("\n")):
            w = line_dedup.normal_words(line)
            if w:
                key = next((k for k, x in enumerate(lines) if line_dedup.edit_similarity(x.split(), w) >= 0.8), line if "only" in line else "page")
                where[key].append((i, no))
    removed = defaultdict(list)
    for spots in where.values():
        for i, no in sorted(spots)[1:]:
            removed[i].append(no)
    for i, t, _ in rows:
        if i is not None:
            assert sorted(removed[i]) == by[i].removed and by[i].n_removed == len(by[i].removed) and by[i].n_lines == (t or "").count("\n") + 1
            assert by[i].name == "s"
    assert by[None].removed == ([0] if where[0] else [])
    assert line_dedup.drop_lines("a\nb\nc", [1]) == "a\nc"
    assert line_dedup.duplicate_lines(df.where("false")).count() == 0


def test_line_words():
    texts = ["One  two,3x\n\nthree\n", "", "\n...\n_a_b 77 Ünder", "last", "Straße ÀÉ×÷ x\xa0y\x85z 1²½ª µ 00 a\x01b\tc 2024-01", "Ünder “one” 12Œ\nστις ΣΑΣ"]
    words, sizes, owner, no = line_dedup.line_words(texts)
    want = [(i, k, line_dedup.normal_words(line)) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line_dedup.normal_words(line)]
    assert list(zip(owner.tolist(), no.tolist(), sizes.tolist(), strict=True)) == [(i, k, len(w)) for i, k, w in want]
    assert words.tolist() == blocks.hashed([x for _, _, w in want for x in w]).tolist()
    some = ["", "a", "b", "ab", "ba", "aa", "aaa", "Ünder"]
    assert len(set(blocks.hashed(some * 2).tolist())) == len(some) and (blocks.hashed(some) == blocks.hashed([x.encode() for x in some])).all()
    assert len(set(line_dedup.line_names(words, sizes).tolist())) == len({tuple(w) for _, _, w in want})
    assert [len(x) for x in line_dedup.line_words(["", "..."])] == [0, 0, 0, 0]


def test_within():
    rng = random.Random(2)
    for _ in range(800):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.randrange(5)]])
        assert line_dedup.within(np.array(a, np.int32), np.array(b, np.int32), 0.8) == (line_dedup.edit_similarity(a, b) >= 0.8 - 1e-9)


def changed_line(rng, base, words, edits):
    copy = list(base)
    for _ in range(edits):
        at = rng.randrange(len(copy))
        copy[at : at + rng.choice([0, 1, 1, 1])] = rng.choice([[rng.choice(words)], [rng.choice(words)], []])
    return copy


@pytest.mark.parametrize("others", [0, 20_000])
def test_recall_of_like_lines(spark, others):
    """Pairs with as many edits as are allowed, in a small and a large table, half of their words common ones."""
    rng = random.Random(8)
    common, rare = [f"c{chr(97 + i)}" for i in range(30)], ["".join(rng.choice("defghijk") for _ in range(6)) for _ in range(4000)]
    line = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    rows, like = [], {}
    for length in (5, 10, 20):
        for _ in range(200):
            base = line(length)
            copy = changed_line(rng, base, common + rare, length // 5)
            if copy and base != copy and line_dedup.edit_similarity(base, copy) >= 0.8:
                like[len(rows) + 1] = length
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    rows += [(100_000 + i, " ".join(line(rng.choice([5, 10, 20])))) for i in range(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id for r in line_dedup.duplicate_lines(docs).collect() if r.n_removed}
    for length in (5, 10, 20):
        mine = [i for i, n in like.items() if n == length]
        assert len(mine) > 100 and sum(i in out for i in mine) >= 0.9 * len(mine)
    # What goes is like another line.
    texts = dict(rows)
    for i in sorted(out):
        assert any(line_dedup.edit_similarity(texts[i].split(), t.split()) >= 0.8 for k, t in rows if k != i and abs(len(t) - len(texts[i])) < 40)


def test_very_long_text(spark):
    """A text with more than 2^20 different lines, and one line of many words twice."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    copy = list(base)
    copy[50], copy[150_000] = "other", "another"
    many = "\n".join(f"x{'abcdefghij'[i % 10]}{i:x}" for i in range((1 << 20) + 5)) + "\nalpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, many, "n"), (2, "Alpha beta gamma delta epsilon zeta eta theta iota lambda", "n"), (3, " ".join(base), "n"), (4, " ".join(copy), "n")]
    got = {r.doc_id: r for r in line_dedup.duplicate_lines(table(spark, rows)).collect()}
    assert got[1].n_lines == (1 << 20) + 6 and [got[i].removed for i in (2, 3, 4)] == [[0], [], [0]]


def test_hot_blocks_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SAMPLED", 1)
    monkeypatch.setattr(blocks, "SALTS", 4)
    rng = random.Random(5)
    base = [f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(100)]
    rows = []
    for i in range(300):  # like copies of one line, in which all blocks are hot
        copy = list(base)
        copy[rng.randrange(100)] = f"other{'xyz'[i % 3] * (i // 3 + 1)}"
        rows.append((i, " ".join(copy)))
    seen = []
    pairs = blocks.hub_pairs
    monkeypatch.setattr(line_dedup, "hub_pairs", lambda *a: seen.append(pairs(*a)) or seen[-1])
    out = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(r.n_removed for r in out) == 299
    assert len({x for r in seen[0].collect() for x in (r.a, r.b)}) == 300


def test_carried_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 7), (2, "A b c d e F", 6, 8)], "doc_id long, text string, mark int, node int")
    got = sorted(map(tuple, line_dedup.duplicate_lines(df, carry=["mark", "node"]).select("doc_id", "n_removed", "mark", "node").collect()))
    assert got == [(1, 0, 5, 7), (2, 1, 6, 8)]
    with pytest.raises(ValueError):
        line_dedup.duplicate_lines(df.withColumnRenamed("mark", "removed"), carry=["removed"])


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_shingle_sets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("aBcd") for _ in range(n)) for n in (0, 1, 4, 5, 6, 40, 300, 0, 3)]
    hashes, sizes = simhash_dedup.shingle_hashes([t.encode() for t in texts], 5)
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    at, seen = 0, {}
    for t, n in zip(texts, sizes, strict=True):
        alone = simhash_dedup.shingle_hashes([t.encode()], 5)[0]
        assert alone.tolist() == hashes[at : at + n].tolist() == sorted(set(alone.tolist()))
        at += n


def test_near_copies_are_those_of_the_similarity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for _ in range(100):  # pairs around the limit
        base = text(rng.choice([12, 60, 120]))
        copy = base[: int(len(base) * rng.uniform(0.75, 1))] if rng.random() < 0.5 else base + text(rng.randint(0, len(base) // 3))
        rows += [" ".join(base), " ".join(copy)]
    boiler = " ".join(text(12))  # the same few shingles many times, and different ones
    rows += [" ".join([boiler] * 60 + text(200)) for _ in range(4)]
    sets = [shingles(t) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = union(pairs, range(len(rows)))
    assert 20 < len(pairs) < 90
    kept = {r.doc_id for r in simhash_dedup.drop_near_copies(table(spark, [(i, t, "x") for i, t in enumerate(rows)])).collect()}
    want = {i for i in range(len(rows)) if root[i] == i}
    # No document goes that is like no other; of the pairs on the limit few are missed.
    assert want <= kept and len(kept - want) <= 0.05 * len(pairs)


def copies_at(rng, words, similarity, shingle=5):
    """A text and one whose shingle set has about this similarity with its own, by replaced words far apart."""
    base = [rng.choice(words) for _ in range(300)]
    copy, changes = list(base), round(296 * (1 - similarity) / (1 + similarity) / shingle)
    for i in range(changes):
        copy[(i * 2 + 1) * 300 // (2 * changes)] = f"changed{rng.random()}"
    return " ".join(base), " ".join(copy)


@pytest.mark.parametrize("similarity", [0.82, 0.85, 0.9])
@pytest.mark.parametrize("others", [0, 6000])
def test_recall_of_near_copies_in_small_and_large_tables(spark, similarity, others):
    rng = random.Random(int(similarity * 100))
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    pairs = [copies_at(rng, words, similarity) for _ in range(150)]
    sets = [[shingles(t) for t in p] for p in pairs]
    like = [len(a & b) / len(a | b) >= 0.8 for a, b in sets]
    boiler = [rng.choice(words) for _ in range(60)]  # a third of each other text
    rows = [(2 * i + k, t, "x") for i, p in enumerate(pairs) for k, t in enumerate(p)]
    rows += [(10_000 + i, " ".join(boiler + [rng.choice(words) for _ in range(120)]), "x") for i in range(others)]
    kept = {r.doc_id for r in simhash_dedup.drop_near_copies(table(spark, rows)).select("doc_id").collect()}
    found = sum(2 * i + 1 not in kept for i, yes in enumerate(like) if yes)
    assert sum(like) > 100 and found >= 0.95 * sum(like)
    assert len([i for i in kept if i >= 10_000]) == others


def test_common_words_are_counted_as_often_as_they_stand():
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 6, rng.integers(0, 12)).astype(np.uint32) for _ in range(400)]
    a, b = lines[:200], lines[200:]
    column = pa.array([x.tobytes() for x in lines], pa.binary()).slice(200)
    words, sizes = line_dedup.packed_words(column)
    assert words.tolist() == np.concatenate(b).tolist() and sizes.tolist() == [len(x) for x in b]
    of = lambda rows: (np.concatenate(rows), np.array([len(x) for x in rows]))
    got = line_dedup.enough_in_common(*of(a), *of(b), 0.8)
    for x, y, enough in zip(a, b, got, strict=True):
        more, less = Counter(x.tolist()) - Counter(y.tolist()), Counter(y.tolist()) - Counter(x.tolist())
        allowed = int(max(len(x), len(y)) * 0.2 + 1e-9)
        assert enough == (max(more.total(), less.total()) <= allowed)
        assert enough or line_dedup.edit_distance(x, y) > allowed
    none = np.empty(0, np.uint32)
    assert line_dedup.enough_in_common(none, np.zeros(1, int), none, np.zeros(1, int), 0.8).tolist() == [True]


def test_hubs_go_on_from_batch_to_batch():
    """A block over many batches, with repeated rows, gives the pairs that it gives in one."""
    rows = sorted({(k // 7, k % 40) for k in range(120)}) + [(99, 5), (99, 5), (99, 8)]
    table = pa.table({"node": [n for _, n in rows], "size": [10] * len(rows), "sign": [0] * len(rows), "block": [b for b, _ in rows]})
    work = blocks._beside_hubs(["sign"], 0.8, 3)
    found = lambda size: {tuple(r.values()) for x in work(iter(table.to_batches(size))) for r in x.to_pylist()}
    want = set()
    for block in {b for b, _ in rows}:
        nodes = sorted({n for b, n in rows if b == block})
        want |= {(h, n) for h in nodes[:2] for n in nodes if h < n}
    assert found(1000) == want and all(found(size) == want for size in (1, 2, 3, 50))


def test_cells_come_in_turns(spark, monkeypatch):
    """What is dealt at once is bounded by the nodes, however many sides meet; each pair comes once."""
    monkeypatch.setattr(blocks, "CELL_ROWS", 16)
    monkeypatch.setattr(blocks, "TURN_ROWS", 100)
    folder, dealt = scratch_path(spark, "crowded"), []
    monkeypatch.setattr(blocks, "_in_cells", lambda *a, work=blocks._in_cells: (dealt.append(1), work(*a))[1])
    spark.createDataFrame([(k, n, True) for k in (1, 2) for n in range(90)], "a long, b long, crowded boolean").write.partitionBy("crowded").parquet(folder)
    sets = pin(spark.createDataFrame([(n, 10, n % 5 << 20) for n in range(90)], "node long, size int, sign long"))
    roots = spark.createDataFrame([], "node long, root long")
    more = [(r.a, r.b) for r in blocks.rest_pairs(folder, sets, roots, ["sign"], 0.8, 0).collect()]
    assert sorted(more) == [(a, b) for a in range(90) for b in range(a + 1, 90) if a % 5 == b % 5]
    assert len(dealt) == 11  # six sides meet each other in either block: 1,080 rows


@pytest.mark.parametrize("cell_rows", [16, 8192])
@pytest.mark.parametrize("sampled", [1, 32])
def test_rows_of_a_crowded_block_all_meet(spark, monkeypatch, cell_rows, sampled):
    """Pairs of a block that are like none of its hubs, in hot blocks and others, and no pair of one group."""
    monkeypatch.setattr(blocks, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(blocks, "SAMPLED", sampled)
    rng = random.Random(4)
    signs = [rng.getrandbits(63) for _ in range(40)]
    # Every node has one of forty far signs, a bit or two changed; blocks of 3, 11 and 186 nodes.
    rows = [(n, 10 + n % 4, signs[n % 40] ^ (1 << rng.randrange(60)), [7 if n > 13 else 8 if n > 2 else 9]) for n in range(200)]
    rows += rows[:50]
    sets = pin(spark.createDataFrame(rows, "node long, size int, sign long, keys array<long>").repartition(3))
    crowd = scratch_path(spark, "crowded")
    found = {(r.a, r.b) for r in blocks.hub_pairs(sets, ["sign"], 0.8, 4, [], 2, crowd).collect()}
    roots = spark.createDataFrame([(n, n % 40) for n in (45, 85, 125)], "node long, root long")
    more = [(r.a, r.b) for r in blocks.rest_pairs(crowd, sets, roots, ["sign"], 0.8, 4).collect()]
    one = {n: r for n, *r in rows}
    like = {
        (a, b) for a in range(200) for b in range(a + 1, 200)
        if one[a][2] == one[b][2] and min(one[a][0], one[b][0]) >= 0.8 * max(one[a][0], one[b][0]) and bin(one[a][1] ^ one[b][1]).count("1") <= 4
    }
    assert len(like - found) > 200 and len(more) == len(set(more))
    assert set(more) | found == like - ({(45, 85), (45, 125), (85, 125)} - found)


def test_lines_that_are_like_no_hub_of_their_block(spark, monkeypatch):
    plain = line_dedup.signed_lines
    monkeypatch.setattr(line_dedup, "signed_lines", lambda *a: plain(*a).withColumn("keys", F.array(F.lit(1).cast("long"))))
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(10)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:9], "other"]))]
    out = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {i: i % 2 for i in range(120)}


def test_documents_that_are_like_no_hub_of_their_block(spark, monkeypatch):
    plain = simhash_dedup.signed
    monkeypatch.setattr(simhash_dedup, "signed", lambda *a: plain(*a).withColumn("keys", F.array(F.lit(1).cast("long"))))
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    rows = [(2 * i + k, t, "x") for i in range(30) for k, t in enumerate(copies_at(rng, words, 0.9))]
    kept = {r.doc_id for r in simhash_dedup.drop_near_copies(table(spark, rows)).collect()}
    assert kept == {2 * i for i in range(30)}


@pytest.mark.parametrize("meet", [2, 64])
def test_documents_that_share_no_block_are_found(spark, monkeypatch, meet):
    """All pairs of the similarity are linked, though no two sets have a block in common; boilerplate makes shingles common."""
    plain = simhash_dedup.signed
    monkeypatch.setattr(simhash_dedup, "signed", lambda *a: plain(*a).withColumn("keys", F.array("node")))
    monkeypatch.setattr(simhash_dedup, "SAMPLED", 2)
    monkeypatch.setattr(simhash_dedup, "MEET", meet)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    boiler = [rng.choice(words) for _ in range(40)]
    texts = [t for s in (0.72, 0.78, 0.8, 0.8, 0.82, 0.85, 0.9) for _ in range(8) for t in copies_at(rng, words, s)]
    texts += [" ".join(boiler + [rng.choice(words) for _ in range(n)]) for n in (0, 3, 7, 8, 9, 10, 20, 40) for _ in range(5)]
    texts += ["one two", "one two", "", "one two three"]
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = union(pairs, range(len(texts)))
    kept = {r.doc_id for r in simhash_dedup.drop_near_copies(table(spark, [(i, t, "x") for i, t in enumerate(texts)])).collect()}
    assert kept == {i for i in range(len(texts)) if root[i] == i} and 40 < len(pairs)


def test_sketches_drop_no_pair_of_the_similarity():
    rng, judge = np.random.default_rng(2), simhash_dedup.SketchJudge(0.8)
    far = 0
    for n in rng.integers(1, 700, 400).tolist():
        base = rng.integers(0, 1 << 63, n * 2).astype(np.uint64)
        for low in (int(n * 0.8 + 0.99), n // 2):
            one, two = np.unique(base[:n]), np.unique(np.concatenate([base[:low], base[n : n + int(low / 0.8) - n if low / 0.8 > n else n]]))
            p, q = simhash_dedup.sketches(np.concatenate([one, two]), np.array([len(one), len(two)]))
            common = len(np.intersect1d(one, two))
            if common >= 0.8 * (len(one) + len(two) - common):
                assert judge.alike([p, q], [q, p]).tolist() == [True, True]
            far += not judge.near(p, q)
    assert far > 200


def test_shared_shingles_go_on_from_batch_to_batch(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "MEET", 4)
    rng = random.Random(5)
    rows = sorted({(rng.randrange(30), n % 9, n) for n in range(60) for _ in range(3)} | {(50, n % 2, n) for n in range(40)} | {(60, 1, n) for n in range(40)})
    table = pa.table({"block": [r[0] for r in rows], "root": [r[1] for r in rows], "node": [r[2] for r in rows], "size": [10] * len(rows), "pos": [0] * len(rows)})

    def found(size, held):
        monkeypatch.setattr(simhash_dedup, "HELD", held)
        return {tuple(r.values()) for x in simhash_dedup._in_shared_shingles(0.8)(iter(table.to_batches(size))) for r in x.to_pylist()}

    want, crowd, of = set(), set(), defaultdict(list)
    for b, r, n in rows:
        of[b].append((r, n))
    for b, members in of.items():
        if len({r for r, _ in members}) > 1 and len(members) > 4:
            crowd |= {(b, n, True) for _, n in members}
        elif len(members) <= 4:
            want |= {(min(m, n), max(m, n), False) for r, m in members for s, n in members if r != s}
    assert crowd and want and all(found(size, 1000) == want | crowd for size in (1, 7, 1000))
    # A long block goes on to the cells, whether or not it has several groups.
    assert found(7, 12) - {(60, n, True) for n in range(40)} == want | crowd


def test_masks_drop_no_pair_of_the_similarity():
    rng = np.random.default_rng(9)
    lines = []
    for _ in range(300):
        base = rng.integers(0, 90, rng.integers(5, 60)).tolist()
        copy = changed_line(random.Random(len(lines)), base, range(90), len(base) // 5)
        lines += [base, copy]
    mask = lambda x: np.bitwise_or.reduce(np.uint64(1) << (blocks.mixed(np.array(x, np.uint64)) >> np.uint64(58)))
    side = lambda rows: {"size": np.array([len(x) for x in rows]), "bits": np.array([mask(x) for x in rows]).view(np.int64), "sign": np.zeros(len(rows), np.int64)}
    fit = blocks._may_be_alike(side(lines[::2]), side(lines[1::2]), ["sign"], 0.8, 0, ["bits"])
    like = [line_dedup.edit_similarity(a, b) >= 0.8 - 1e-9 for a, b in zip(lines[::2], lines[1::2], strict=True)]
    assert sum(like) > 200 and all(f for f, yes in zip(fit, like, strict=True) if yes)
    far = blocks._may_be_alike(side(lines[::2][:-1]), side(lines[2::2]), ["sign"], 0.8, 0, ["bits"])
    assert far.mean() < 0.1


def test_line_dedup_gives_shuffle_files_back_with_each_write(spark, monkeypatch):
    from burstselect.llm import line_dedup
    from burstselect.session import SHUFFLE_CLEANUP

    seen, write = [], line_dedup.pin
    monkeypatch.setattr(line_dedup, "pin", lambda df: (seen.append(spark.conf.get(SHUFFLE_CLEANUP)), write(df))[1])
    before = spark.conf.get(SHUFFLE_CLEANUP)
    docs = spark.createDataFrame([(1, "one two three\nfour five"), (2, "one two three"), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: list(r.removed) for r in line_dedup.duplicate_lines(docs).collect()} == {1: [], 2: [0], 3: []}
    assert len(seen) >= 4 and set(seen) == {"true"} and spark.conf.get(SHUFFLE_CLEANUP) == before


def test_tables_that_are_done_with_are_deleted(spark):
    from burstselect.session import unpin

    rows = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    one, two = pin(rows), pin(rows)
    folder = one.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    unpin(one)
    assert not os.path.exists(folder) and two.count() == 2
    other = scratch_path(spark, "mine")
    rows.write.parquet(other)
    with pytest.raises(ValueError):
        unpin(spark.read.parquet(other))
    assert spark.read.parquet(other).count() == 2


def test_crowded_lines_leave_no_contents_behind(spark, monkeypatch):
    """Tables with the words of lines that meet again, and with their blocks, are gone when the groups are known."""
    plain = line_dedup.signed_lines
    monkeypatch.setattr(line_dedup, "signed_lines", lambda *a: plain(*a).withColumn("keys", F.array(F.lit(1).cast("long"))))
    made = []
    for module in (blocks, line_dedup):
        monkeypatch.setattr(module, "pin", lambda df: (made.append(pin(df)), made[-1])[1])
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    lines = [[rng.choice(words) for _ in range(10)] for _ in range(30)]
    rows = [(2 * i + k, " ".join([*x[:9], "other"] if k else x)) for i, x in enumerate(lines) for k in (0, 1)]
    out = line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {i: i % 2 for i in range(60)}
    there = [t.columns for t in made if all(os.path.exists(f.removeprefix("file://")) for f in t._jdf.inputFiles())]
    assert len([c for c in there if "words" in c]) == 1 and not any("content" in c or "keys" in c for c in there)


def test_words_of_lines_as_numbers_and_as_bytes(spark):
    docs = spark.createDataFrame([(1, "one two three four five\nsix\n\nseven eight nine ten eleven twelve", 0)], "doc_id long, text string, mark long")
    known = line_dedup.hashed_lines(docs, 0.8).where("words is not null")
    rows = {r.node: r.words for r in known.collect()}
    assert sorted(map(len, rows.values())) == [5, 6]
    contents = {r.node: np.frombuffer(bytes(r.content), np.int32).tolist() for r in line_dedup.line_contents(known).collect()}
    assert contents == rows
