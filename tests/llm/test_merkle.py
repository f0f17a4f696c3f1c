from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from burstselect.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def proof(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, bool(i & 1)))
        i >>= 1
    return out


def fold(digest, siblings):
    for s, before in siblings:
        digest = h(s + digest if before else digest + s) if s else h(digest)
    return digest


def encoded(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def whole(rows, part, key):
    """{leaf number in sorted order: (subroot, root, siblings)} by brute force; rows are sorted and have their leaf last."""
    parts = {}
    for r in rows:
        parts.setdefault(r[part], []).append(r)
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: levels([r[-1] for r in sorted(parts[p], key=key)]) for p in names}
    top = levels([trees[p][-1][0] for p in names])
    out = []
    for k, p in enumerate(names):
        for i, r in enumerate(sorted(parts[p], key=key)):
            out.append((r, trees[p][-1][0], top[-1][0], proof(trees[p], i) + proof(top, k)))
    return out


@pytest.mark.parametrize(("bits", "sizes"), [(8, [1]), (8, [1, 2, 40]), (2, [7]), (3, [0, 9, 64, 65])])
def test_proofs_equal_brute_force(spark, monkeypatch, bits, sizes):
    monkeypatch.setattr(merkle, "LEVELS", bits)
    rows = [(i, None if p == 0 and len(sizes) > 1 else f"p{p}", "x", h(f"{p}.{i}")) for p, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, part string, root_name string, leaf string").repartition(3)
    made = merkle.manifest(df, "part", ["k"])
    got = {r.leaf: r for r in merkle.proofs(made).collect()}
    want = whole(rows, 1, lambda r: r[0])
    assert len(got) == len(want)
    for r, subroot, root, siblings in want:
        row = got[r[3]]
        assert (row.subroot, row.root, [tuple(s) for s in row.siblings]) == (subroot, root, siblings)
        assert (row.k, row.part) == r[:2]
    assert made.root == want[0][2]
    some = merkle.proofs(made, made.leaves.where("k % 5 = 0")).withColumn("back", merkle.folded("leaf", "siblings")).collect()
    assert len(some) == sum(r[0] % 5 == 0 for r in rows) and all(r.back == r.root for r in some)


def test_repeated_rows_nulls_and_order_of_storage(spark):
    rows = [(None, None, h("a"))] * 5 + [(None, "x", h("b"))] + [(1, "x", h("c"))] * 600 + [(1, "x", h("d"))]
    made = [merkle.manifest(spark.createDataFrame(rows, "k long, part string, leaf string").repartition(n), "part", ["k"]) for n in (1, 7)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    want = whole(rows, 1, key)
    assert made[0].root == made[1].root == want[0][2]
    got = sorted((r.leaf, str([tuple(s) for s in r.siblings])) for r in merkle.proofs(made[1]).collect())
    assert got == sorted((r[2], str(s)) for r, _, _, s in want)
    # Equal subtrees are stored once: 600 equal leaves need few records.
    assert made[0].store.agg(F.sum(F.size("records"))).first()[0] < 100


def test_empty_and_taken_names(spark):
    df = spark.createDataFrame([(1, "x", h("a"))], "k long, part string, leaf string")
    empty = merkle.manifest(df.where("1 = 0"), "part", ["k"])
    assert empty.root is None and merkle.proofs(empty).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(df.withColumnRenamed("k", "place"), "part", ["place"])


def test_query(spark, tmp_path):
    rows = [(i, f"text {i % 50} é", None if i % 11 == 0 else ["en", "de", "zu"][i % 3], None if i % 7 == 0 else "src", None if i % 5 == 0 else i * 3) for i in range(700)]
    rows += [(900, None, "en", "s", 4), (901, "", "one", "s", 0), (902, "w " * 50_000, "en", "s", 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_merkle(spark, str(tmp_path)).collect()}
    leaves = [(*r, encoded(r[0], r[3], r[2], r[4], r[1])) for r in rows]
    seen = set()
    for r, subroot, root, siblings in whole(leaves, 2, lambda r: r[0]):
        touched = zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        start = encoded(r[0], r[3], r[2], r[4] + 1, r[1]) if touched else r[-1]
        back = fold(start, siblings)
        row = got[r[0]]
        assert (row.leaf, row.subroot, row.root, row.proof_sha256) == (r[-1], subroot, root, h("".join(s for s, _ in siblings if s)))
        assert (row.folded_root, row.verified) == (back, back == root) and row.verified != touched
        seen.add(touched)
    assert len(got) == len(rows) and seen == {True, False}
