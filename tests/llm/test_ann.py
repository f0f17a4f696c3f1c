from __future__ import annotations

import math
import random

import pytest

from burstselect.llm import ann


def brute(rows, every, k):
    ok = [(i, n, v) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for qi, qn, qv in ok:
        if qi is None or qi % every:
            continue
        scored = []
        for ci, cn, cv in ok:
            if cn != qn and len(cv) == len(qv):
                s = 0.0
                for a, b in zip(qv, cv, strict=True):
                    s += a * b
                scored.append((-s, ci is None, ci or 0, ci))
        out += [(qi, r + 1, c[3], -c[0]) for r, c in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block_rows", [3, 50, 4096])
def test_equals_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, 1), 1e-3, 100.0]) for _ in range(rng.choice([8, 8, 8, 5]))]) for i in range(160)]
    rows += [(200 + i, list(rows[0][1])) for i in range(40)] + [(0, list(rows[0][1])), (None, list(rows[0][1])), (None, None)]
    rows += [(300, [0.0] * 8), (301, []), (302, [None] * 8), (303, [float("nan")] + [1.0] * 7), (310, [float("inf")] * 8), (311, [1e300, 1e-300] * 4), (320, None)]
    df = spark.createDataFrame([(i, v, "x", i) for i, v in rows], "vec_id long, embedding array<double>, block string, ids long")
    got = [tuple(r) for r in ann.nearest(df.repartition(3), 10, k=7, block_rows=block_rows).collect()]
    assert sorted(got) == sorted(brute(rows, 10, 7))


@pytest.mark.parametrize("cell_bytes", [1, 5_000])
def test_cells_hold_few_bytes(spark, cell_bytes):
    """One block a cell, and a few."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in ann.nearest(df, 20, k=5, block_rows=20, cell_bytes=cell_bytes).collect()]
    assert sorted(got) == sorted(brute(rows, 20, 5))


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(one, 20).count() == 0
    assert ann.nearest(one.where("false"), 20).count() == 0
