from __future__ import annotations

import random
import re

import pytest
from conftest import frame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstselect.operators.grouping import similarity_bursts, time_bursts
from burstselect.operators.verdicts import gates, verdicts
from burstselect.params import SelectionParams
from burstselect.plans import ordered
from burstselect.plans.ordered import SPANS, chron, lay_out, ranked


def walk(rows, starts):
    """Burst ids by walking the frames in order."""
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]) if r[1] else (True, 0, r[0]))
    out, burst, prev = {}, 0, None
    for r in rows:
        if prev is not None and starts(prev, r):
            burst += 1
        out[r[0]] = burst
        prev = r
    return out


def random_frames(seed, n=300, step=3.0):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice([0.0, 0.5, 1.0, 2.0, step])
        rows.append(
            frame(
                f"f{rng.randint(0, 9)}/{i:04d}.jpg", None if rng.random() < 0.05 else at, phash=rng.choice([0, 1, 3, -1, -8]),
                faces=rng.randint(0, 3), eye=rng.choice([None, 0.0, 0.4, 0.5, 1.0]), sharp=rng.choice([1, 10, 60, 100, 300]),
                exposed=rng.random() < 0.3,
            )
        )
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_time_bursts_equal_a_walk(frames, seed):
    rows = random_frames(seed)
    want = walk(rows, lambda p, r: r[1] is None or p[1] is None or (r[1] - p[1]).total_seconds() > 2.0)
    assert {r.rel: r.burst_id for r in time_bursts(frames(rows)).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_bursts_equal_a_walk(frames, seed):
    rows = random_frames(seed)
    far = lambda p, r: bin((p[2] ^ r[2]) & (2**64 - 1)).count("1") > 1
    late = lambda p, r: bool(p[1] and r[1]) and (r[1] - p[1]).total_seconds() > 2.5
    got = similarity_bursts(frames(rows), SelectionParams(sim_max_distance=1, sim_time_ceiling=2.5)).collect()
    assert {r.rel: r.burst_id for r in got} == walk(rows, lambda p, r: far(p, r) or late(p, r))


@pytest.mark.parametrize("chunk_rows", [1000, 100, 20])
def test_result_does_not_depend_on_the_number_of_chunks(frames, monkeypatch, chunk_rows):
    rows = random_frames(5, step=30.0)
    pick = ("rel", "burst_id", "bin", "reason", "rank_in_burst")
    want = sorted(map(tuple, verdicts(time_bursts(frames(rows))).select(*pick).collect()))
    monkeypatch.setattr(ordered, "CHUNK_ROWS", chunk_rows)
    assert sorted(map(tuple, verdicts(time_bursts(frames(rows))).select(*pick).collect())) == want


def test_ranked_equals_row_number(spark):
    rng = random.Random(3)
    # One group holds most of the rows and so reaches over every chunk.
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", "z"]), rng.randint(0, 20), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    order = [F.col("v").desc(), F.col("i").asc()]
    want = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(*order)) - 1)
    ascending = [-F.col("v"), F.col("i")]
    got = ranked(df, ["g"], ascending, "r")
    key = lambda d: sorted((x.i, x.r) for x in d.collect())
    assert key(got) == key(want)
    everything = ranked(df, [], [F.col("g"), *ascending], "r")
    assert sorted(x.r for x in everything.collect()) == list(range(400))


def test_hot_burst_is_split_over_chunks(frames):
    rows = [frame(f"{i:04d}.jpg", i * 0.01, sharp=i % 37 + 1) for i in range(300)] + [frame("z.jpg", 900.0, sharp=5)]
    rows += [frame(f"y{i:04d}.jpg", 1000.0 + 10 * i, sharp=1) for i in range(600)]
    grouped = time_bursts(frames(rows))
    assert grouped.where(SPANS).select("_chunk").distinct().count() >= 3
    judged = verdicts(grouped).where("burst_id = 0").orderBy("rank_in_burst").collect()
    assert [r.rank_in_burst for r in judged] == list(range(300))
    assert [r.sharpness for r in judged] == sorted((r[5] for r in rows[:300]), reverse=True)
    assert [r.bin for r in judged].count("keeper") == 1


def test_lay_out_of_given_bursts(frames):
    rows = [frame(f"{i:03d}.jpg", i, sharp=i) for i in range(400)]
    given = frames(rows).withColumn("burst_id", F.when(F.col("rel") < "350.jpg", 7).otherwise(9).cast("bigint"))
    laid = lay_out(given)
    assert laid.select("rel", "burst_id").orderBy(*[F.col("rel")]).collect()[0].burst_id == 7
    assert laid.where("burst_id = 7 and not _spans").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_of_frames_and_no_job_but_the_sample(spark, frames, tmp_path):
    """Frames are shuffled once, by chunk; only tables of one row per chunk are gathered in one partition."""
    frames(random_frames(9)).write.parquet(str(tmp_path / "frames"))
    table = spark.read.parquet(str(tmp_path / "frames"))
    spark.sparkContext.setJobGroup("plan", "plan")
    judged = verdicts(time_bursts(table))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("rest", "rest")
    plan = plan_of(judged)
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "SinglePartition" in line and "REPARTITION_BY_NUM" not in line:  # a layout of one chunk has few rows
            below = "\n".join(lines[i + 1 : i + 8])
            assert re.search(r"Aggregate\(keys?=\[_chunk|Window \[sum\(_tail", below), below
        if "Exchange hashpartitioning" in line:
            # By chunk edge or by split burst, after partial sums.
            below = "\n".join(lines[i + 1 : i + 3])
            assert "Aggregate(" in below or "Window" in lines[i - 2], below
    assert "rangepartitioning" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Two layouts: all frames, and those of split bursts; a count and a sample of keys for each (a count is two jobs).
    assert len(jobs) <= 12


def test_chron_order(frames):
    rows = [frame("b.jpg", 1), frame("a.jpg", 1), frame("u.jpg", None), frame("t.jpg", None), frame("c.jpg", 0)]
    assert [r.rel for r in frames(rows).orderBy(*chron()).collect()] == ["c.jpg", "a.jpg", "b.jpg", "t.jpg", "u.jpg"]


@pytest.mark.parametrize("depth", [8, 3])
def test_chunks_by_conditions_and_halving(spark, monkeypatch, depth):
    """Rows are dealt by ascending bounds, whether the tree of conditions settles all of them or an array is halved below it."""
    monkeypatch.setattr(ordered, "TREE_DEPTH", depth)
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 20)
    rows = [(None if i % 11 == 0 else i * 7919 % 500, f"it's \\{i:04d}") for i in range(1500)]
    laid = ordered.into_chunks(spark.createDataFrame(rows, "v int, s string"), [F.col("v").isNull(), F.col("v"), F.col("s")])
    assert laid.schema[ordered.CHUNK].nullable
    chunk = {r.s: r[ordered.CHUNK] for r in laid.collect()}
    in_order = [chunk[s] for v, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    assert in_order == sorted(in_order) and len(set(in_order)) > 50 and len(chunk) == 1500


def test_what_lies_behind_a_layout_runs_once(spark, frames):
    """Frames come out of a function that counts its calls: grouping, verdicts and documents of a burst over all chunks call it once for each."""
    from burstselect.operators.results import frame_documents
    from burstselect.operators.review import frame_step

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def sharpness(x):
        calls.add(1)
        return x

    rows = [frame(f"{i:04d}.jpg", i * 0.01, sharp=i % 37 + 1) for i in range(400)]
    judged = verdicts(time_bursts(frames(rows).withColumn("sharpness", sharpness("sharpness"))))
    assert frame_step(frame_documents(judged)).count() == 400
    assert calls.value == 400


def test_many_chunks_are_spark_ranges(spark, frames, monkeypatch):
    """With more chunks than conditions tell apart no plan has a condition for each of them; verdicts and ranks are those of few chunks."""
    rows = random_frames(11, step=30.0)
    pick = ("rel", "burst_id", "bin", "reason", "rank_in_burst")
    want = sorted(map(tuple, verdicts(time_bursts(frames(rows))).select(*pick).collect()))
    marks = spark.createDataFrame([(None if i % 3 == 0 else "hot" if i % 7 else f"g{i}", i) for i in range(900)], "g string, i int")
    place = lambda: sorted((r.i, r.at) for r in ranked(marks, ["g"], [-F.col("i")], "at").collect())
    placed = place()
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 12)
    laid = ordered.into_chunks(frames(rows), chron())
    assert laid.select("_chunk").distinct().count() > 2**ordered.TREE_DEPTH
    assert plan_of(laid).count("CASE WHEN") == 0
    assert sorted(map(tuple, verdicts(time_bursts(frames(rows))).select(*pick).collect())) == want
    assert place() == placed


def test_split_bursts_of_many_chunks_pass_no_window(frames, monkeypatch):
    """A burst over all of many chunks gets its aggregates without a window over its rows, and the same ranks."""
    rows = [frame(f"{i:04d}.jpg", i * 0.01, faces=i % 4, eye=i % 3 / 2, sharp=i * 7 % 41 + 1) for i in range(300)]
    rows += [frame(f"u{i}.jpg", None, sharp=i) for i in range(20)]
    pick = ("rel", "burst_id", "bin", "reason", "rank_in_burst")
    want = sorted(map(tuple, verdicts(time_bursts(frames(rows))).select(*pick).collect()))
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 12)
    bursts = time_bursts(frames(rows))
    split = ordered.parts(gates(bursts))[1]
    assert split.count() >= 300 and "Window [" not in plan_of(split)
    assert sorted(map(tuple, verdicts(bursts).select(*pick).collect())) == want


def test_ranked_in_few_equals_row_number(spark):
    rows = [(None if i % 5 == 0 else i % 2, i * 7919 % 13, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v int, i int")
    want = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("v", "i")) - 1)
    got = ordered.ranked_in_few(df, ["g"], [F.col("v"), F.col("i")], "r", 500)
    key = lambda d: sorted((x.i, x.r) for x in d.collect())
    assert key(got) == key(want) and got.columns == ["g", "v", "i", "r"]


def test_median_boxes_of_split_bursts_deal_each_value_once(frames, monkeypatch):
    """Boxes that come again are counted, not dealt one by one, and the medians are those of all boxes."""
    from burstselect.operators import region

    rows = [frame(f"{i:04d}.jpg", i * 0.01) for i in range(400)]
    box = F.when(F.col("rel") != "0007.jpg", F.struct(*[(F.substring("rel", 4, 1).cast("int") % 4 / (k + 1)).alias(a) for k, a in enumerate("xywh")]))
    dealt, into = [], ordered.into_chunks
    monkeypatch.setattr(region, "into_chunks", lambda df, *more: dealt.append(df.count()) or into(df, *more))
    got = region.locked_region(time_bursts(frames(rows)).withColumn("primary_box", box)).collect()
    # Last digits 0 to 9 make 0, 1, 2, 3, 0, 1, 2, 3, 0, 1; the frame left out has a 3.
    values = sorted(i % 10 % 4 for i in range(400) if i != 7)
    assert [tuple(r.region) for r in got] == [tuple(values[199] / (k + 1) for k in range(4))]
    assert dealt == [16]
