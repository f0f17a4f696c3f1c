from __future__ import annotations

import os
import time
import uuid

import numpy as np
import pandas as pd
from conftest import FRAME_SCHEMA, frame
from pyspark.sql import functions as F

from burstselect.operators import cache
from burstselect.params import SelectionParams
from burstselect.sources import photos
from burstselect.streaming import live

PARAMS = SelectionParams(gap_seconds=10.0)


def test_progress_state_over_files(spark, tmp_path):
    line = lambda d, n: '{"done": %d, "total": 9, "current_frame_name": "%s", "current_burst_label": ""}' % (d, n)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join([line(1, "a"), "noise", line(2, "b")]))
    (tmp_path / "in" / "2.txt").write_text("\n".join([line(5, "z"), line(4, "y")]))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumn("run", F.lit("r1"))
    out = str(tmp_path / "out")
    live.run_available(live.progress_state(lines), "complete", live.replace_at(out))
    row = live.read_batches(spark, out, newest_only=True).first()
    assert (row.done, row.total, row.current_frame_name, row.events) == (5, 9, "z", 4)


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, FRAME_SCHEMA).withColumn("source", F.lit("cam")).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/b{i}")
    schema = spark.read.parquet(f"{folder}/b0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_live_bursts_equal_the_batch_once_closed(spark, tmp_path):
    first = [frame("a", 0, sharp=5), frame("b", 8, sharp=9), frame("n", None), frame("c", 100, sharp=1)]
    second = [frame("d", 105, sharp=2), frame("e", 4000, sharp=3)]
    frames = stream(spark, tmp_path / "in", [first, second])
    out = str(tmp_path / "out")
    live.run_available(live.live_time_bursts(frames, PARAMS, "source", "1 minute"), "append", live.append_to(out))
    emitted = live.read_batches(spark, out)
    # The undated frame is a burst of its own and comes out at once.
    assert sorted((r.frames, r.candidate, r.peak) for r in emitted.collect()) == [(1, "n", 0.0), (2, "b", 9.0), (2, "d", 2.0)]
    table = spark.createDataFrame(first + second, FRAME_SCHEMA).withColumn("source", F.lit("cam"))
    # What is left for the batch: the burst that is still open.
    assert [r.candidate for r in live.reconcile(table, emitted, PARAMS, "source").collect()] == ["e"]
    all_of = lambda df: sorted((r.candidate, r.frames) for r in df.collect())
    assert all_of(live.settled(table, emitted, PARAMS, "source")) == all_of(live.batch_time_bursts(table, PARAMS, "source"))
    # A late frame joins two emitted bursts: both are withdrawn.
    late = table.unionByName(spark.createDataFrame([frame("x", 96, sharp=70), frame("y", 1, sharp=1)], FRAME_SCHEMA).withColumn("source", F.lit("cam")))
    done = live.settled(late, emitted, PARAMS, "source")
    assert all_of(done) == [("b", 3), ("e", 1), ("n", 1), ("x", 3)]


def test_emitted_and_open_bursts_are_the_batch(spark, tmp_path):
    """Without a look at the whole table: files out of order within the delay, a frame that joins two open bursts, quiet sources."""
    files = [
        [frame("a", 0, sharp=5), frame("b", 8, sharp=9), frame("n", None), frame("c", 25, sharp=1)],
        [frame("d", 300, sharp=2), frame("z", 16, sharp=0)],  # z joins b and c
        [frame("e", 305, sharp=3), frame("f", 290, sharp=3), frame("g", 4000, sharp=1)],
        [frame("h", 4010, sharp=7), frame("i", 3990, sharp=2)],
    ]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    frames = stream(spark, tmp_path / "in", files)
    live.run_available(live.live_time_bursts(frames, PARAMS, "source", "5 minutes"), "append", live.append_to(out), state)
    emitted, still = live.read_batches(spark, out), live.open_bursts(spark, state, "source")
    table = spark.createDataFrame([r for f in files for r in f], FRAME_SCHEMA).withColumn("source", F.lit("cam"))
    rows = lambda df: sorted(map(str, df.select("source", "frames", "first_when", "last_when", "peak", "candidate").collect()))
    assert rows(emitted.unionByName(still)) == rows(live.batch_time_bursts(table, PARAMS, "source"))
    assert sorted((r.frames, r.candidate) for r in emitted.collect()) == [(1, "n"), (3, "f"), (4, "b")]
    assert [(r.frames, r.candidate) for r in still.collect()] == [(3, "h")]


def test_bursts_of_a_stream_that_drops_a_frame_differ(spark, tmp_path):
    files = [[frame(f"{i:02d}", i * 4.0, sharp=i % 5) for i in range(20)]]
    counts = []
    for name, keep in (("all", "true"), ("dropped", "rel <> '07'")):
        out, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
        frames = stream(spark, tmp_path / f"in-{name}", files).where(keep)
        live.run_available(live.live_time_bursts(frames, PARAMS, "source"), "append", live.append_to(out), state)
        counts.append(sum(r.frames for r in live.open_bursts(spark, state, "source").collect()))
    assert counts == [20, 19]


def test_merge_bursts():
    bursts = [(1, 0, 0, 1.0, "a"), (2, 30, 35, 5.0, "b"), (1, 10, 10, 5.0, "c"), (1, 46, 46, 0.0, "d")]
    assert live.merge_bursts(bursts, 10) == [(2, 0, 10, 5.0, "c"), (2, 30, 35, 5.0, "b"), (1, 46, 46, 0.0, "d")]
    assert live.merge_bursts([*bursts, (1, 20, 20, 9.0, "e")], 10) == [(5, 0, 35, 9.0, "e"), (1, 46, 46, 0.0, "d")]


def test_batch_bursts_of_a_busy_source(spark, frames):
    """One source holds most frames; its bursts are cut by gaps, whatever the chunks, and sources don't mix."""
    rows = [frame(f"{i:04d}", i * 4.0 + (i // 50) * 100, sharp=i % 9) for i in range(400)] + [frame("u", None), frame("v", None)]
    table = frames(rows).withColumn("source", F.when(F.col("rel") >= "0350", F.lit(None).cast("string")).otherwise("cam"))
    got = live.batch_time_bursts(table, PARAMS, "source").collect()
    assert sorted(r.frames for r in got) == [1, 1] + [50] * 8
    assert sum(r.source is None for r in got) == 3


def test_a_new_checkpoint_does_not_wind_back_the_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    for i, sharp in enumerate((7, 0)):  # two streams over the same file with another time stamp of it, each from batch 0 on
        rows = [[frame("a", 0, sharp=sharp, mtime=1.0 + i), frame("b", 0, sharp=sharp, mtime=1.0)]]
        live.incremental_measure(stream(spark, tmp_path / f"in{i}", rows), path, "t", lambda f: f)
    cache.cache_append(spark.createDataFrame([frame("b", 0, sharp=3, mtime=1.0)], FRAME_SCHEMA), path, "t")
    got = {(r.rel, r.mtime): r.sharpness for r in cache.cache_load(spark, path, "t").collect()}
    assert got == {("a", 1.0): 7.0, ("a", 2.0): 0.0, ("b", 1.0): 3.0}


def test_photos_as_a_stream(spark, tmp_path):
    """New, renamed, moved and touched photos across restarts: each state of a file is measured once."""
    root, log, path, state = tmp_path / "shoot", tmp_path / "log", str(tmp_path / "cache"), str(tmp_path / "state")
    (root / "day").mkdir(parents=True)
    log.mkdir()
    for name in ("a.jpg", "_b.JPG", "day/c.jpg", "day/d.jpg", "note.txt"):
        (root / name).write_text(name)

    def measure(photos):
        def opened(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    (log / f"{uuid.uuid4()}").write_text(r.rel)
                yield pdf.assign(sharpness=1.0)[["rel", "mtime", "size_bytes", "sharpness"]]

        return photos.mapInPandas(opened, "rel string, mtime double, size_bytes bigint, sharpness double")

    def measured():
        time.sleep(0.3)
        live.incremental_measure(photos.photo_stream(spark, str(root), settle=0.1), path, "t", measure, state)
        out = sorted(p.read_text() for p in log.iterdir())
        for p in log.iterdir():
            p.rename(tmp_path / f"seen-{p.name}")
        return out

    assert measured() == ["_b.JPG", "a.jpg", "day/c.jpg", "day/d.jpg"]
    assert measured() == []
    (root / "day" / "e.jpg").write_text("new")  # changes the time of its folder, so c and d come again, and are known
    assert measured() == ["day/e.jpg"]
    (root / "a.jpg").rename(root / "z.jpg")
    os.utime(root / "_b.JPG", (5, 5))
    assert measured() == ["_b.JPG", "z.jpg"]
    (root / "day").rename(root / "night")
    (root / "night" / "c.jpg").write_text("longer than before")
    assert measured() == ["night/c.jpg", "night/d.jpg", "night/e.jpg"]
    assert measured() == []
    # A new checkpoint sees all photos, and measures none again.
    state = str(tmp_path / "another")
    assert measured() == [] and cache.cache_load(spark, path, "t").count() == 10


def test_incremental_measure_skips_what_is_known(spark, tmp_path):
    rows = [[frame("a", 0, sharp=1, mtime=1.0), frame("b", 1, sharp=2, mtime=1.0)], [frame("a", 0, sharp=50, mtime=1.0), frame("a", 0, sharp=7, mtime=2.0)]]
    frames = stream(spark, tmp_path / "in", rows)
    path = str(tmp_path / "cache")
    live.incremental_measure(frames, path, "t", lambda f: f)
    got = {(r.rel, r.mtime): r.sharpness for r in cache.cache_load(spark, path, "t").collect()}
    assert set(got) == {("a", 1.0), ("b", 1.0), ("a", 2.0)} and got[("a", 2.0)] == 7.0 and got[("b", 1.0)] == 2.0


def test_frames_of_many_sources_become_bursts_at_once():
    """The same bursts as one source after the other, equally sharp frames and frames without a source among them."""
    rng = np.random.default_rng(5)
    n = 3000
    rows = pd.DataFrame(
        {"source": rng.choice([*"abcdefgh", None], n), "at": rng.integers(0, 9000, n), "sharpness": rng.integers(0, 4, n) * 1.0, "rel": [f"f{i:04d}" for i in range(n)]}
    )
    want = []
    for key, part in rows.groupby("source", dropna=False):
        single = [(1, at, at, peak, rel) for at, peak, rel in zip(part["at"], part["sharpness"], part["rel"])]
        want += [(None if pd.isna(key) else key, *b) for b in live.merge_bursts(single, 10)]
    got = live._frames_to_bursts(rows, "source", 10)
    assert sorted(got.itertuples(index=False, name=None), key=str) == sorted(want, key=str) and len(want) > 100


def test_arrivals_of_several_files(spark, tmp_path, monkeypatch):
    """An arrival is written by several tasks, the same number for each; bursts are those of the finished table all the same."""
    from burstselect import frames as f
    from burstselect.plans import catalog

    monkeypatch.setattr(f, "ARRIVAL_ROWS", 100)
    at = "timestamp_ntz'2031-03-08 12:00:00' + make_dt_interval(0, 0, 0, id * 7 % 20000)"
    events = spark.range(2000).selectExpr("id as event_id", f"{at} as ts", "id % 5 as user_id", "'view' as event_type", "cast(id % 17 as double) as value", "concat('{\"k\": ', id % 90, '}') as props")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    opened = []
    scratch = f.scratch_path
    monkeypatch.setattr(f, "scratch_path", lambda s, name: opened.append(scratch(s, name)) or opened[-1])
    got = sorted(map(str, catalog.live_time_bursts(spark, str(tmp_path)).collect()))
    assert got == sorted(map(str, catalog.batch_time_bursts(spark, str(tmp_path)).collect()))
    counts = [len([n for n in os.listdir(f"{opened[0]}/{i}".removeprefix("file:")) if n.startswith("part-")]) for i in range(f.ARRIVALS + 1)]
    assert len(set(counts)) == 1 and counts[0] > 1
