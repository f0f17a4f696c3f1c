from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import T0, frame
from pyspark.sql import functions as F

from burstselect.functions.columns import box
from burstselect.operators import cache, commits, faces, grouping, region, verdicts
from burstselect.operators.diff import manifest_diff
from burstselect.params import SelectionParams
from burstselect.sources import manifest, photos, progress


def test_photo_scan(spark, tmp_path):
    names = ["_DSC1.JPG", ".hidden.jpg", "a.jpeg", "b.png", "day1/c.JpG", "day1/x/y/z/d.jpg", "day1/x/y/z/e.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    want = sorted(n for n in names if n.lower().endswith((".jpg", ".jpeg")))
    for depth in (0, 1, 2, 9):
        got = photos.photo_scan(spark, str(tmp_path), depth).orderBy("rel").collect()
        assert [r.rel for r in got] == want and [r.size_bytes for r in got] == [len(n) for n in want]
    assert got[0].mtime == os.stat(tmp_path / want[0]).st_mtime
    plain = photos.binary_scan(spark, str(tmp_path))
    assert plain.count() == 3 and "content" not in plain._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_source_stats(spark):
    rows = [("a.JPG", 5), ("x/b.jpg", 7), ("c.cr3", 1), ("d.txt", 100), (".jpg", 100), ("noext", 100)]
    files = spark.createDataFrame(rows, "rel string, size_bytes bigint")
    assert tuple(photos.source_stats(files).first()) == (3, 13, 2)


def judged(frames):
    rows = [frame("d/a.jpg", 0.5, faces=1, eye=0.75, sharp=10.0625, blown=0.1), frame("d/b, c.jpg", 1, sharp=99), frame("u.jpg", sharp=3, exposed=True)]
    return verdicts.verdicts(grouping.time_bursts(frames(rows)))


def test_manifest_round_trip(spark, frames, tmp_path):
    path = str(tmp_path / "m")
    manifest.write_manifest(judged(frames), path)
    got = {r.rel: r for r in manifest.read_manifest(spark, path).collect()}
    a = got["d/a.jpg"]
    assert (a.filename, a.burst_id, a.when_iso, a.eye_score, a.sharpness, a.face_count) == ("a.jpg", 0, "2031-03-08T12:00:00.500000", 0.75, 10.062, 1)
    assert got["d/b, c.jpg"].filename == "b, c.jpg" and got["d/b, c.jpg"].eye_score is None
    assert got["u.jpg"].when_iso == "" and got["u.jpg"].exposure_flag and got["u.jpg"].reason.endswith("; exposure flag")
    assert manifest_diff(manifest.read_manifest(spark, path), manifest.manifest_rows(judged(frames))).isEmpty()


def test_manifest_times_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = ["2026-03-29T02:30:00.250000", "2026-03-29T03:30:00", "", "soon"]
    rows = spark.createDataFrame([(t, 0.0, 0.0) for t in times], "when_iso string, blown_frac double, crushed_frac double")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r.t for r in manifest.judged_from_manifest(rows).select(F.col("when_ts").cast("string").alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2026-03-29 02:30:00.25", "2026-03-29 03:30:00", None, None]


def test_manifest_keeps_line_breaks(spark, frames, tmp_path):
    path = str(tmp_path / "m")
    odd = 'two\nlines, "x".jpg'
    manifest.write_manifest(verdicts.verdicts(grouping.time_bursts(frames([frame(odd, 1, sharp=60)]))), path)
    assert manifest.read_manifest(spark, path, line_breaks=True).first().rel == odd


def test_manifest_parse_is_forgiving(spark):
    cells = spark.createDataFrame([("d/a.jpg", "", "x", " 3 ", "oops", "True", "keeper")], "rel string, filename string, burst_id string, rank_in_burst string, sharpness string, exposure_flag string, bin string")
    r = manifest.parse_manifest(cells).first()
    assert (r.filename, r.burst_id, r.rank_in_burst, r.sharpness, r.exposure_flag, r.eye_score, r.reason) == ("a.jpg", 0, 3, 0.0, True, None, "")


def test_manifest_diff_lists_everything(spark):
    schema = "filename string, bin string, face_count int, burst_id bigint, rel string, when_iso string"
    rows = lambda *r: spark.createDataFrame([(*x, x[0], "") for x in r], schema)
    gold = rows(("a", "keeper", 1, 0), ("b", "maybe", 0, 0), ("gone", "maybe", 0, 1))
    cur = rows(("a", "keeper", 1, 0), ("a", "maybe", 1, 2), ("b", "maybe", 0, 0), ("new", "maybe", 0, 1))
    got = {tuple(r) for r in manifest_diff(cur, gold, key="filename").collect()}
    assert got == {
        ("a", "bin", "keeper", "maybe"), ("a", "burst_id", "0", "2"), ("a", "copies", "1", "2"),
        ("gone", "filename", "gone", None), ("new", "filename", None, "new"),
    }


def test_manifest_diff_tells_folders_apart(spark):
    schema = "filename string, bin string, face_count int, burst_id bigint, rel string, when_iso string"
    table = lambda *r: spark.createDataFrame([("DSC_1.JPG", b, 1, 0, p, "") for p, b in r], schema)
    gold = table(("one/DSC_1.JPG", "keeper"), ("two/DSC_1.JPG", "maybe"), ("old/DSC_1.JPG", "maybe"))
    cur = table(("one/DSC_1.JPG", "rejected"), ("two/DSC_1.JPG", "maybe"), ("new/DSC_1.JPG", "maybe"))
    assert {tuple(r) for r in manifest_diff(cur, gold).collect()} == {
        ("one/DSC_1.JPG", "bin", "keeper", "rejected"), ("old/DSC_1.JPG", "rel", "old/DSC_1.JPG", None), ("new/DSC_1.JPG", "rel", None, "new/DSC_1.JPG"),
    }


def test_cache_tags_and_latest(spark, frames, tmp_path):
    path = str(tmp_path / "cache")
    one = lambda s: frames([frame("a.jpg", 0, sharp=s, size=10, mtime=1.0)])
    runs = [cache.cache_append(one(5), path, "2.0"), cache.cache_append(one(9), path, "sim"), cache.cache_append(one(6), path, "2.0")]
    assert runs == [1, 2, 3]
    assert [r.sharpness for r in cache.cache_load(spark, path, "2.0").collect()] == [6.0]
    assert [r.sharpness for r in cache.cache_load(spark, path, "sim").collect()] == [9.0]
    scan = frames([frame("a.jpg", 7, size=10, mtime=1.0), frame("a2.jpg", 8, size=10, mtime=1.0)])
    filled = cache.cache_fill(scan, cache.cache_load(spark, path, "2.0"))
    got = {r.rel: (r.cached, r.sharpness, r.when_ts) for r in filled.collect()}
    assert got["a.jpg"][:2] == (True, 6.0) and got["a.jpg"][2] > T0 and got["a2.jpg"][:2] == (False, None)
    assert tuple(cache.cache_stats(filled).first()) == (1, 1)
    small = str(tmp_path / "small")
    cache.cache_compact(spark, path, small)
    assert [r.sharpness for r in cache.cache_load(spark, small, "2.0").collect()] == [6.0]
    assert spark.read.parquet(small).count() == 2 and cache.cache_append(one(8), small, "2.0") == 4
    assert cache.cache_keys(spark, str(tmp_path / "none"), "2.0") is None
    assert cache.cache_append(one(1), path, "2.0", resume=False) == 4
    assert cache.cache_load(spark, path, "sim").isEmpty()
    twice = one(3).unionByName(one(4))
    cache.cache_append(twice, path, "2.0")
    assert [r.sharpness for r in cache.cache_load(spark, path, "2.0").collect()] == [4.0]


def test_runs_at_the_same_moment(spark, frames, tmp_path):
    """Each has a number of its own, and none loses rows to another's."""
    path = str(tmp_path / "cache")
    runs = [frames([frame(f"{w}.jpg", 0, sharp=w, size=1, mtime=1.0), frame("all.jpg", 0, sharp=w, size=1, mtime=1.0)]) for w in range(6)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda df: cache.cache_append(df, path, "t"), runs))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    got = {r.rel: r.sharpness for r in cache.cache_load(spark, path, "t").collect()}
    assert got == {**{f"{w}.jpg": w for w in range(6)}, "all.jpg": numbers.index(6)}


def test_claims_of_many_threads_differ(spark, tmp_path):
    with ThreadPoolExecutor(16) as pool:
        numbers = list(pool.map(lambda _: commits.claim(spark, str(tmp_path / "c")), range(64)))
    assert sorted(numbers) == list(range(1, 65))


def test_half_a_run_is_not_seen(spark, frames, tmp_path):
    path = str(tmp_path / "cache")
    one = lambda s, n="a.jpg": frames([frame(n, 0, sharp=s, size=1, mtime=1.0)])
    cache.cache_append(one(1), path, "t")
    broken = one(2).withColumn("sharpness", F.raise_error(F.lit("no")).cast("double"))
    for resume in (True, False):
        with pytest.raises(Exception, match="no"):
            cache.cache_append(broken, path, "t", resume)
    # Rows that are there, but not finished.
    run = commits.claim(spark, path)
    cache._write(one(7).selectExpr("rel", "mtime", "size_bytes", "sharpness", "'t' as tag", "0 as part", f"{run}L as ran"), path, run)
    values = lambda: [r.sharpness for r in cache.cache_load(spark, path, "t").collect()]
    assert run == 4 and values() == [1.0]
    commits.finish(spark, path, run, "done")
    assert values() == [7.0]
    assert cache.cache_append(one(9).limit(0), path, "t") == 5 and values() == [7.0]
    assert cache.cache_append(one(3, "b.jpg"), path, "t", resume=False) == 6
    assert [(r.rel, r.sharpness) for r in cache.cache_load(spark, path, "t").collect()] == [("b.jpg", 3.0)]


def test_compaction_beside_a_run(spark, frames, tmp_path):
    """A run that began before a compaction and ends after it keeps its place among the others."""
    path = str(tmp_path / "cache")
    one = lambda s, n="a.jpg": frames([frame(n, 0, sharp=s, size=1, mtime=1.0)])
    cache.cache_append(one(1), path, "t")
    late = commits.claim(spark, path)
    cache.cache_append(one(3), path, "t")
    before = cache.cache_load(spark, path, "t")
    assert cache.cache_compact(spark, path) == 4 and commits.snapshot(spark, path).runs == [4]
    write_both = one(2).unionByName(one(5, "late.jpg")).selectExpr("rel", "mtime", "size_bytes", "sharpness", "'t' as tag", "0 as part", f"{late}L as ran")
    cache._write(write_both, path, late)
    commits.finish(spark, path, late, "done")
    want = {"a.jpg": 3.0, "late.jpg": 5.0}
    values = lambda: {r.rel: r.sharpness for r in cache.cache_load(spark, path, "t").collect()}
    assert values() == want and commits.snapshot(spark, path).runs == [2, 4]
    assert cache.cache_compact(spark, path) == 5 and values() == want and commits.snapshot(spark, path).runs == [5]
    assert [r.sharpness for r in before.collect()] == [3.0]  # a reader of before the compaction
    cache.cache_append(one(6), path, "t")
    assert values() == {"a.jpg": 6.0, "late.jpg": 5.0}


def test_cache_rows_from_text(spark):
    cols = "rel string, mtime string, size string, gap string, face_count string, primary_box string, eye_score string, sharpness string, blown_frac string, crushed_frac string, exposure_flag string, phash string, written_at bigint"
    rows = [
        ("a", "1.5", "10", "2.0", "1", "0.1;0.2;0.3;0.4", "0.5", "3.0", "0.1", "0.2", "1", "18446744073709551615", 1),
        ("a", "1.5", "10", "2.0", "2", "", "", "", "", "", "", "", 2),
        ("b", "x", "10", "2.0", "", "", "", "", "", "", "", "", 3),
        ("c", "1", "1", "sim", "", "", "", "", "", "", "", "7", 4),
    ]
    parsed = cache.parse_cache_rows(spark.createDataFrame(rows, cols), "2.0")
    assert [(r.rel, r.phash) for r in parsed.orderBy("written_at").collect()] == [("a", -1), ("a", 0)]
    last = cache.cache_latest(parsed).first()
    assert (last.face_count, last.primary_box, last.eye_score, last.exposure_flag) == (2, None, None, False)


def test_partly_cached_burst(spark, frames):
    rows = [frame(f"{i}.jpg", i * 0.1) for i in range(3)]
    boxes = {"0.jpg": (0.0, 0.0, 0.2, 0.2), "1.jpg": (0.2, 0.2, 0.4, 0.4)}
    b = spark.createDataFrame([(k, *v) for k, v in boxes.items()], "rel string, x double, y double, w double, h double")
    src = frames(rows).join(b.select("rel", box("x", "y", "w", "h").alias("primary_box")), "rel", "left")
    src = src.withColumn("cached", F.col("rel") == "0.jpg")
    work = cache.sharpness_work(region.with_locked_region(grouping.time_bursts(src)))
    got = {r.rel: tuple(round(x, 9) for x in r.region) for r in work.collect()}
    assert got == {n: (0.1, 0.1, 0.3, 0.3) for n in ("1.jpg", "2.jpg")}  # the cached box counts, its frame is not re-read
    assert cache.sharpness_work(region.with_locked_region(grouping.time_bursts(src)), recompute_bursts=True).count() == 3


def test_locked_region_of_a_hot_burst(spark, frames):
    """The median of a burst over several chunks equals the plain one."""
    rows = [frame(f"{i:03d}.jpg", i * 0.01) for i in range(200)]
    src = frames(rows).withColumn("n", F.substring("rel", 1, 3).cast("int"))
    src = src.withColumn("primary_box", F.when(F.col("n") % 3 != 0, box((F.col("n") * 7 % 101) / 200.0, F.col("n") / 500.0, F.lit(0.2), F.lit(0.1))))
    grouped = grouping.time_bursts(src)
    assert grouped.where("_spans").count() == 200
    got = region.locked_region(grouped).first().region
    want = src.select(*[F.percentile(F.col(f"primary_box.{a}"), 0.5) for a in "xywh"]).first()
    assert tuple(got) == tuple(want)
    none = grouping.time_bursts(src.withColumn("primary_box", F.when(F.col("n") < 0, F.col("primary_box"))))
    assert tuple(region.locked_region(none).first().region) == (0.25, 0.25, 0.5, 0.5)


def test_faces(spark):
    rows = [
        ("p", 1, 0, 0, 100, 100, 1000, 1000, 0.2), ("p", 2, 500, 500, 120, 100, 1000, 1000, None), ("p", 3, 0, 0, 60, 60, 1000, 1000, 0.9),
        ("tiny", 1, 0, 0, 20, 20, 1000, 1000, 0.9), *[("crowd", i, i, 0, 200, 200, 1000, 1000, 0.9) for i in range(1, 10)],
    ]
    d = spark.createDataFrame(rows, "rel string, face_no int, x int, y int, w int, h int, frame_w int, frame_h int, open_prob double")
    kept = faces.foreground_faces(d)
    assert {(r.rel, r.face_no) for r in kept.collect()} == {("p", 1), ("p", 2)} | {("crowd", i) for i in range(1, 7)}
    m = {r.rel: r for r in faces.face_measurements(kept).collect()}
    assert m["p"].face_count == 2 and tuple(m["p"].primary_box) == (0.5, 0.5, 0.12, 0.1)
    assert abs(m["p"].eye_score - 0.012 / 0.022) < 1e-12 and m["crowd"].face_count == 6
    frames_ = spark.createDataFrame([("p",), ("tiny",)], "rel string")
    assert {r.rel: r.face_count for r in faces.with_faces(frames_, d).collect()} == {"p": 2, "tiny": 0}


def test_subject_modes(spark, frames):
    b = spark.createDataFrame([("a.jpg", 0.1, 0.2, 0.3, 0.4)], "rel string, x double, y double, w double, h double")
    src = frames([frame("a.jpg", 0), frame("b.jpg", 1)]).join(b.select("rel", box("x", "y", "w", "h").alias("primary_box")), "rel", "left")

    def regions(df, **params):
        out = region.subject_region(df, SelectionParams(**params)).collect()
        return [r.region and tuple(r.region) for r in sorted(out, key=lambda r: r.rel)]

    center, own = (0.25, 0.25, 0.5, 0.5), (0.1, 0.2, 0.3, 0.4)
    assert regions(src, subject_mode="whole") == [None, None]
    assert regions(src, subject_mode="center") == [center, center]
    assert regions(src, group_method="similarity", subject_mode="face") == [own, center]
    assert regions(grouping.time_bursts(src)) == [own, own]  # one region for the whole burst


LINES = [
    '{"done": 0, "total": 5, "current_frame_name": "", "current_burst_label": "", "phase": "loading"}',
    '{"done": 3, "total": 5, "current_frame_name": "a.jpg", "current_burst_label": "x", "extra": 1}',
    '{"done": 3, "total": 5, "current_frame_name": "a.jpg", "current_burst_label": "x", "phase": "dreaming"}',
    '{"done": "many", "total": 5, "current_frame_name": "a.jpg", "current_burst_label": "x"}',
    '{"done": null}',
    '{"grouping": "time", "bursts": [{"id": "t0", "label": "l", "time": "t", "faces": true, "keeper_id": "p", "frames": [{"id": "p", "filename": "f", "sharpness": 1, "eyes": null, "faces": 0, "exposure": "ok", "mark": "keeper", "reason": "r", "size_bytes": 1, "rel_path": "f"}]}]}',
    '{"grouping": "time", "bursts": [{"id": "t0"}]}',
    '{"grouping": "time"}',
    '{"grouping": "colour", "bursts": []}',
    '{"note": "done"}', "[1, 2]", "plain text", "",
]


def test_route_events(spark):
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "i int, value string")
    kinds = [r.kind for r in progress.route_events(lines).orderBy("i").collect()]
    assert kinds == ["progress", "progress", "error", "error", "error", "result", "error", "error", "error"] + ["skipped"] * 4
    assert [r.done for r in progress.progress_events(lines).orderBy("done").collect()] == [0, 3]
    assert progress.result_events(lines).first().bursts[0].keeper_id == "p"


def test_whole_selection_from_pixels(spark, frames):
    """Scan, measure, group, judge: a frame with closed eyes is rejected, its open-eyed twin kept."""
    rows = [frame("a.jpg", 0), frame("b.jpg", 1)]
    shot = lambda n, p: (n, 1, 16, 16, 32, 32, 64, 64, p)
    det = spark.createDataFrame([shot("a.jpg", 0.0), shot("b.jpg", 1.0)], "rel string, face_no int, x int, y int, w int, h int, frame_w int, frame_h int, open_prob double")
    found = faces.with_faces(frames(rows).drop("face_count", "eye_score"), det)
    judged_ = {r.rel: r for r in verdicts.verdicts(grouping.group_frames(found, SelectionParams())).collect()}
    assert judged_["a.jpg"].reason == "eyes closed" and judged_["b.jpg"].bin == "keeper" and judged_["a.jpg"].face_count == 1
