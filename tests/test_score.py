from __future__ import annotations

import numpy as np
import pytest

from burstselect.operators import cache as caches
from burstselect.params import SelectionParams
from burstselect.plans.score import dated, known, remember, score
from burstselect.sources.photos import photo_scan


def loader():
    """Photos of these tests are arrays in numpy's own format."""

    def load(path):
        try:
            with open(path, "rb") as fh:
                return np.load(fh)
        except Exception:
            return None

    return load


@pytest.fixture(scope="module")
def shoot(spark, tmp_path_factory):
    """Three photos of one moment (sharp, soft, unreadable) and a much later one."""
    root = tmp_path_factory.mktemp("shoot")
    rng = np.random.default_rng(4)
    noise = rng.integers(0, 256, (32, 48), dtype=np.uint8)
    flat = np.full((32, 48), 130, np.uint8)
    for name, img in (("a.jpg", noise), ("b.jpg", flat), ("late.jpg", noise)):
        with open(root / name, "wb") as fh:
            np.save(fh, img)
    (root / "bad.jpg").write_bytes(b"nothing")
    tags = [("a.jpg", "2026:06:19 12:00:00", "25"), ("b.jpg", "2026:06:19 12:00:01", None), ("bad.jpg", "2026:06:19 12:00:02", "x"), ("late.jpg", "2026:06:19 13:00:00", None)]
    photos = dated(photo_scan(spark, str(root)), spark.createDataFrame(tags, "rel string, taken string, subsec string"))
    cols = "rel string, face_no int, x int, y int, w int, h int, frame_w int, frame_h int, open_prob double"
    faces = spark.createDataFrame([(n, 1, 0, 0, 24, 16, 48, 32, p) for n, p in (("a.jpg", 1.0), ("b.jpg", 0.1), ("bad.jpg", 1.0))], cols)
    return photos, faces


def test_time_run(shoot):
    photos, faces = shoot
    got = {r.rel: r for r in score(photos, faces, loader()).collect()}
    assert {r: (got[r].burst_id, got[r].bin, got[r].reason.split(";")[0]) for r in got} == {
        "a.jpg": (0, "keeper", "sharpest in burst"), "b.jpg": (0, "rejected", "eyes closed"),
        "bad.jpg": (0, "rejected", "much softer than burst peak"), "late.jpg": (1, "keeper", "single, passed checks"),
    }
    assert got["bad.jpg"].face_count == 0 and got["a.jpg"].has_subsec and not got["bad.jpg"].has_subsec


def test_similarity_run(shoot):
    photos, faces = shoot
    params = SelectionParams(group_method="similarity", sim_time_ceiling=7200.0, sim_max_distance=5)
    got = {r.rel: r for r in score(photos, faces, loader(), params).collect()}
    assert got["b.jpg"].burst_id == got["bad.jpg"].burst_id  # flat and unreadable photos both hash to zero
    assert got["a.jpg"].burst_id != got["b.jpg"].burst_id and got["a.jpg"].phash == got["late.jpg"].phash


def test_second_run_opens_nothing(spark, shoot, tmp_path):
    photos, faces = shoot
    params = SelectionParams()
    first = score(photos, faces, loader(), params)
    assert remember(first, str(tmp_path / "cache"), params) == 1
    stored = caches.cache_load(spark, str(tmp_path / "cache"), params.measure_tag())
    assert known(photos, stored).count() == 4

    def refuse(path):
        raise AssertionError("opened again")

    again = score(photos, faces, refuse, params, stored)
    pick = ("rel", "burst_id", "bin", "rank_in_burst", "sharpness")
    assert sorted(map(tuple, again.select(*pick).collect())) == sorted(map(tuple, first.select(*pick).collect()))
    moved = photos.withColumn("mtime", photos.mtime + 1)
    assert known(moved, stored).isEmpty()


def test_photos_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks open a stated number of photos each, though a row is a few bytes."""
    from burstselect.plans import score as plan

    rows = [(f"{i:03d}.jpg", str(tmp_path / "none"), 1.0, 1) for i in range(400)]
    photos = spark.createDataFrame(rows, "rel string, path string, mtime double, size_bytes bigint")
    photos = photos.selectExpr("*", "timestamp_ntz '2031-03-08 12:00:00' as when_ts").repartition(1)
    cols = "rel string, face_no int, x int, y int, w int, h int, frame_w int, frame_h int, open_prob double"
    log = str(tmp_path / "opened")

    def load(path):
        from pyspark import TaskContext

        with open(f"{log}-{TaskContext.get().partitionId()}", "a") as fh:
            fh.write("x")

    spread = plan.spread
    monkeypatch.setattr(plan, "spread", lambda df: spread(df, 20))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        assert score(photos, spark.createDataFrame([], cols), load).count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    opened = [len(p.read_text()) for p in tmp_path.glob("opened-*")]
    assert len(opened) >= 18 and sum(opened) == 400 and max(opened) <= 45
