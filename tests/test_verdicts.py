from __future__ import annotations

import glob
import os
import random
import statistics

import pytest
from conftest import frame
from pyspark.sql import functions as F

from burstselect.operators import grouping, review, verdicts
from burstselect.operators.diff import manifest_diff
from burstselect.params import SelectionParams
from burstselect.sources import manifest


def judge(frames, rows, params=SelectionParams(), burst=0):
    grouped = frames(rows).withColumn("burst_id", F.lit(burst).cast("bigint"))
    return {r.rel: r for r in verdicts.verdicts(grouped, params).collect()}


def sizes(df):
    return [r.frames for r in grouping.burst_sizes(df).orderBy("burst_id").collect()]


def test_gap_starts_a_new_burst(frames):
    rows = [frame(f"{i}.jpg", s) for i, s in enumerate([0.0, 0.4, 1.9, 6.0, 7.5])]
    assert sizes(grouping.time_bursts(frames(rows))) == [3, 2]


def test_equal_gap_and_undated_frames(frames):
    rows = [frame("a.jpg", 0), frame("b.jpg", 2), frame("c.jpg", 4.000001), frame("x.jpg"), frame("y.jpg")]
    grouped = grouping.time_bursts(frames(rows))
    assert sizes(grouped) == [2, 1, 1, 1]  # an equal gap stays together, undated frames stay alone
    assert tuple(grouping.group_summary(grouped).first()) == (4, 3, 1)


def test_close_hashes_share_a_burst(frames):
    rows = [frame("a.jpg", 0, phash=0), frame("b.jpg", 1, phash=1), frame("c.jpg", 2, phash=-1)]
    assert sizes(grouping.similarity_bursts(frames(rows))) == [2, 1]


def test_ceiling_cuts_and_undated_frames_join(frames):
    rows = [frame("a.jpg", 0), frame("b.jpg", 60), frame("x.jpg"), frame("y.jpg")]
    assert sizes(grouping.similarity_bursts(frames(rows))) == [1, 3]  # undated frames may join


def test_similarity_of_long_hashes(spark):
    rows = [("a", None, [0, 0, 0, 0]), ("b", None, [0, 1, 0, 0]), ("c", None, [-1, 0, 0, 0])]
    df = spark.createDataFrame(rows, "rel string, when_ts timestamp_ntz, phash array<bigint>")
    assert sizes(grouping.similarity_bursts(df, SelectionParams(phash_size=16))) == [2, 1]


def test_closed_eyes_gate_a_portrait(frames):
    v = judge(frames, [frame("open", faces=1, eye=0.9, sharp=80), frame("shut", faces=1, eye=0.1, sharp=250)])
    assert (v["shut"].bin, v["shut"].reason, v["shut"].rank_in_burst) == ("rejected", "eyes closed", -1)
    assert v["open"].bin == "keeper"


def test_group_shots_have_no_gate(frames):
    v = judge(frames, [frame(n, faces=2, eye=e, sharp=s) for n, e, s in (("a", 0.8, 120), ("b", 0.8, 150), ("c", 0.2, 260))])
    assert v["b"].bin == "keeper" and v["b"].reason == "best eyes + sharpness" and v["c"].bin != "rejected"


def test_singles(frames):
    assert judge(frames, [frame("s", sharp=10)])["s"].reason == "single, sharpness uncertain"
    assert judge(frames, [frame("s", faces=1, eye=1.0, sharp=200)])["s"].bin == "keeper"
    flagged = judge(frames, [frame("s", faces=1, eye=1.0, sharp=200, exposed=True)])["s"]
    assert flagged.bin == "keeper" and flagged.reason == "single, passed checks; exposure flag"
    shut = judge(frames, [frame("s", faces=1, eye=0.0, sharp=200, exposed=True)])["s"]
    assert (shut.bin, shut.reason, shut.rank_in_burst) == ("rejected", "single, eyes closed", 0)
    assert judge(frames, [frame("s", faces=2, eye=0.0, sharp=200)])["s"].bin == "keeper"  # two faces: no gate


def test_ratio_and_several_keepers(frames):
    v = judge(frames, [frame("a", sharp=500), frame("b", sharp=149)])
    assert v["a"].bin == "keeper" and v["b"].reason == "much softer than burst peak"
    rows = [frame("a", sharp=90), frame("b", sharp=80), frame("c", sharp=70)]
    v = judge(frames, rows, SelectionParams(keep_per_burst=2))
    assert [v[n].bin for n in "abc"] == ["keeper", "keeper", "maybe"]


def test_keeper_comes_before_the_ratio(frames):
    """The peak counts gated frames, yet the best open-eyed frame is kept however soft it is."""
    v = judge(frames, [frame("shut", faces=1, eye=0.0, sharp=246.4), frame("open", faces=1, eye=1.0, sharp=9.8)])
    assert v["open"].bin == "keeper"


def test_ties_keep_capture_order(frames):
    v = judge(frames, [frame("b", 0, sharp=9), frame("a", 1, sharp=9), frame("c", None, sharp=9)])
    assert [v[n].rank_in_burst for n in "bac"] == [0, 1, 2]


def test_group_rule_is_the_median(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for b in range(300):
        counts = [rng.choice([0, 1, 1, 2, 3, 5]) for _ in range(rng.randint(1, 7))]
        rows += [(b, c) for c in counts]
        some = [c for c in counts if c]
        want[b] = bool(some) and statistics.median(some) >= 2
    df = spark.createDataFrame(rows, "burst_id bigint, face_count int")
    assert {r.burst_id: r.is_group for r in verdicts.group_shots(df).collect()} == want


def test_filters_and_counts(frames):
    grouped = frames([frame("a", sharp=300), frame("b", sharp=50), frame("c", sharp=200)]).withColumn("burst_id", F.lit(0).cast("bigint"))
    judged = verdicts.verdicts(grouped)
    assert {r.mark: r.frames for r in review.mark_counts(judged).collect()} == {"all": 3, "keeper": 1, "maybe": 1, "rejected": 1}
    assert not review.nothing_matches(judged, "maybe") and review.nothing_matches(judged.where("bin = 'keeper'"), "rejected")


# A manifest written down by hand: a gated peak, two faces in a portrait burst, a soft frame, flagged exposures, singles, undated frames.
SNAPSHOT = """rel,filename,burst_id,when_iso,face_count,eye_score,sharpness,exposure_flag,blown_frac,crushed_frac,bin,reason,rank_in_burst
d/a1.jpg,a1.jpg,0,2031-03-08T12:00:00,1,0.1000,400.000,0,0.0000,0.0000,rejected,eyes closed,-1
d/a2.jpg,a2.jpg,0,2031-03-08T12:00:00.500000,1,0.9000,300.000,1,0.2000,0.0000,keeper,sharpest in burst; exposure flag,0
d/a3.jpg,a3.jpg,0,2031-03-08T12:00:01,2,0.2000,250.000,0,0.0000,0.0000,rejected,eyes closed,-1
d/a4.jpg,a4.jpg,0,2031-03-08T12:00:02,1,0.5000,119.000,1,0.0000,0.3000,rejected,much softer than burst peak,2
d/a5.jpg,a5.jpg,0,2031-03-08T12:00:03,0,,120.000,0,0.0000,0.0000,maybe,burst runner-up,1
d/b1.jpg,b1.jpg,1,2031-03-08T12:01:00,2,0.5000,90.000,0,0.0000,0.0000,maybe,burst runner-up,1
d/b2.jpg,b2.jpg,1,2031-03-08T12:01:01,3,1.0000,80.000,0,0.0000,0.0000,keeper,best eyes + sharpness,0
d/s1.jpg,s1.jpg,2,2031-03-08T12:05:00,1,0.4000,500.000,0,0.0000,0.0000,rejected,"single, eyes closed",0
d/s2.jpg,s2.jpg,3,2031-03-08T12:06:00,0,,49.000,1,0.5000,0.0000,maybe,"single, sharpness uncertain; exposure flag",0
d/u1.jpg,u1.jpg,4,,0,,60.000,0,0.0000,0.0000,keeper,"single, passed checks",0
d/u2.jpg,u2.jpg,5,,0,,70.000,0,0.0000,0.0000,keeper,"single, passed checks",0
"""


def test_snapshots_are_reproduced(spark, tmp_path):
    """Recompute the verdicts of manifests, burst ids too where they come from capture times.

    The one above runs always; ``BURST_SNAPSHOTS`` names a folder of recorded ones (manifest_*.csv) to replay as well.
    """
    own = tmp_path / "manifest_time.csv"
    own.write_text(SNAPSHOT)
    paths = [str(own), *glob.glob(os.path.join(os.environ.get("BURST_SNAPSHOTS", str(tmp_path / "none")), "manifest_*.csv"))]
    for path in paths:
        gold = manifest.read_manifest(spark, path)
        src = manifest.judged_from_manifest(gold).drop("bin", "reason", "rank_in_burst")
        grouped = grouping.time_bursts(src.drop("burst_id")) if "time" in os.path.basename(path) else src
        judged = manifest.manifest_rows(verdicts.verdicts(grouped))
        fields = ("bin", "reason", "rank_in_burst", "burst_id", "face_count")
        assert manifest_diff(judged, gold, fields).collect() == []
