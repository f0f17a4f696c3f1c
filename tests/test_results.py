from __future__ import annotations

import json

from conftest import frame
from pyspark.sql import functions as F

from burstselect.operators import grouping, results, review, verdicts
from burstselect.sources import manifest, progress


def judged(frames, rows):
    return verdicts.verdicts(grouping.time_bursts(frames(rows)))


ROWS = [
    frame("d/a.jpg", 0.0, faces=1, eye=1.0, sharp=100, size=11),
    frame("d/b.jpg", 0.5, faces=1, eye=0.0, sharp=400, size=12),
    frame("d/c.jpg", 1.0, faces=1, eye=0.625, sharp=90, size=13, exposed=True, blown=0.3, crushed=0.1),
    frame("d/s.jpg", 100, sharp=20, size=14),
    frame("d/u.jpg", None, sharp=60, size=15),
    frame("d/v.jpg", None, sharp=60, size=16),
]


def document(pieces):
    return "".join(r.piece for r in pieces.orderBy("burst_id", "position").collect())


def test_documents(spark, frames):
    text = document(results.result_document(judged(frames, ROWS), "time"))
    docs = json.loads(text)["bursts"]
    assert [d["id"] for d in docs] == ["t0", "t1", "t2", "t3"]
    first = docs[0]["frames"]
    assert [f["filename"] for f in first] == ["a.jpg", "b.jpg", "c.jpg"]  # keeper first, then by sharpness
    assert [f["sharpness"] for f in first] == [25, 99, 22] and docs[0]["keeper_id"] == first[0]["id"]
    assert first[2]["exposure"] == "blown" and first[2]["eyes"] == 62 and first[2]["size_bytes"] == 13
    assert docs[0]["faces"] and not docs[1]["faces"] and docs[1]["frames"][0]["eyes"] is None
    assert [d["label"] for d in docs] == ["12:00:00", "12:01:40", "--:--:-- · group 1", "--:--:-- · group 2"]
    assert list(first[0]) == results.FRAME_DOC and first[0]["id"].startswith("p") and len(first[0]["id"]) == 13
    # What we write is what our own reader takes for a result.
    routed = progress.route_events(spark.createDataFrame([(text,)], "value string")).first()
    assert routed.kind == "result" and routed.result.grouping == "time" and len(routed.result.bursts) == 4


def test_a_large_burst_is_many_pieces(frames):
    rows = [frame(f"{i:03d}.jpg", i * 0.1, sharp=i) for i in range(300)]
    pieces = results.result_document(judged(frames, rows), "time")
    assert pieces.count() == 300
    burst = json.loads(document(pieces))["bursts"]
    assert len(burst) == 1 and [f["filename"] for f in burst[0]["frames"]] == [f"{i:03d}.jpg" for i in reversed(range(300))]


def test_write_result(frames, tmp_path):
    results.write_result(results.result_document(judged(frames, ROWS), "time"), str(tmp_path / "doc"))
    parts = sorted((tmp_path / "doc").glob("part-*"))
    assert len(json.loads("".join(p.read_text() for p in parts))["bursts"]) == 4


def test_labels_share_a_second(frames):
    rows = [frame("a", 0.0), frame("b", 0.9)]
    grouped = frames(rows).withColumn("burst_id", F.when(F.col("rel") == "a", 0).otherwise(1).cast("bigint"))
    table = results.burst_labels(results.burst_table(verdicts.verdicts(grouped)))
    assert [r.label for r in table.orderBy("burst_id").collect()] == ["12:00:00 · group 1", "12:00:00 · group 2"]


def test_keeperless_burst_points_at_its_first_frame(frames):
    j = judged(frames, [frame("a", 0, faces=1, eye=0.0, sharp=5), frame("b", 1, faces=1, eye=0.0, sharp=9)])
    assert results.burst_table(j).first().keeper_rel == "b"


def test_progress_sequence(frames):
    got = results.progress_sequence(judged(frames, ROWS)).orderBy("done").collect()
    assert [(r.done, r.current_frame_name) for r in got] == [(1, "a.jpg"), (2, "b.jpg"), (3, "c.jpg"), (4, "s.jpg"), (5, "u.jpg"), (6, "v.jpg")]
    assert {r.total for r in got} == {6} and got[4].current_burst_label == "--:--:-- · group 1"
    lines = progress.route_events(results.progress_lines(judged(frames, ROWS))).orderBy("done").collect()
    assert [r.kind for r in lines] == ["progress"] * 7
    assert tuple(lines[0].progress) == (0, 6, "", "", "loading") and lines[6].progress.done == 6


def test_steps_wrap(frames):
    docs = results.frame_documents(judged(frames, ROWS))
    names = {r.id: r.filename for r in docs.collect()}
    step = {names[r.id]: (names[r.prev_id], names[r.next_id]) for r in review.frame_step(docs).collect()}
    assert step["a.jpg"] == ("c.jpg", "b.jpg") and step["c.jpg"] == ("b.jpg", "a.jpg") and step["s.jpg"] == ("s.jpg", "s.jpg")
    bursts = {r.burst_id: (r.prev_burst_id, r.next_burst_id) for r in review.burst_step(docs, "keeper").collect()}
    assert bursts == {0: (3, 2), 2: (0, 3), 3: (2, 0)}  # burst 1 shows no keeper and is stepped over


def test_staging(frames):
    rows = manifest.manifest_rows(judged(frames, ROWS)).withColumn("filename", F.lit("x.jpg"))
    plan = {r.dest: r.rel for r in review.staging_plan(rows, ("keeper", "maybe", "rejected")).collect()}
    assert plan["keepers/b0_x.jpg"] == "d/a.jpg" and plan["rejected/eyes-closed_x.jpg"] == "d/b.jpg" and plan["maybe/b1/x.jpg"] == "d/s.jpg"
    assert {r.bin: r.links for r in review.staging_counts(rows).collect()} == {"keeper": 3, "maybe": 1}
    same = manifest.manifest_rows(judged(frames, ROWS)).withColumns({"filename": F.lit("x"), "bin": F.lit("rejected"), "reason": F.lit("r")})
    assert [(r.dest, r.rel) for r in review.staging_plan(same, ("rejected",)).collect()] == [("rejected/r_x", "d/v.jpg")]


def test_contact_sheet(frames):
    sheet = {}
    for r in review.contact_sheet(judged(frames, ROWS)).orderBy("burst_id", "place").collect():
        sheet.setdefault(r.burst_id, []).append(r)
    assert [c.filename for c in sheet[0]] == ["a.jpg", "b.jpg", "c.jpg"] and sheet[0][0].frames == 3
    assert sheet[0][0].when_iso == "2031-03-08T12:00:00" and sheet[2][0].when_iso == ""
    assert (sheet[0][0].keepers, sheet[0][0].maybes, sheet[0][0].rejects) == (1, 0, 2)
    assert tuple(review.contact_totals(judged(frames, ROWS)).first()) == (6, 4, 3, 1, 2)


def test_compare_groupings(frames):
    a = judged(frames, ROWS)
    b = verdicts.verdicts(frames(ROWS).withColumn("burst_id", F.lit(0).cast("bigint")))
    assert tuple(review.compare_summary(review.compare_groupings(a, a)).first()) == (3, 3, 0)
    assert review.compare_summary(review.compare_groupings(a, b)).first().right_best == 1


def test_equal_ids_in_two_bursts(spark, frames):
    """Ids are short hashes: the keeper is looked up inside its burst."""
    j = judged(frames, [frame("a", 0, sharp=60), frame("b", 100, sharp=70)])
    bursts, docs = results.burst_table(j), results.frame_documents(j)
    same = lambda df, c: df.withColumn(c, F.lit("p000000000000"))
    found = review.keeper_lookup(same(bursts, "keeper_id"), same(docs, "id")).collect()
    assert sorted((r.burst_id, r.filename) for r in found) == [(0, "a"), (1, "b")]
