from __future__ import annotations

import csv
import os

import pytest
from conftest import frame
from pyspark.sql import functions as F
from test_export import ITEMS, items, outcomes  # noqa: F401

from burstselect.operators import export, grouping, verdicts
from burstselect.sources import manifest, onefile


def lines_of(spark, n, text=lambda i: f"{i} käse\n"):
    return spark.createDataFrame([(i, text(i)) for i in range(n)], "i bigint, line string").repartition(7)


def read(path):
    with open(path, encoding="utf-8", newline="") as fh:
        return fh.read()


@pytest.mark.parametrize("n", [0, 1, 89, 1000])
def test_lines_come_in_order_behind_the_head(spark, tmp_path, n):
    """Chunks of 90 rows: none, one and twelve of them."""
    path = str(tmp_path / "f.txt")
    size = onefile.write_lines(lines_of(spark, n), [F.col("i")], path, "head ß\n")
    assert read(path) == "head ß\n" + "".join(f"{i} käse\n" for i in range(n))
    assert size == os.path.getsize(path) and os.listdir(tmp_path) == ["f.txt"]


def test_falling_order_nulls_and_ties(spark, tmp_path):
    path = str(tmp_path / "f.txt")
    onefile.write_lines(lines_of(spark, 600, lambda i: None if i % 3 == 0 else f"{i // 2}\n"), [-F.floor(F.col("i") / 2)], path)
    assert read(path).split() == [str(i // 2) for i in range(599, -1, -1) if i % 3]


def test_lines_longer_than_a_batch(spark, tmp_path):
    path = str(tmp_path / "f.txt")
    onefile.write_lines(lines_of(spark, 200, lambda i: f"{i}" * 40_000 + "\n"), [F.col("i")], path)
    assert read(path) == "".join(f"{i}" * 40_000 + "\n" for i in range(200))


@pytest.mark.parametrize("starts, size", [('{"0": 0}', 10), ('{"0": 0, "1": 5}', 999)])
def test_a_failed_job_leaves_the_old_file(spark, tmp_path, starts, size):
    """A task without a place for its range, and a job that wrote fewer bytes than there should be."""
    path = str(tmp_path / "f.txt")
    onefile.write_lines(lines_of(spark, 10), [F.col("i")], path)
    before = read(path)
    rows = spark.createDataFrame([(0, b"aaaa\n"), (1, b"bbbb\n")], "chunk int, line binary").repartitionById(2, F.col("chunk"))
    options = dict(path=path, head="", starts=starts, size=str(size))
    with pytest.raises(Exception):
        rows.write.format("one_file").mode("append").options(**options).save()
    assert read(path) == before and os.listdir(tmp_path) == ["f.txt"]


def test_manifest_in_one_file(frames, tmp_path):
    rows = [frame(f"d/{i:03d}.jpg", i * 0.9 if i % 7 else None, faces=i % 3, eye=0.5, sharp=i) for i in range(400)] + [frame('x, "y"\n.jpg', 5.05, sharp=1)]
    judged = verdicts.verdicts(grouping.time_bursts(frames(rows)))
    path = str(tmp_path / "m.csv")
    manifest.write_manifest_file(judged, path)
    with open(path, newline="") as fh:
        got = list(csv.DictReader(fh))
    assert list(got[0]) == manifest.MANIFEST_FIELDS and read(path).endswith("\r\n")
    wanted = judged.orderBy("burst_id", F.col("when_ts").isNull(), "when_ts", "rel").collect()
    assert [(r["rel"], int(r["burst_id"]), r["bin"]) for r in got] == [(r.rel, r.burst_id, r.bin) for r in wanted]


def test_export_manifest_in_one_file(spark, items, tmp_path):  # noqa: F811
    path = str(tmp_path / "m.csv")
    export.write_export_manifest_file(outcomes(spark, items), path)
    with open(path, newline="") as fh:
        got = list(csv.DictReader(fh))
    assert [r["rel_path"] for r in got] == [i[1] for i in ITEMS] and got[3]["filename"] == 'b "x", y.jpg'
    assert read(path).startswith("rel_path,filename,exported_as,mark,sharpness,favourite\n")
