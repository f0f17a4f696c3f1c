from __future__ import annotations

import csv
import glob
import random

import pytest

from burstselect.operators import export


def one_by_one(filenames, existing):
    """Names handed out in turn, straight from the rule."""
    taken, out = set(existing), []
    for name in filenames:
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        choice, n = name, 0
        while choice in taken:
            n += 1
            choice = f"{stem}-{n}{ext}"
        taken.add(choice)
        out.append(choice)
    return out


def named(spark, filenames, existing):
    items = spark.createDataFrame([(i, f) for i, f in enumerate(filenames)], "pos bigint, filename string")
    disk = spark.createDataFrame([(e,) for e in existing], "name string")
    return [r.exported_as for r in export.unique_names(items, disk).orderBy("pos").collect()]


def test_unique_names_equal_the_sequential_rule(spark):
    """Seven unrelated families of names that get in each other's way within a family."""
    rng = random.Random(11)
    pool = ["a.jpg", "a-1.jpg", "a-2.jpg", "a-1-1.jpg", "a-3.jpg", "a-01.jpg", "b.jpg", "b", "b-1", "a.b.jpg", "-1.jpg", "c-2.jpg"]
    filenames = [f"{rng.randint(1, 7)}{rng.choice(pool)}" for _ in range(400)]
    existing = [f"{f}{n}" for f in range(1, 8) for n in rng.sample(pool + ["a-4.jpg", "b-2", "c-1.jpg"], rng.randint(0, 4))]
    assert named(spark, filenames, existing) == one_by_one(filenames, existing)


def test_late_claims_of_a_number(spark):
    filenames = ["a.jpg", "a.jpg", "a-2.jpg", "a.jpg", "a-1.jpg", "a.jpg", "a-1.jpg", "a-4.jpg", "a.jpg", "a.jpg"]
    assert named(spark, filenames, []) == one_by_one(filenames, [])


def test_one_name_for_everything(spark):
    filenames = ["x.jpg"] * 500
    assert named(spark, filenames, ["x-7.jpg"]) == one_by_one(filenames, ["x-7.jpg"])


ITEMS = [
    (0, "u1/a.jpg", "a.jpg", "keeper", 90),
    (1, "u2/a.jpg", "a.jpg", "maybe", 80),
    (2, "u3/gone.jpg", "gone.jpg", "rejected", 5),
    (3, 'u4/b "x", y.jpg', 'b "x", y.jpg', "maybe", 40),
    (4, "u5/a.jpg", "a.jpg", "maybe", 7),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "pos bigint, rel_path string, filename string, mark string, sharpness int")


def outcomes(spark, items):
    sources = spark.createDataFrame([(r[1],) for r in ITEMS if r[0] != 2], "rel_path string")
    disk = spark.createDataFrame([("zz.jpg",)], "name string")
    failed = spark.createDataFrame([("u2/a.jpg", "disk full")], "rel_path string, message string")
    return export.export_outcomes(items, sources, disk, failed)


def test_outcomes_and_report(spark, items):
    got = outcomes(spark, items)
    rows = {r.pos: (r.outcome, r.exported_as, r.message) for r in got.collect()}
    assert rows[0] == ("copied", "a.jpg", "")
    assert rows[1] == ("failed", "", "disk full")  # a failed copy gives its name back
    assert rows[2] == ("skipped", "", "")
    assert rows[4] == ("copied", "a-1.jpg", "")
    report = export.export_report(got).first()
    assert report.summary == "3 copied · 1 skipped (source not found) · 1 failed"


def test_no_source_folder_skips_everything(spark, items):
    got = export.export_outcomes(items, None, spark.createDataFrame([], "name string"))
    assert export.export_report(got).first().summary == "5 skipped (source not found)"
    assert export.export_report(got.limit(0)).first().summary == "Nothing to export."


def test_export_manifest_is_plain_csv(spark, items, tmp_path):
    export.write_export_manifest(outcomes(spark, items), str(tmp_path / "m"))
    rows = []
    for part in sorted(glob.glob(str(tmp_path / "m" / "part-*.csv"))):
        with open(part, newline="") as fh:
            rows += list(csv.DictReader(fh))
    assert [r["rel_path"] for r in rows] == [i[1] for i in ITEMS]
    assert rows[3]["filename"] == 'b "x", y.jpg' and rows[2]["exported_as"] == ""
    assert {r["favourite"] for r in rows} == {"true"}


def test_size_counts_favourites(spark):
    docs = spark.createDataFrame([("p1", 10), ("p2", 20), ("p3", 40)], "id string, size_bytes bigint")
    stars = spark.createDataFrame([("p1",), ("p3",), ("gone",)], "id string")
    assert tuple(export.export_size(docs, stars).first()) == (50, 3)


def test_repeated_and_sourceless_failures(spark, items):
    """A path that failed twice is one row; without a source it is skipped; a failure needs no message."""
    sources = spark.createDataFrame([(r[1],) for r in ITEMS if r[0] != 2], "rel_path string")
    gone = next(r[1] for r in ITEMS if r[0] == 2)
    failed = [(gone, "x"), (gone, "y"), (ITEMS[0][1], None), (ITEMS[1][1], "a"), (ITEMS[1][1], "b")]
    got = export.export_outcomes(items, sources, spark.createDataFrame([], "name string"), spark.createDataFrame(failed, "rel_path string, message string"))
    rows = sorted((r.pos, r.outcome, r.message) for r in got.collect())
    assert len(rows) == len(ITEMS)
    assert rows[:3] == [(0, "failed", ""), (1, "failed", "b"), (2, "skipped", "")]


def test_distinct_names_need_no_order(spark):
    names = spark.createDataFrame([(i, f"DSC_{i}.JPG") for i in range(300)], "pos bigint, filename string")
    spark.sparkContext.setJobGroup("names", "names")
    out = export.unique_names(names, spark.createDataFrame([("other.jpg",)], "name string"))
    assert out.where("filename <> exported_as").isEmpty() and out.count() == 300
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("names"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs < 25
