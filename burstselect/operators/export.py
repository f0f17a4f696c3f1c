"""Delivering the favourites: the export set, collision-free names, outcomes, the export manifest and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.plans.ordered import ranked
from burstselect.session import pin
from burstselect.sources.onefile import write_csv_file

# ---- what is exported ------------------------------------------------------------------------------------------


def export_set(documents: DataFrame, favourites: DataFrame) -> DataFrame:
    """Frame documents whose id is a favourite, with their place in burst order, best first."""
    starred = documents.drop("_chunk", "_spans").join(favourites.select("id"), "id", "left_semi")
    return ranked(starred, [], [F.col("burst_id"), F.col("position")], "pos")


def export_size(documents: DataFrame, favourites: DataFrame) -> DataFrame:
    """Total bytes of the export set and the number of favourites."""
    starred = documents.join(favourites.select("id"), "id", "left_semi")
    total = starred.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    count = favourites.agg(F.countDistinct("id").alias("n")).scalar()
    return total.withColumn("favourites", count)


# ---- unique names ----------------------------------------------------------------------------------------------

_NUMBERED = r"(?s)^(.+)-([1-9][0-9]{0,17})$"


def _name_parts(filename: Column) -> list[Column]:
    """Stem and extension; a name without a proper extension is all stem."""
    pattern = r"(?s)^(.+)\.([^./]+)$"
    has = filename.rlike(pattern)
    return [
        F.when(has, F.regexp_extract(filename, pattern, 1)).otherwise(filename).alias("stem"),
        F.when(has, F.regexp_extract(filename, pattern, 2)).otherwise("").alias("ext"),
    ]


def _depth(stem: Column) -> Column:
    """How many ``-n`` suffixes a stem ends in."""
    return F.size(F.split(F.regexp_extract(stem, r"(?s)^.+?((?:-[1-9][0-9]{0,17})*)$", 1), "-")) - 1


def _assemble(stem: Column) -> Column:
    return F.when(F.col("ext") == "", stem).otherwise(F.concat(stem, F.lit("."), F.col("ext")))


def unique_names(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Give every item of (pos, filename) a destination name that is free when its turn comes.

    In order of ``pos`` an item takes its own name, or else the first free of ``stem-1.ext``, ``stem-2.ext``, ...;
    ``existing`` (name) holds the files already there. Adds ``exported_as``.

    Only a name of the form ``stem-n`` can meet the numbers handed out for ``stem``, so names are settled by how many
    such suffixes they end in, fewest first. Inside a level the duplicates of a name are numbered by rank, and the
    numbers that were taken before their turn are left out. All of it is ranking and equi-joins on unique keys: a file
    name shared by any number of items is never gathered in one task.
    """
    named = items.withColumns(dict(zip(["stem", "ext"], _name_parts(F.col("filename")))))
    named = named.select("pos", "stem", "ext", _depth(F.col("stem")).alias("depth"))
    disk = existing.select(F.col("name").alias("filename")).distinct()
    disk = disk.select(*_name_parts(F.col("filename"))).withColumn("depth", _depth(F.col("stem")))
    # Nearly all names occur once, are free and don't look like handed-out ones: they need one aggregation, no order.
    times = named.groupBy("stem", "ext").agg(F.count("*").alias("_n"), F.min("pos").alias("pos"), F.min("depth").alias("depth"))
    free = times.where((F.col("_n") == 1) & (F.col("depth") == 0)).join(disk.select("stem", "ext"), ["stem", "ext"], "left_anti")
    free = pin(free.select("pos", _assemble(F.col("stem")).alias("exported_as")))
    named = pin(named.join(free.select("pos"), "pos", "left_anti"))

    # When each name is first blocked for others: from the start if on disk, else from its first item on.
    seen = named.groupBy("stem", "ext", "depth").agg(F.min("pos").alias("p"))
    blocked = disk.withColumn("p", F.lit(-1).cast("bigint")).unionByName(seen).groupBy("stem", "ext", "depth").agg(F.min("p").alias("p"))

    results, handed_out = free, None
    deepest = named.agg(F.max("depth")).first()[0]
    for depth in range(0 if deepest is None else deepest + 1):
        rows = named.where(F.col("depth") == depth).drop("depth")
        taken = disk.where(F.col("depth") == depth).select("stem", "ext")
        if handed_out is not None:
            first = seen.where(F.col("depth") == depth).select("stem", "ext", "p")
            early = handed_out.join(first, ["stem", "ext"]).where(F.col("claim") < F.col("p")).select("stem", "ext")
            taken = taken.unionByName(early).distinct()
        taken = taken.join(rows.select("stem", "ext").distinct(), ["stem", "ext"], "left_semi")
        # A marker row ahead of the items of a taken name makes all of them duplicates.
        lined_up = rows.unionByName(taken.withColumn("pos", F.lit(-1).cast("bigint")))
        lined_up = pin(ranked(lined_up, ["stem", "ext"], [F.col("pos")], "m").where(F.col("pos") >= 0))
        own = lined_up.where(F.col("m") == 0).select("pos", _assemble(F.col("stem")).alias("exported_as"))
        again = lined_up.where(F.col("m") > 0)

        children = blocked.where(F.col("depth") == depth + 1).select(
            F.regexp_extract("stem", _NUMBERED, 1).alias("stem"), "ext", F.regexp_extract("stem", _NUMBERED, 2).cast("bigint").alias("n"), "p"
        )
        children = children.join(again.select("stem", "ext").distinct(), ["stem", "ext"], "left_semi")
        numbered = pin(_number_duplicates(again, pin(children)))
        fresh = F.concat(F.col("stem"), F.lit("-"), F.col("n").cast("string"))
        named_again = numbered.select("pos", _assemble(fresh).alias("exported_as"))
        level = own.unionByName(named_again)
        results = results.unionByName(level)
        handed_out = numbered.select(fresh.alias("stem"), "ext", F.col("pos").alias("claim"))
    return items.join(results, "pos")


def _number_duplicates(again: DataFrame, blockers: DataFrame) -> DataFrame:
    """Number the duplicates (stem, ext, m, pos; m = 1, 2, ...) with the lowest numbers free at their turn.

    ``blockers`` (stem, ext, n, p) are numbers that are taken from position p on. Which of them are met too late depends
    on how many smaller numbers were left out, so the choice is repeated until it no longer changes: every round
    settles at least the smallest unsettled number of each name, and almost always all of them.
    """
    key = ["stem", "ext"]
    if blockers.isEmpty():
        return again.withColumn("n", F.col("m"))
    probes = pin(ranked(blockers, key, [F.col("n")], "r").withColumn("out", F.lit(True)))
    turns = again.select(*key, F.col("m").alias("turn"), "pos")
    while True:
        marks = probes.withColumn("kind", F.lit(0)).unionByName(probes.where("out").withColumn("kind", F.lit(1)))
        placed = ranked(marks, key, [F.col("n"), F.col("kind")], "at").where(F.col("kind") == 0)
        reached = placed.withColumn("turn", F.col("n") - (F.col("at") - F.col("r"))).join(turns, [*key, "turn"], "left")
        settled = pin(reached.withColumn("now", F.coalesce(F.col("p") < F.col("pos"), F.lit(False))))
        stable = settled.where(F.col("now") != F.col("out")).isEmpty()
        probes = settled.select(*key, "n", "p", "r", F.col("now").alias("out"))
        if stable:
            break
    left_out = ranked(probes.where("out").select(*key, "n"), key, [F.col("n")], "at")
    line = left_out.select(*key, (F.col("n") - F.col("at")).alias("m"), F.lit(0).alias("kind"), F.col("n").alias("pos"))
    line = line.unionByName(again.select(*key, "m", F.lit(1).alias("kind"), "pos"))
    placed = ranked(line, key, [F.col("m"), F.col("kind"), F.col("pos")], "at").where(F.col("kind") == 1)
    return placed.select(*key, "m", "pos", (F.col("at") + 1).alias("n"))


# ---- outcomes and report ---------------------------------------------------------------------------------------


def export_outcomes(items: DataFrame, sources: DataFrame | None, existing: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """What a run would do with each item of the export set: copied, skipped or failed.

    ``sources`` (rel_path) lists the readable originals, ``None`` meaning that no source folder is known; ``failures``
    (rel_path, message) the copies that did not work. Only items with a source claim a name; ``exported_as`` is empty
    unless copied.
    """
    if sources is None:
        return items.withColumn("outcome", F.lit("skipped")).withColumn("exported_as", F.lit("")).withColumn("message", F.lit(""))
    # Read by the names and again by the outcomes: written once.
    items = pin(items)
    there = items.join(sources.select("rel_path").distinct(), "rel_path", "left_semi")
    if failures is None:
        failures = there.where(F.lit(False)).select("rel_path", F.lit(None).cast("string").alias("message"))
    # One row for each path that has a source, however often it failed and with or without a message.
    failed = failures.groupBy("rel_path").agg(F.max("message").alias("message")).withColumn("_failed", F.lit(True))
    failed = failed.join(sources.select("rel_path").distinct(), "rel_path", "left_semi")
    copied = pin(there.join(failed, "rel_path", "left_anti").select("pos", "filename"))
    names = unique_names(copied, existing).select("pos", "exported_as")
    return (
        items.join(names, "pos", "left")
        .join(failed, "rel_path", "left")
        .withColumn("outcome", F.when(F.col("exported_as").isNotNull(), "copied").when(F.col("_failed"), "failed").otherwise("skipped"))
        .withColumn("exported_as", F.coalesce("exported_as", F.lit("")))
        .withColumn("message", F.coalesce("message", F.lit("")))
        .drop("_failed")
    )


def export_manifest(outcomes: DataFrame) -> DataFrame:
    """The six cells of the delivered manifest; order by ``pos`` when writing."""
    return outcomes.select(
        "pos", "rel_path", "filename", "exported_as", "mark", F.col("sharpness").cast("string").alias("sharpness"), F.lit("true").alias("favourite")
    )


def write_export_manifest(outcomes: DataFrame, path: str) -> None:
    """CSV part files in export order, quoting only cells that need it."""
    rows = export_manifest(outcomes).orderBy("pos").drop("pos")
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_export_manifest_file(outcomes: DataFrame, path: str) -> int:
    """The delivered manifest as one CSV file in export order, one line for each item; returns its size."""
    cells = export_manifest(outcomes)
    return write_csv_file(cells, [c for c in cells.columns if c != "pos"], [F.col("pos")], path)


def export_report(outcomes: DataFrame) -> DataFrame:
    """Counts per outcome and the one-line summary."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    part = lambda o, text: F.when(F.col(o) > 0, F.concat(F.col(o).cast("string"), F.lit(text)))
    summary = F.concat_ws(" · ", part("copied", " copied"), part("skipped", " skipped (source not found)"), part("failed", " failed"))
    counts = outcomes.agg(n("copied"), n("skipped"), n("failed"))
    return counts.withColumn("summary", F.when(summary == "", "Nothing to export.").otherwise(summary))
