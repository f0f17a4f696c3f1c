"""The resumable measurement cache: an append-only Parquet table, one folder for each run, partitioned by tag and part of the paths.

A frame's key is (rel, mtime, size_bytes). Rows are only ever appended; the last run that wrote a key wins. A log beside the rows gives each
run a number of its own and tells which runs are whole (`burstselect.operators.commits`), so several writers, readers and a compaction may work
at the same moment. ``ran`` is the run that measured a row; compaction keeps it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from burstselect.functions.columns import box_decode
from burstselect.operators.commits import Snapshot, claim, finish, snapshot

KEY = ["rel", "mtime", "size_bytes"]
MEASURES = ["face_count", "primary_box", "eye_score", "sharpness", "exposure_flag", "blown", "crushed", "phash"]
PARTS = 64


def _measures(df: DataFrame) -> list[str]:
    return [c for c in MEASURES if c in df.columns]


def cache_part(rel: str) -> Column:
    """The part of the cache in which a path is kept."""
    return F.pmod(F.xxhash64(rel), F.lit(PARTS)).cast("int")


def cache_append(measured: DataFrame, path: str, tag: str, resume: bool = True) -> int:
    """Append the measurements of one run and return its number; with ``resume=False`` all runs before it are void once it is whole.

    A run that fails leaves the cache as it was. Runs that append at the same moment have different numbers, and the larger one counts as the later.
    """
    run = claim(measured.sparkSession, path)
    rows = measured.select(*KEY, *_measures(measured), F.lit(tag).alias("tag"), cache_part("rel").alias("part"), F.lit(run).cast("bigint").alias("ran"))
    _write(rows, path, run)
    finish(measured.sparkSession, path, run, "done" if resume else "fresh")
    return run


def _write(rows: DataFrame, path: str, run: int) -> None:
    """A run into its own folder, so that no other writer shares its temporary files; one file for each tag and part, tasks by the size of the run."""
    rows.repartition("tag", "part").write.mode("overwrite").partitionBy("tag", "part").parquet(f"{path}/written_at={run}")


def _table(spark: SparkSession, path: str, seen: Snapshot | None = None) -> DataFrame | None:
    """The whole runs of the cache as a table, or None where nothing was written yet."""
    seen = seen or snapshot(spark, path)
    if not seen.runs:
        return None
    reader = lambda: spark.read.option("basePath", path)
    folders = [f"{path}/written_at={n}" for n in seen.runs]
    try:
        found = reader().parquet(*folders).schema
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # runs without a row
            return None
        raise
    # Partition values are read as text by name: a gap such as "2.0" must not turn into a number.
    kinds = {"tag": StringType(), "part": IntegerType(), "written_at": LongType()}
    table = reader().schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])).parquet(*folders)
    # What counts as the time of writing is the run that measured a row, wherever it is kept now.
    return table.where(F.col("ran") >= seen.floor).drop("written_at").withColumnRenamed("ran", "written_at")


def cache_latest(cache: DataFrame, *carry: str) -> DataFrame:
    """The last written row per key and tag; one aggregation with partial maxima, so a key may repeat at will. ``carry``: further columns to keep.

    Rows of one run with the same key are told apart by their values, so the result never depends on their order.
    """
    row = F.struct(*_measures(cache))
    last = F.max_by(F.struct(*_measures(cache), *carry), F.struct(F.col("written_at"), row))
    return cache.groupBy("tag", *KEY).agg(last.alias("_m")).select("tag", *KEY, "_m.*")


def _part_of(spark: SparkSession, path: str, tag: str, parts: Sequence[int] | None) -> DataFrame | None:
    table = _table(spark, path)
    if table is None:
        return None
    mine = table.where(F.col("tag") == tag)
    return mine if parts is None else mine.where(F.col("part").isin(list(parts)))


def cache_load(spark: SparkSession, path: str, tag: str, parts: Sequence[int] | None = None) -> DataFrame:
    """Current rows of one tag; tags and parts are partitions, so others are not read."""
    found = _part_of(spark, path, tag, parts)
    if found is None:
        raise FileNotFoundError(path)
    return cache_latest(found).drop("tag")


def cache_keys(spark: SparkSession, path: str, tag: str, parts: Sequence[int] | None = None) -> DataFrame | None:
    """The keys of one tag, perhaps more than once, or None without a cache: nothing but the key columns is read."""
    found = _part_of(spark, path, tag, parts)
    return None if found is None else found.select(*KEY)


def cache_compact(spark: SparkSession, path: str, target: str | None = None) -> int | None:
    """Write the current rows of all tags as one run, one file for each tag and part; returns its number.

    Without ``target`` the run takes the place of those before it in the same cache. Runs that are being written meanwhile are left out and
    stay beside it, and readers that began earlier go on with the folders they know: none is deleted. A cache without rows is left as it is.
    With ``target`` the rows begin a cache of their own, whose numbers go on from the old one's.
    """
    seen = snapshot(spark, path)
    if not seen.claimed:
        raise FileNotFoundError(path)
    home = target or path
    run = claim(spark, home, above=seen.claimed[-1] - 1 if target else 0)
    if not target:
        seen = snapshot(spark, path)
        seen = seen._replace(runs=[n for n in seen.runs if n < run], pending=[n for n in seen.pending if n < run])
    table = _table(spark, path, seen)
    if table is None:
        return None
    ran = F.lit(run).cast("bigint") if target else F.col("written_at")
    rows = cache_latest(table, "written_at").withColumns({"part": cache_part("rel"), "ran": ran}).drop("written_at")
    _write(rows, home, run)
    finish(spark, home, run, "done" if target else "base", seen.pending)
    return run


def parse_cache_rows(raw: DataFrame, tag: str) -> DataFrame:
    """Cache rows from a table of strings (a cache kept as CSV): other tags and rows with a bad key are left out.

    ``raw`` carries ``written_at``, the position of the row in its file.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(text(c).try_cast("double"), F.lit(0.0))
    whole = lambda c: F.coalesce(text(c).try_cast("bigint"), F.lit(0))
    unsigned = F.coalesce(text("phash").try_cast("decimal(20,0)"), F.lit(0))
    wrap = lambda bits: F.lit(str(2**bits)).cast("decimal(20,0)")
    signed = F.when(unsigned >= wrap(63), unsigned - wrap(64)).otherwise(unsigned).cast("bigint")
    return (
        raw.where(F.col("gap") == tag)
        .select(
            "rel",
            F.col("mtime").try_cast("double").alias("mtime"),
            F.col("size").try_cast("bigint").alias("size_bytes"),
            whole("face_count").cast("int").alias("face_count"),
            box_decode(F.col("primary_box")).alias("primary_box"),
            text("eye_score").try_cast("double").alias("eye_score"),
            number("sharpness").alias("sharpness"),
            (whole("exposure_flag") != 0).alias("exposure_flag"),
            number("blown_frac").alias("blown"),
            number("crushed_frac").alias("crushed"),
            signed.alias("phash"),
            F.col("gap").alias("tag"),
            "written_at",
        )
        .where(F.col("rel").isNotNull() & F.col("mtime").isNotNull() & F.col("size_bytes").isNotNull())
    )


def cache_fill(frames: DataFrame, cache: DataFrame) -> DataFrame:
    """Frames with their cached measurement and ``cached``; capture time always comes from the fresh scan.

    ``cache`` holds one row per key (see :func:`cache_latest`), so both sides of the join are unique on the key.
    """
    rows = cache.select(*KEY, F.struct(*_measures(cache)).alias("_m"), F.lit(True).alias("_hit"))
    bare = frames.drop(*_measures(cache))
    return (
        bare.join(rows, KEY, "left")
        .select(*bare.columns, "_m.*", F.coalesce("_hit", F.lit(False)).alias("cached"))
    )


def needs_measure(frames: DataFrame, cache: DataFrame) -> DataFrame:
    """Frames whose key is not in the cache."""
    return frames.join(cache.select(*KEY), KEY, "left_anti")


def merge_measurements(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached and freshly measured frames in one table."""
    return cached.unionByName(fresh)


def cache_stats(filled: DataFrame) -> DataFrame:
    return filled.agg(F.count_if(~F.col("cached")).alias("new"), F.count_if("cached").alias("from_cache"))


def sharpness_work(regioned: DataFrame, recompute_bursts: bool = False) -> DataFrame:
    """Which frames of partly cached time bursts need their sharpness read, with the region to read it from.

    ``regioned`` carries ``cached`` and the locked ``region``, which already counts the boxes of the cached frames. By
    default cached frames keep their stored sharpness, though the region may have moved; ``recompute_bursts`` re-reads
    every frame instead.
    """
    work = regioned if recompute_bursts else regioned.where(~F.col("cached"))
    return work.select("rel", "burst_id", "region")
