"""The frames table and its companions, derived from the driver tables.

One event is one frame: its time, value and properties stand for the capture time and the measurements of a photo, and
the vectors of ``embeddings`` stand for the thumbnails that the perceptual hash is taken from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstselect.functions.columns import exposure_flagged
from burstselect.operators.faces import with_faces
from burstselect.params import SelectionParams
from burstselect.session import scratch_path

# Parameters of the registered queries: the event table has one event every few minutes.
QUERY_PARAMS = SelectionParams(gap_seconds=300.0, sim_max_distance=30, sim_time_ceiling=900.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_hash(vector: Column) -> Column:
    """Difference hash of a 64-value vector: one bit per neighbouring pair, set where the right value is larger."""
    bit = lambda i: F.when(F.get(vector, i) > F.get(vector, i - 1), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, i: F.shiftleft(acc, 1) + bit(i))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a hash: everything but similarity grouping reads these."""
    return frames_from(table(spark, sf_dir, "events"))


def frames_from(e: DataFrame) -> DataFrame:
    """Frames from a table or a stream of events."""
    # A column of its own: the text is parsed once for each row, not for each use.
    e, k = e.withColumn("k", F.get_json_object("props", "$.k").cast("int")), F.col("k")
    faces = k % 4
    out = e.select(
        F.concat(F.lit("DCIM/u"), F.col("user_id"), F.lit("/DSC_"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".JPG")).alias("rel"),
        F.when(k != 97, F.col("ts")).alias("when_ts"),
        (F.col("event_id") * 1000 + 1024).alias("size_bytes"),
        (F.col("event_id").cast("double") + 0.25).alias("mtime"),
        faces.alias("face_count"),
        F.when(faces != 0, (F.col("event_id") * 37 % 101).cast("double") / 100.0).alias("eye_score"),
        F.col("value").alias("sharpness"),
        ((F.col("event_id") * 13 % 100).cast("double") / 400.0).alias("blown"),
        ((F.col("event_id") * 29 % 100).cast("double") / 300.0).alias("crushed"),
        F.col("event_id"),
        F.col("user_id"),
        F.col("event_type"),
        k,
    )
    return out.withColumn("exposure_flag", exposure_flagged("blown", "crushed", QUERY_PARAMS))


def hashed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a 63-bit hash; three consecutive events share one thumbnail."""
    thumbs = table(spark, sf_dir, "embeddings").select("vec_id", vector_hash(F.col("embedding")).alias("phash"))
    n = table(spark, sf_dir, "embeddings").count()
    frames = event_frames(spark, sf_dir).withColumn("vec_id", F.floor(F.col("event_id") / 3) % n)
    return frames.join(thumbs, "vec_id").drop("vec_id")


def gray_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8x8 gray image: ``vec_id``, ``height``, ``width`` and the pixels row by row as bytes."""
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.6) * 212.0).cast("int")))
    hexed = F.transform("embedding", lambda e: F.lpad(F.hex(value(e)), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(hexed, "")).alias("gray")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw face detections: ``face_count`` pixel boxes per frame, sizes derived from the event."""
    f = event_frames(spark, sf_dir).where(F.col("face_count") > 0)
    f = f.withColumn("face_no", F.explode(F.sequence(F.lit(1), F.col("face_count"))))
    side = lambda m: (F.col("event_id") * m + F.col("face_no") * 17) % 300 + 20
    return f.select(
        "rel",
        "face_no",
        ((F.col("event_id") * 7 + F.col("face_no") * 31) % 800).alias("x"),
        ((F.col("event_id") * 11 + F.col("face_no") * 13) % 500).alias("y"),
        side(3).alias("w"),
        side(5).alias("h"),
        F.lit(1280).alias("frame_w"),
        F.lit(853).alias("frame_h"),
        (F.lit(0.5) + (F.col("event_id") * 23 + F.col("face_no") * 7) % 100 / 200.0).alias("confidence"),
        F.when(F.col("k") % 10 != 3, (F.col("event_id") * 19 + F.col("face_no") * 41) % 100 / 100.0).alias("open_prob"),
    )


def face_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose face measurements come from the detections."""
    bare = event_frames(spark, sf_dir).drop("face_count", "eye_score")
    return with_faces(bare, detections(spark, sf_dir), QUERY_PARAMS)


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only cache: three kinds of frames measured, one kind twice, one kind for an older file."""
    f = event_frames(spark, sf_dir)
    base = f.select("rel", "mtime", "size_bytes", "event_type", "sharpness", "eye_score")
    first = base.where(F.col("event_type").isin("view", "click", "purchase")).withColumn("written_at", F.lit(1).cast("bigint"))
    first = first.withColumn("mtime", F.when(F.col("event_type") == "purchase", F.col("mtime") - 1.0).otherwise(F.col("mtime")))
    again = base.where(F.col("event_type") == "click").withColumn("sharpness", F.col("sharpness") + 1.0)
    again = again.withColumn("written_at", F.lit(2).cast("bigint"))
    other = base.where(F.col("event_type") == "view").withColumn("sharpness", F.lit(0.0)).withColumn("written_at", F.lit(3).cast("bigint"))
    mine = first.unionByName(again).withColumn("tag", F.lit("300.0"))
    return mine.unionByName(other.withColumn("tag", F.lit("sim"))).drop("event_type")


def protocol_lines(events: DataFrame) -> DataFrame:
    """Protocol lines (run, event_id, value) from a table or stream of events: progress, results, noise and errors."""
    k = F.get_json_object("props", "$.k").cast("int")
    i = F.col("event_id").cast("string")
    head = F.concat(F.lit('{"done": '), i, F.lit(', "total": 1000000, "current_frame_name": "DSC_'), i, F.lit('.JPG", "current_burst_label": ""'))
    line = (
        F.when(F.col("event_type") == "view", F.concat(head, F.lit(', "phase": "scoring"}')))
        .when(F.col("event_type") == "click", F.concat(head, F.lit("}")))
        .when((F.col("event_type") == "purchase") & (k < 90), F.lit('{"grouping": "time", "bursts": []}'))
        .when(F.col("event_type") == "purchase", F.lit('{"grouping": "colour", "bursts": []}'))
        .when((F.col("event_type") == "signup") & (k < 50), F.concat(F.lit('{"note": "'), i, F.lit('"}')))
        .when(F.col("event_type") == "signup", F.concat(F.lit("worker "), i, F.lit(" started")))
        .when(k < 50, F.lit('{"done": null, "total": 3}'))
        .otherwise(F.lit('["done", "grouping"]'))
    )
    return events.select(F.col("user_id").alias("run"), "event_id", line.alias("value"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream source."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


ARRIVALS = 5
# Rows of one file of an arrival.
ARRIVAL_ROWS = 250_000


def arriving_events(spark: SparkSession, sf_dir: str, repeated: bool = False) -> tuple[DataFrame, str]:
    """The events as a stream of several arrivals, one for each micro-batch, and how late a row may be.

    An arrival holds a stretch of time. A twentieth of its rows come late, with the next one; if ``repeated``, they come with both.
    All arrivals are written as the same number of files, which is what a micro-batch takes.
    """
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    seconds = int((high - low).total_seconds() // ARRIVALS) + 1
    stretch = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))) / (seconds * 1_000_000)).cast("int")
    parts = events.withColumn("_stretch", F.coalesce(stretch, F.lit(0))).withColumn("_late", F.pmod("event_id", F.lit(20)) == 0)
    counts = [0] * (ARRIVALS + 1)
    for r in parts.groupBy("_stretch", "_late").agg(F.count("*").alias("n")).collect():
        if repeated or not r["_late"]:
            counts[r["_stretch"]] += r["n"]
        if r["_late"]:
            counts[r["_stretch"] + 1] += r["n"]
    # Rows are dealt in turn by each task, so no file is empty (and left out) if one of the tasks has a row for each.
    files = max(1, min(-(-max(counts) // ARRIVAL_ROWS), min(counts) // max(1, events.rdd.getNumPartitions())))
    path = scratch_path(spark, "arrivals")
    for i in range(ARRIVALS + 1):
        now = (F.col("_stretch") == i) if repeated else (F.col("_stretch") == i) & ~F.col("_late")
        before = (F.col("_stretch") == i - 1) & F.col("_late")
        rows = parts.where(now | before).drop("_stretch", "_late")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.parquet(f"{path}/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    return stream, f"{seconds} seconds"
