"""The registered queries: one callable (spark, sf_dir) per operator, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstselect.frames import (
    QUERY_PARAMS,
    cache_rows,
    detections,
    event_frames,
    arriving_events,
    event_stream,
    face_frames,
    frames_from,
    gray_grid,
    hashed_frames,
    protocol_lines,
    table,
    vector_hash,
)
from burstselect.functions import columns as c
from burstselect.functions import pixels
from burstselect.operators import cache, diff, export, faces, grouping, region, results, review, verdicts
from burstselect.params import SelectionParams
from burstselect.plans.ordered import chron, ranked
from burstselect.session import pin, scratch_path
from burstselect.sources import manifest, photos, progress
from burstselect.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIM_PARAMS = QUERY_PARAMS.with_(group_method="similarity")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- shared inputs ---------------------------------------------------------------------------------------------


# Grouping writes its rows to the shared folder, so every query hands it only the columns it will use.
VERDICT_COLUMNS = ("rel", "when_ts", "face_count", "eye_score", "sharpness", "exposure_flag")
MANIFEST_COLUMNS = (*VERDICT_COLUMNS, "blown", "crushed")
DOCUMENT_COLUMNS = (*MANIFEST_COLUMNS, "size_bytes")


def by_time(spark, sf, *columns) -> DataFrame:
    return grouping.time_bursts(event_frames(spark, sf).select("rel", "when_ts", *columns), QUERY_PARAMS)


def by_similarity(spark, sf, *columns) -> DataFrame:
    return grouping.similarity_bursts(hashed_frames(spark, sf).select("rel", "when_ts", "phash", *columns), QUERY_PARAMS)


def judged_by_time(spark, sf, columns=VERDICT_COLUMNS) -> DataFrame:
    return verdicts.verdicts(by_time(spark, sf, *columns[2:]), QUERY_PARAMS)


def judged_by_similarity(spark, sf, columns=VERDICT_COLUMNS) -> DataFrame:
    return verdicts.verdicts(by_similarity(spark, sf, *columns[2:]), SIM_PARAMS)


def documents(spark, sf) -> DataFrame:
    return results.frame_documents(judged_by_time(spark, sf, DOCUMENT_COLUMNS))


def favourites(spark, sf) -> DataFrame:
    return event_frames(spark, sf).where(F.col("event_type") == "purchase").select(c.frame_id("rel").alias("id"))


def _or_minus_one(n: Column) -> Column:
    """A whole number for the comparison, -1 for none."""
    return F.coalesce(n, F.lit(-1))


def _flat_box(df: DataFrame, name: str, digits: int = 9) -> DataFrame:
    return df.select("*", *[F.round(F.col(f"{name}.{a}"), digits).alias(f"box_{a}") for a in "xywh"]).drop(name)


# ---- grouping and verdicts -------------------------------------------------------------------------------------


@query
def time_bursts(spark, sf):
    return by_time(spark, sf).select("rel", "burst_id")


@query
def similarity_bursts(spark, sf):
    return by_similarity(spark, sf).select("rel", "burst_id")


@query
def verdicts_time(spark, sf):
    return judged_by_time(spark, sf).select("rel", "burst_id", "bin", "reason", "rank_in_burst")


@query
def verdicts_similarity(spark, sf):
    return judged_by_similarity(spark, sf).select("rel", "burst_id", "bin", "reason", "rank_in_burst")


@query
def burst_rank(spark, sf):
    return judged_by_time(spark, sf).select("rel", "gated", "rank_in_burst")


@query
def burst_peak(spark, sf):
    return verdicts.burst_peak(by_time(spark, sf, "sharpness"))


@query
def group_shots(spark, sf):
    return verdicts.group_shots(by_time(spark, sf, "face_count"))


@query
def group_summary(spark, sf):
    t = grouping.group_summary(by_time(spark, sf)).withColumn("method", F.lit("time"))
    return t.unionByName(grouping.group_summary(by_similarity(spark, sf)).withColumn("method", F.lit("similarity")))


@query
def bin_counts(spark, sf):
    return verdicts.bin_counts(judged_by_time(spark, sf))


@query
def top_keepers(spark, sf):
    return verdicts.top_keepers(by_time(spark, sf, *VERDICT_COLUMNS[2:]), 2, QUERY_PARAMS).select("rel", "burst_id", "sharpness")


@query
def chronological(spark, sf):
    return ranked(event_frames(spark, sf).select("rel", "when_ts"), [], chron(), "position").select("rel", "position")


@query
def best_first(spark, sf):
    return documents(spark, sf).select("id", "burst_id", "position")


# ---- scalar columns --------------------------------------------------------------------------------------------


@query
def frame_id(spark, sf):
    return event_frames(spark, sf).select("rel", c.frame_id("rel").alias("id"), c.basename("rel").alias("filename"))


@query
def sharpness_display(spark, sf):
    f = event_frames(spark, sf)
    peak = results.result_peak(f).scalar()
    return f.select("rel", c.sharpness_display("sharpness", peak).alias("sharpness"))


@query
def result_peak(spark, sf):
    return results.result_peak(event_frames(spark, sf))


@query
def exposure_label(spark, sf):
    return event_frames(spark, sf).select("rel", c.exposure_label("exposure_flag", "blown", "crushed").alias("exposure"))


@query
def eyes_percent(spark, sf):
    return event_frames(spark, sf).select("rel", _or_minus_one(c.eyes_percent("eye_score")).alias("eyes"))


@query
def timecode(spark, sf):
    return event_frames(spark, sf).select(
        "rel", c.timecode("when_ts").alias("time"), F.coalesce(c.iso_time("when_ts"), F.lit("")).alias("when_iso")
    )


@query
def burst_key(spark, sf):
    t = by_time(spark, sf).select("rel", c.burst_key(F.lit("time"), F.col("burst_id")).alias("key"))
    return t.unionByName(by_similarity(spark, sf).select("rel", c.burst_key(F.lit("similarity"), F.col("burst_id")).alias("key")))


@query
def eye_gate(spark, sf):
    return event_frames(spark, sf).select("rel", c.eye_gate_fails("eye_score", QUERY_PARAMS.open_gate).alias("fails"))


@query
def annotate(spark, sf):
    return event_frames(spark, sf).select("rel", c.annotate(F.col("event_type"), F.col("exposure_flag")).alias("reason"))


@query
def slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", c.slug("text").alias("slug"))


@query
def display_columns(spark, sf):
    return review.display_columns(documents(spark, sf))


@query
def size_and_clock_text(spark, sf):
    f = event_frames(spark, sf)
    scaled = F.col("size_bytes") * 997 - 2000000
    return f.select(
        "rel",
        c.human_size(scaled).alias("size"),
        c.grouped_int(scaled).alias("grouped"),
        c.clock(F.col("sharpness") * 7.0).alias("clock"),
    )


@query
def progress_metrics(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("done"), F.col("value").alias("elapsed"))
    m = progress.with_progress_metrics(e.withColumn("total", F.lit(90).cast("bigint")))
    return m.select("event_id", F.round("fraction", 9).alias("fraction"), "percent", "remaining")


@query
def crop_box(spark, sf):
    boxes = faces.foreground_faces(detections(spark, sf), QUERY_PARAMS)
    return boxes.select("rel", "face_no", c.crop_box(F.lit(853), F.lit(1280), F.col("box")).alias("r")).select("rel", "face_no", "r.*")


@query
def box_text(spark, sf):
    """Boxes to text and back, with damaged texts mixed in."""
    b = detections(spark, sf).select(
        "rel", "face_no", c.box_encode(c.box(F.col("x") / 1280.0, F.col("y") / 853.0, F.col("w") / 1280.0, F.col("h") / 853.0)).alias("text")
    )
    damaged = (
        F.when(F.col("rel").contains("/u1"), F.concat("text", F.lit(";1")))
        .when(F.col("rel").contains("/u2"), F.replace("text", F.lit("0."), F.lit("x")))
        .otherwise(F.col("text"))
    )
    back = b.withColumn("box", c.box_decode(damaged))
    return back.select("rel", "face_no", "text", *[F.col(f"box.{a}").alias(f"box_{a}") for a in "xywh"])


@query
def threshold_map(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        c.sim_distance(v / 4.0).alias("distance"),
        F.round(c.likeness(F.floor(v)), 9).alias("likeness"),
        c.blown_value(v / 300.0).alias("blown_value"),
        F.round(c.blown_limit(F.floor(v)), 9).alias("blown_limit"),
    )


@query
def capture_time(spark, sf):
    """Capture times from tag strings built of the event times, damaged ones among them."""
    e = event_frames(spark, sf).withColumn("ts", F.coalesce("when_ts", F.lit("2024-02-29 23:59:59").cast("timestamp_ntz")))
    text = F.col("ts").cast("string")
    tag = F.concat(F.translate(F.substring(text, 1, 10), "-", ":"), F.lit(" "), F.substring(text, 12, 8))
    k = F.col("k")
    dto = (
        F.when(k < 5, "0000:00:00 00:00:00").when(k < 8, "not a date").when(k < 10, F.lit(None).cast("string"))
        .when(k < 20, F.concat(F.lit("  "), tag, F.lit(" "))).when(k < 22, F.concat(F.substring(tag, 1, 5), F.lit("13:40 10:00:00"))).otherwise(tag)
    )
    digits = F.lpad((F.col("event_id") * 7919 % 1000000).cast("string"), 6, "0")
    sub = F.when(k < 30, digits).when(k < 40, "x1").when(k < 50, "").when(k < 60, F.lit(None).cast("string")).otherwise(F.substring(digits, 1, 2))
    return e.select("rel", c.capture_time(dto, sub).alias("t")).select(
        "rel", F.coalesce(c.iso_time("t.when_ts"), F.lit("")).alias("when_iso"), "t.has_subsec"
    )


@query
def csv_cells(spark, sf):
    return table(spark, sf, "documents").select("doc_id", c.csv_escape("text").alias("cell"))


@query
def hamming(spark, sf):
    h = table(spark, sf, "embeddings").select("vec_id", vector_hash(F.col("embedding")).alias("phash"))
    after = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("phash").alias("next_hash"))
    return h.join(after, "vec_id").select("vec_id", "phash", c.hamming(F.col("phash"), F.col("next_hash")).alias("distance"))


# ---- faces and regions -----------------------------------------------------------------------------------------


@query
def detections_default(spark, sf):
    return faces.detections_default(detections(spark, sf)).select("rel", "face_no", "open_prob")


@query
def foreground_faces(spark, sf):
    return _flat_box(faces.foreground_faces(detections(spark, sf), QUERY_PARAMS), "box").withColumn("area", F.round("area", 9))


@query
def primary_box(spark, sf):
    return _flat_box(faces.primary_box(faces.foreground_faces(detections(spark, sf), QUERY_PARAMS)), "primary_box")


@query
def eye_open_fraction(spark, sf):
    found = faces.foreground_faces(detections(spark, sf), QUERY_PARAMS)
    return faces.eye_open_fraction(found, QUERY_PARAMS).withColumn("eye_score", F.round("eye_score", 9))


@query
def locked_region(spark, sf):
    grouped = grouping.time_bursts(face_frames(spark, sf).select("rel", "when_ts", "primary_box"), QUERY_PARAMS)
    return _flat_box(region.locked_region(grouped), "region")


@query
def subject_region_time(spark, sf):
    grouped = grouping.time_bursts(face_frames(spark, sf).select("rel", "when_ts", "primary_box"), QUERY_PARAMS)
    return _flat_box(region.subject_region(grouped, QUERY_PARAMS).select("rel", "region"), "region")


@query
def subject_region_similarity(spark, sf):
    return _flat_box(region.subject_region(face_frames(spark, sf), SIM_PARAMS).select("rel", "region"), "region")


# ---- pixels ----------------------------------------------------------------------------------------------------

GRID_PARAMS = SelectionParams(blown_value=200, crushed_value=60, phash_size=7)


@query
def exposure_fractions(spark, sf):
    m = pixels.measure_pixels(gray_grid(spark, sf), "vec_id", GRID_PARAMS)
    return m.select("vec_id", "exposure_flag", "blown", "crushed")


@query
def laplacian_variance(spark, sf):
    grid = gray_grid(spark, sf).withColumn("region", F.when(F.col("vec_id") < 0, c.center_box()))
    return pixels.measure_sharpness(grid, "vec_id").withColumn("sharpness", F.round("sharpness", 6))


@query
def laplacian_variance_center(spark, sf):
    grid = gray_grid(spark, sf).withColumn("region", c.center_box())
    return pixels.measure_sharpness(grid, "vec_id").withColumn("sharpness", F.round("sharpness", 6))


@query
def laplacian_tiles(spark, sf):
    """The same from tiles of three by three pixels, the last ones smaller."""
    grid = gray_grid(spark, sf).withColumn("region", c.center_box())
    return pixels.sharpness_by_tiles(grid, "vec_id", tile=3).withColumn("sharpness", F.round("sharpness", 6))


@query
def dhash(spark, sf):
    """Hash of the whole image: its eight rows are shrunk to seven, its eight columns give seven comparisons."""
    return pixels.measure_pixels(gray_grid(spark, sf), "vec_id", GRID_PARAMS).select("vec_id", "phash")


@query
def tone_histogram(spark, sf):
    """Histogram of an image whose green falls and whose blue cycles as red rises."""
    return pixels.tone_histogram(_rgb_grid(spark, sf), "vec_id")


@query
def histogram_peaks(spark, sf):
    return pixels.histogram_peaks(pixels.tone_histogram(_rgb_grid(spark, sf), "vec_id"), "vec_id")


def _rgb_grid(spark, sf) -> DataFrame:
    value = lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.6) * 212.0).cast("int")))
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    pixel = lambda e: F.concat(byte(value(e)), byte(255 - value(e)), byte(value(e) * 7 % 256))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(F.transform("embedding", pixel), "")).alias("rgb")
    )


# ---- manifest --------------------------------------------------------------------------------------------------


@query
def manifest_cells(spark, sf):
    return manifest.manifest_cells(judged_by_time(spark, sf, MANIFEST_COLUMNS))


@query
def manifest_read(spark, sf):
    """Cells written as CSV into the shared folder and read back as typed rows."""
    path = scratch_path(spark, "manifest")
    manifest.write_manifest(judged_by_time(spark, sf, MANIFEST_COLUMNS), path)
    return manifest.read_manifest(spark, path)


@query
def manifest_parse(spark, sf):
    """Forgiving parse of cells damaged in every column."""
    f = event_frames(spark, sf)
    k = F.col("k")
    text = lambda name: F.col(name).cast("string")
    return manifest.parse_manifest(
        f.select(
            "rel",
            F.when(k < 50, "").otherwise(c.basename("rel")).alias("filename"),
            F.when(k < 10, "x").when(k < 20, " 7 ").otherwise(text("event_id")).alias("burst_id"),
            F.when(k >= 10, "2024-01-01T00:00:00").alias("when_iso"),
            F.when(k < 30, "1.5").otherwise(text("face_count")).alias("face_count"),
            F.when(F.col("eye_score").isNull(), "").otherwise(text("eye_score")).alias("eye_score"),
            F.when(k < 15, "").when(k < 25, "n/a").otherwise(text("sharpness")).alias("sharpness"),
            F.when(k < 20, "1").when(k < 40, "True").when(k < 60, "true").when(k < 80, "0").otherwise("yes").alias("exposure_flag"),
            F.lit("0.5").alias("blown_frac"),
            F.when(k < 90, "bad").otherwise("0.25").alias("crushed_frac"),
            F.col("event_type").alias("bin"),
            F.when(k < 5, F.lit(None).cast("string")).otherwise("because").alias("reason"),
            F.when(k < 50, "-1").otherwise("").alias("rank_in_burst"),
        )
    )


@query
def manifest_diff(spark, sf):
    """Time manifest against similarity manifest; frames of two event kinds have another path on one side each."""
    columns = (*MANIFEST_COLUMNS, "event_type")
    moved = lambda kind: F.when(F.col("event_type") == kind, F.concat(F.lit("moved/"), F.col("rel"))).otherwise(F.col("rel"))
    a = manifest.manifest_rows(judged_by_time(spark, sf, columns).withColumn("rel", moved("signup")))
    b = manifest.manifest_rows(judged_by_similarity(spark, sf, columns).withColumn("rel", moved("error")))
    d = diff.manifest_diff(a, b)
    return d.withColumns({n: F.coalesce(n, F.lit("")) for n in ("expected", "actual")})


# ---- cache -----------------------------------------------------------------------------------------------------


def _time_cache(spark, sf) -> DataFrame:
    return cache.cache_latest(cache_rows(spark, sf)).where(F.col("tag") == "300.0").drop("tag")


@query
def cache_latest(spark, sf):
    return cache.cache_latest(cache_rows(spark, sf))


@query
def cache_load(spark, sf):
    """Two runs appended to a cache table, one of its tags loaded."""
    path = scratch_path(spark, "cache")
    rows = cache_rows(spark, sf)
    for batch in (1, 2, 3):
        part = rows.where(F.col("written_at") == batch)
        cache.cache_append(part.drop("tag", "written_at"), path, "sim" if batch == 3 else "300.0")
    return cache.cache_load(spark, path, "300.0")


@query
def cache_fill(spark, sf):
    filled = cache.cache_fill(event_frames(spark, sf), _time_cache(spark, sf))
    return filled.select("rel", "cached", "sharpness", "eye_score")


@query
def needs_measure(spark, sf):
    return cache.needs_measure(event_frames(spark, sf), _time_cache(spark, sf)).select("rel")


@query
def merge_measurements(spark, sf):
    """Cached frames keep the cached sharpness, the others get the fresh one."""
    f, known = event_frames(spark, sf), _time_cache(spark, sf)
    kept = cache.cache_fill(f, known).where("cached").select("rel", "sharpness")
    return cache.merge_measurements(kept, cache.needs_measure(f, known).select("rel", "sharpness"))


@query
def cache_stats(spark, sf):
    return cache.cache_stats(cache.cache_fill(event_frames(spark, sf), _time_cache(spark, sf)))


@query
def sharpness_work(spark, sf):
    """Uncached frames with the region of their burst, the boxes of cached frames included."""
    grouped = grouping.time_bursts(face_frames(spark, sf).select("rel", "when_ts", "primary_box"), QUERY_PARAMS)
    fresh = cache.needs_measure(event_frames(spark, sf), _time_cache(spark, sf)).select("rel", F.lit(False).alias("cached"))
    regioned = region.with_locked_region(grouped).join(fresh, "rel", "left").withColumn("cached", F.coalesce("cached", F.lit(True)))
    return _flat_box(cache.sharpness_work(regioned), "region")


# ---- results ---------------------------------------------------------------------------------------------------


@query
def frame_documents(spark, sf):
    docs = documents(spark, sf).withColumn("eyes", _or_minus_one(F.col("eyes")))
    return docs.select("burst_id", "position", *results.FRAME_DOC)


@query
def result_document(spark, sf):
    """The document of the similarity grouping, piece by piece."""
    return results.result_document(judged_by_similarity(spark, sf, DOCUMENT_COLUMNS), "similarity")


@query
def burst_document(spark, sf):
    t = results.burst_labels(results.burst_table(judged_by_time(spark, sf)))
    return t.select("burst_id", "label", "time", "faces", "keeper_id", "n_frames")


@query
def burst_labels(spark, sf):
    t = results.burst_labels(results.burst_table(judged_by_similarity(spark, sf)))
    return t.select("burst_id", "label")


@query
def burst_has_faces(spark, sf):
    return results.burst_has_faces(by_time(spark, sf, "face_count"))


@query
def burst_time(spark, sf):
    return results.burst_time(by_time(spark, sf))


@query
def progress_sequence(spark, sf):
    return results.progress_sequence(judged_by_time(spark, sf))


@query
def progress_lines(spark, sf):
    """Our own lines, read back the way an application does."""
    routed = progress.route_events(results.progress_lines(judged_by_time(spark, sf)))
    return routed.select("kind", "progress.*")


# ---- review ----------------------------------------------------------------------------------------------------


@query
def mark_filter(spark, sf):
    kept = review.mark_filter(judged_by_time(spark, sf), "keeper")
    return kept.select("burst_id", "rel")


@query
def visible_frames(spark, sf):
    return review.visible_frames(documents(spark, sf), "maybe").select("burst_id", "id", "shown_at")


@query
def mark_counts(spark, sf):
    return review.mark_counts(judged_by_time(spark, sf))


@query
def mark_counts_wide(spark, sf):
    return review.mark_counts_wide(judged_by_similarity(spark, sf))


@query
def best_count(spark, sf):
    return review.best_count(judged_by_time(spark, sf))


@query
def staging_plan(spark, sf):
    """All bins, with few distinct file names so that destinations collide."""
    return review.staging_plan(_colliding_manifest(spark, sf), ("keeper", "maybe", "rejected"))


@query
def staging_counts(spark, sf):
    return review.staging_counts(_colliding_manifest(spark, sf))


def _colliding_manifest(spark, sf) -> DataFrame:
    rows = manifest.manifest_rows(judged_by_time(spark, sf, MANIFEST_COLUMNS))
    return rows.withColumn("filename", F.concat(F.lit("IMG_"), F.substring("filename", 12, 1), F.lit(".JPG")))


@query
def contact_order(spark, sf):
    return review.contact_cards(judged_by_time(spark, sf)).select("burst_id", "rel", "place")


@query
def contact_sheet(spark, sf):
    sheet = review.contact_sheet(judged_by_time(spark, sf))
    return sheet.select("burst_id", "frames", "keepers", "maybes", "rejects", "when_iso", "place", "filename", "bin")


@query
def contact_totals(spark, sf):
    return review.contact_totals(judged_by_time(spark, sf))


@query
def frame_step(spark, sf):
    return review.frame_step(documents(spark, sf))


@query
def burst_step(spark, sf):
    return review.burst_step(documents(spark, sf), "rejected")


@query
def keeper_lookup(spark, sf):
    judged = pin(judged_by_time(spark, sf, DOCUMENT_COLUMNS))
    found = review.keeper_lookup(results.burst_table(judged), results.frame_documents(judged))
    return found.select("burst_id", "filename", "mark", "sharpness")


@query
def compare_groupings(spark, sf):
    compared = review.compare_groupings(judged_by_time(spark, sf), judged_by_similarity(spark, sf))
    return compared.where("differs").select("id", "rel", "left_burst", "left_bin", "right_burst", "right_bin")


@query
def compare_summary(spark, sf):
    return review.compare_summary(review.compare_groupings(judged_by_time(spark, sf), judged_by_similarity(spark, sf)))


# ---- export ----------------------------------------------------------------------------------------------------


@query
def export_set(spark, sf):
    return export.export_set(documents(spark, sf), favourites(spark, sf)).select("pos", "id", "filename")


@query
def export_size(spark, sf):
    return export.export_size(documents(spark, sf), favourites(spark, sf))


@query
def unique_names(spark, sf):
    """Every frame delivered under one of fifty camera names."""
    items = event_frames(spark, sf).select(
        F.col("event_id").alias("pos"), F.concat(F.lit("IMG_"), (F.col("event_id") % 50).cast("string"), F.lit(".JPG")).alias("filename")
    )
    disk = table(spark, sf, "nation").select(F.concat(F.lit("IMG_"), F.col("n_nationkey").cast("string"), F.lit(".JPG")).alias("name"))
    return export.unique_names(items, disk)


def _outcomes(spark, sf) -> DataFrame:
    f = event_frames(spark, sf).withColumnRenamed("rel", "rel_path")
    return export.export_outcomes(
        export.export_set(documents(spark, sf), favourites(spark, sf)),
        f.where(F.col("k") >= 20).select("rel_path"),
        f.where(F.col("k") >= 80).select(c.basename("rel_path").alias("name")),
        f.where(F.col("k").between(30, 34)).select("rel_path", F.lit("disk full").alias("message")),
    )


@query
def export_outcomes(spark, sf):
    return _outcomes(spark, sf).select("pos", "rel_path", "outcome", "exported_as", "message")


@query
def export_manifest(spark, sf):
    return export.export_manifest(_outcomes(spark, sf))


@query
def export_report(spark, sf):
    return export.export_report(_outcomes(spark, sf))


# ---- sources ---------------------------------------------------------------------------------------------------


@query
def source_stats(spark, sf):
    """Statistics of a folder listing in which one kind of file is no image."""
    ext = F.create_map(*[F.lit(x) for x in ("view", "JPG", "click", "cr3", "purchase", "heic", "signup", "txt", "error", "jpeg")])
    f = event_frames(spark, sf).withColumn("rel", F.concat(F.replace("rel", F.lit("JPG"), F.lit("")), ext[F.col("event_type")]))
    return photos.source_stats(f)


@query
def route_events(spark, sf):
    routed = progress.route_events(protocol_lines(table(spark, sf, "events")))
    return routed.select("event_id", "kind", _or_minus_one(F.when(F.col("kind") == "progress", F.col("progress.done"))).alias("done"))


# ---- streaming -------------------------------------------------------------------------------------------------


@query
def progress_stream(spark, sf):
    out = scratch_path(spark, "progress")
    state = live.progress_state(protocol_lines(event_stream(spark, sf)))
    live.run_available(state, "complete", live.replace_at(out))
    state = live.read_batches(spark, out, newest_only=True).withColumn("phase", F.coalesce("phase", F.lit("")))
    return state.select("run", "done", "total", "current_frame_name", "phase", "events")


LIVE_PARAMS = QUERY_PARAMS.with_(gap_seconds=6 * 3600.0)


@query
def live_time_bursts(spark, sf):
    """What the stream emitted as its files came, one of them after the other and some frames late, and what it holds open at its end."""
    out, checkpoint = scratch_path(spark, "bursts"), scratch_path(spark, "burst-state")
    events, delay = arriving_events(spark, sf)
    live.run_available(live.live_time_bursts(frames_from(events), LIVE_PARAMS, "user_id", delay), "append", live.append_to(out), checkpoint)
    return _burst_rows(live.read_batches(spark, out).unionByName(live.open_bursts(spark, checkpoint, "user_id")))


@query
def batch_time_bursts(spark, sf):
    return _burst_rows(live.batch_time_bursts(event_frames(spark, sf), LIVE_PARAMS, "user_id"))


def _burst_rows(bursts: DataFrame) -> DataFrame:
    iso = {n: F.coalesce(c.iso_time(n), F.lit("")) for n in ("first_when", "last_when")}
    return bursts.withColumns(iso).select("user_id", "frames", "first_when", "last_when", "peak", "candidate")


@query
def incremental_measure(spark, sf):
    """Frames measured as they arrive, on top of a cache that holds some of them."""
    path = scratch_path(spark, "live-cache")
    known = cache_rows(spark, sf).where((F.col("tag") == "300.0") & (F.col("written_at") == 1))
    cache.cache_append(known.drop("tag", "written_at"), path, "300.0")
    stream = frames_from(arriving_events(spark, sf, repeated=True)[0])
    live.incremental_measure(stream, path, "300.0", lambda f: f.withColumn("sharpness", F.col("sharpness") * 2).select("rel", "mtime", "size_bytes", "sharpness", "eye_score"))
    return cache.cache_load(spark, path, "300.0")
