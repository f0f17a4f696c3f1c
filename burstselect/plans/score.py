"""One selection run: scanned photos in, judged frames out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.functions.columns import capture_time
from burstselect.functions.pixels import measure_files
from burstselect.operators.cache import KEY, cache_append, cache_fill
from burstselect.operators.faces import with_faces
from burstselect.operators.grouping import group_frames
from burstselect.operators.region import subject_region
from burstselect.operators.verdicts import verdicts
from burstselect.params import SelectionParams
from burstselect.session import pin

# Photos that one task opens: some seconds of work each, so that tasks are neither few nor many.
PHOTOS_PER_TASK = 16

MEASURED = ["decode_ok", "exposure_flag", "blown", "crushed", "phash", "sharpness"]


def dated(photos: DataFrame, tags: DataFrame) -> DataFrame:
    """Scanned photos with their capture time; ``tags`` (rel, taken, subsec) holds the two tag strings of each photo."""
    read = tags.select("rel", capture_time("taken", "subsec").alias("_t"))
    return photos.join(read, "rel", "left").select(
        *photos.columns, F.col("_t.when_ts").alias("when_ts"), F.coalesce("_t.has_subsec", F.lit(False)).alias("has_subsec")
    )


def spread(photos: DataFrame, per_task: int = PHOTOS_PER_TASK) -> DataFrame:
    """The photos over tasks of about ``per_task`` of them, or fewer where cores would idle. Rows are small, so left alone Spark would use one task."""
    count, cores = photos.count(), photos.sparkSession.sparkContext.defaultParallelism
    return photos.repartition(max(1, math.ceil(count / per_task), min(count, cores)))


def score(
    photos: DataFrame,
    detections: DataFrame,
    load: Callable[[str], np.ndarray | None],
    params: SelectionParams = SelectionParams(),
    cache: DataFrame | None = None,
) -> DataFrame:
    """Judge the photos (rel, path, mtime, size_bytes, when_ts).

    Time grouping needs no pixels: bursts and their locked regions are known before the first photo is opened.
    Similarity grouping measures first and groups on the hashes. Either way a photo is opened once, and only if
    ``cache`` (one row per key, from an earlier run with the same parameters) does not know it. The boxes of known
    photos count in the locked region of their burst, and known photos keep their stored sharpness.
    """
    frames = with_faces(photos, detections, params)
    by_time = params.group_method != "similarity"
    if by_time:
        frames = group_frames(frames, params)
    frames = subject_region(frames, params)
    if cache is not None:
        stored = cache.select(*KEY, F.struct(*[c for c in MEASURED if c in cache.columns]).alias("_known"))
        frames = frames.join(stored, KEY, "left")
        unknown = frames.where(F.col("_known").isNull())
    else:
        unknown = frames
    fresh = pin(measure_files(spread(unknown), load, params))
    measured = unknown.join(fresh, "rel")
    if cache is not None:
        kept = frames.where(F.col("_known").isNotNull())
        value = lambda c: F.col(f"_known.{c}") if c in cache.columns else F.lit(True)
        known = kept.withColumns({c: value(c) for c in MEASURED})
        measured = measured.unionByName(known).drop("_known")
    # A photo that cannot be read has no faces either.
    unread = ~F.col("decode_ok")
    measured = measured.withColumns(
        dict(
            face_count=F.when(unread, F.lit(0)).otherwise(F.col("face_count")),
            eye_score=F.when(~unread, F.col("eye_score")),
            primary_box=F.when(~unread, F.col("primary_box")),
        )
    ).drop("region")
    return verdicts(measured if by_time else group_frames(measured, params), params)


def remember(judged: DataFrame, path: str, params: SelectionParams, resume: bool = True) -> int:
    """Append the measurements of a run to the cache, under the tag of its measuring parameters; returns the run's number."""
    return cache_append(judged, path, params.measure_tag(), resume)


def known(photos: DataFrame, cache: DataFrame) -> DataFrame:
    """Which photos a run would not open again."""
    return cache_fill(photos, cache).where("cached").select(*KEY)
