"""From raw face detections to the per-frame face measurements.

Detections come in as a table (rel, face_no, x, y, w, h, frame_w, frame_h, open_prob), produced by any detector run as a
Spark job. A frame without rows has no faces; a null ``open_prob`` means the eyes were not read. A table with the detector's
``confidence`` is cut at ``min_confidence``; without that column, or where it is null, every row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstselect.functions.columns import box
from burstselect.params import SelectionParams


def detections_default(detections: DataFrame) -> DataFrame:
    """Unread eyes count as open, which disables the eye gate for that face."""
    return detections.withColumn("open_prob", F.coalesce("open_prob", F.lit(1.0)))


def foreground_faces(detections: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Keep the faces that are large enough in absolute terms and against the largest face of the frame.

    Only the ``max_faces`` largest can survive, so that limit is applied first: Spark then drops the rest before the
    shuffle, and a frame with any number of raw detections brings at most ``max_faces`` rows per task.
    """
    if "confidence" in detections.columns:
        detections = detections.where(F.coalesce("confidence", F.lit(1.0)) >= params.min_confidence)
    frame_area = F.col("frame_w").cast("double") * F.col("frame_h")
    by_frame = W.partitionBy("rel")
    largest_first = by_frame.orderBy(F.col("_pixels").desc(), F.col("face_no"))
    floor = F.greatest(F.lit(params.min_face_frac), F.lit(params.foreground_ratio) * F.max("area").over(by_frame))
    return (
        detections_default(detections)
        .withColumn("_pixels", F.col("w").cast("double") * F.col("h"))
        .withColumn("face_rank", F.row_number().over(largest_first))
        .where(F.col("face_rank") <= params.max_faces)
        .withColumn("area", F.col("_pixels") / frame_area)
        .withColumn("_floor", floor)
        .where(F.col("area") >= F.col("_floor"))
        .withColumn(
            "box",
            box(
                F.col("x") / F.col("frame_w"), F.col("y") / F.col("frame_h"),
                F.col("w") / F.col("frame_w"), F.col("h") / F.col("frame_h"),
            ),
        )
        .select("rel", "face_rank", "face_no", "box", "area", "open_prob")
    )


def _open_fraction(params: SelectionParams):
    total = F.sum("area")
    seen = F.sum(F.col("area") * (F.col("open_prob") >= params.eye_open_min).cast("double"))
    return F.when(total > 0, F.try_divide(seen, total))


def eye_open_fraction(faces: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Share of the face area of a frame whose eyes are open."""
    return faces.groupBy("rel").agg(_open_fraction(params).alias("eye_score"))


def _largest_box():
    """The box of largest normalised area; the first of equals."""
    return F.max_by("box", F.struct(F.col("box.w") * F.col("box.h"), -F.col("face_rank")))


def primary_box(faces: DataFrame) -> DataFrame:
    return faces.groupBy("rel").agg(_largest_box().alias("primary_box"))


def face_measurements(faces: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Face count, primary box and eye score per frame in one aggregation."""
    return faces.groupBy("rel").agg(
        F.count("*").cast("int").alias("face_count"),
        _largest_box().alias("primary_box"),
        _open_fraction(params).alias("eye_score"),
    )


def with_faces(frames: DataFrame, detections: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Frames with their face measurements; frames without detections get zero faces."""
    found = face_measurements(foreground_faces(detections, params), params)
    return frames.join(found, "rel", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0)))
