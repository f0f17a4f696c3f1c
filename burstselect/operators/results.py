"""The result view of judged frames: labels, frame documents, nested burst documents, progress order.

``judged`` is the output of :func:`burstselect.operators.verdicts.verdicts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.functions.columns import basename, burst_key, exposure_label, eyes_percent, frame_id, sharpness_display, timecode
from burstselect.plans.ordered import CHUNK, SPANS, chron, join_burst_table, laid_out, numbered, rank_in_burst, ranked, with_burst_stats
from burstselect.session import pin

JUDGED = [
    "rel", "when_ts", "burst_id", "bin", "reason", "sharpness", "eye_score", "face_count", "exposure_flag", "blown", "crushed", "size_bytes"
]
FRAME_DOC = ["id", "filename", "sharpness", "eyes", "faces", "exposure", "mark", "reason", "size_bytes", "rel_path"]


def best_first() -> list[Column]:
    """Display order inside a burst: keepers, then by falling raw sharpness, then capture order."""
    return [F.col("bin") != "keeper", -F.col("sharpness"), *chron()]


def _best_key() -> Column:
    """The same order as one comparable value, for min_by."""
    return F.struct(F.col("bin") != "keeper", -F.col("sharpness"), F.col("when_ts").isNull(), F.col("when_ts"), F.col("rel"))


def _has_faces() -> Column:
    return F.bool_or(F.col("face_count") > 0)


def _first_when() -> Column:
    return F.min("when_ts")


def burst_has_faces(grouped: DataFrame) -> DataFrame:
    """Per burst, whether any frame of it has a face."""
    return grouped.groupBy("burst_id").agg(_has_faces().alias("faces"))


def burst_time(grouped: DataFrame) -> DataFrame:
    """Per burst, the time of its first dated frame as text."""
    return grouped.groupBy("burst_id").agg(_first_when().alias("_w")).select("burst_id", timecode("_w").alias("time"))


def burst_table(judged: DataFrame) -> DataFrame:
    """One row per burst: size, time, faces and the keeper (first keeper, else first frame in display order)."""
    return (
        judged.groupBy("burst_id")
        .agg(
            F.count("*").alias("n_frames"),
            _first_when().alias("first_when"),
            _has_faces().alias("faces"),
            F.min_by("rel", _best_key()).alias("keeper_rel"),
        )
        .withColumn("time", timecode("first_when"))
        .withColumn("keeper_id", frame_id("keeper_rel"))
    )


def burst_labels(bursts: DataFrame) -> DataFrame:
    """Add ``label``: the burst's time, with a running group number where several bursts share it.

    There are at most 86,401 distinct times, so their counts are broadcast; many bursts may share one of them (all
    undated ones do), so the numbering goes through the chunked ranking.
    """
    bursts = pin(bursts)
    shared = bursts.groupBy("time").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("time")
    alone = bursts.join(F.broadcast(shared), "time", "left_anti").withColumn("label", F.col("time"))
    together = ranked(bursts.join(F.broadcast(shared), "time", "left_semi"), ["time"], [F.col("burst_id")], "_no")
    numbered = F.concat(F.col("time"), F.lit(" · group "), (F.col("_no") + 1).cast("string"))
    return alone.unionByName(together.withColumn("label", numbered).drop("_no"))


def result_peak(judged: DataFrame) -> DataFrame:
    return judged.agg(F.max("sharpness").alias("peak"))


def frame_documents(judged: DataFrame) -> DataFrame:
    """Frames in the wire vocabulary, with their display ``position`` in the burst."""
    # The ranks are written, so the peak is read from there and what comes before runs once.
    placed = rank_in_burst(laid_out(judged), [], best_first(), "position")
    peak = result_peak(placed).scalar()
    return placed.select(
        "burst_id",
        "position",
        "_chunk",
        "_spans",
        frame_id("rel").alias("id"),
        basename("rel").alias("filename"),
        sharpness_display("sharpness", peak).alias("sharpness"),
        eyes_percent("eye_score").alias("eyes"),
        F.col("face_count").alias("faces"),
        exposure_label("exposure_flag", "blown", "crushed").alias("exposure"),
        F.col("bin").alias("mark"),
        "reason",
        "size_bytes",
        F.col("rel").alias("rel_path"),
    )


def result_document(judged: DataFrame, method: str) -> DataFrame:
    """The result document in pieces (burst_id, position, piece), one for each frame.

    Put together in the order of (burst_id, position) the pieces are one JSON object of ``grouping`` and ``bursts``: the first frame of
    a burst brings its header along, the last one its end, so a burst of any size is spread over as many rows as it has frames.
    """
    # Read four times below: written once, with its layout and the columns that the document needs.
    judged = pin(laid_out(judged).select(*JUDGED, CHUNK, SPANS))
    header = burst_labels(burst_table(judged)).select("burst_id", "label", "time", F.col("faces").alias("_faces"), "keeper_id", "n_frames")
    last = judged.agg(F.max("burst_id")).scalar()
    frames = join_burst_table(frame_documents(judged), header)
    frame = F.to_json(F.struct(*FRAME_DOC), {"ignoreNullFields": "false"})
    head = F.to_json(F.struct(burst_key(F.lit(method), F.col("burst_id")).alias("id"), "label", "time", F.col("_faces").alias("faces"), "keeper_id"))
    # The header is an object; its closing brace gives way to the frames.
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"frames":['))
    first, final = F.col("position") == 0, F.col("position") == F.col("n_frames") - 1
    start = F.when(F.col("burst_id") == 0, F.lit(f'{{"grouping":"{method}","bursts":[')).otherwise(F.lit(","))
    end = F.when(F.col("burst_id") == last, F.lit("]}]}")).otherwise(F.lit("]}"))
    piece = F.concat(
        F.when(first, F.concat(start, opened)).otherwise(F.lit(",")), frame, F.when(final, end).otherwise(F.lit(""))
    )
    return frames.select("burst_id", "position", piece.alias("piece"))


def write_result(pieces: DataFrame, path: str) -> None:
    """The pieces as text part files in order; one after the other they are the document."""
    pieces.orderBy("burst_id", "position").select("piece").write.mode("overwrite").text(path)


def progress_sequence(judged: DataFrame) -> DataFrame:
    """One progress row per frame, in burst order and best first: running ``done`` out of ``total``.

    Bursts follow each other in capture order and hold their frames together, so a frame's number is the place of its burst's
    first frame, which the layout knows, plus its position in the burst.
    """
    laid = laid_out(judged).select("rel", "when_ts", "burst_id", "bin", "sharpness", "face_count", CHUNK, SPANS)
    laid = pin(numbered(laid, [F.col("burst_id"), *chron()], "_place"))
    placed = with_burst_stats(laid, _start=F.min("_place"))
    placed = rank_in_burst(placed, [], best_first(), "_position")
    labels = burst_labels(burst_table(laid)).select("burst_id", "label")
    total = laid.agg(F.count("*")).scalar()
    return join_burst_table(placed, labels).select(
        (F.col("_start") + F.col("_position") + 1).alias("done"),
        total.alias("total"),
        basename("rel").alias("current_frame_name"),
        F.col("label").alias("current_burst_label"),
        F.lit("scoring").alias("phase"),
    )


def progress_lines(judged: DataFrame) -> DataFrame:
    """The lines (done, value) that a run writes: one with the real total before the first frame, then one for each frame."""
    steps = progress_sequence(judged)
    total = judged.agg(F.count("*").alias("total"))
    empty = F.lit("")
    loading = total.select(
        F.lit(0).cast("bigint").alias("done"), "total", empty.alias("current_frame_name"), empty.alias("current_burst_label"), F.lit("loading").alias("phase")
    )
    lines = loading.unionByName(steps)
    return lines.select("done", F.to_json(F.struct("done", "total", "current_frame_name", "current_burst_label", "phase")).alias("value"))
