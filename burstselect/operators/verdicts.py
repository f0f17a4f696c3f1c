"""Gate, rank and bin the frames of each burst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstselect.functions.columns import annotate, eye_gate_fails
from burstselect.params import SelectionParams
from burstselect.plans.ordered import chron, laid_out, rank_in_burst, with_burst_stats
# The bins, and the reasons that go with them.
KEEPER, MAYBE, REJECTED = "keeper", "maybe", "rejected"
SINGLE_BLINK = "single, eyes closed"
SINGLE_UNSURE = "single, sharpness uncertain"
SINGLE_GOOD = "single, passed checks"
BLINK = "eyes closed"
BEST_GROUP = "best eyes + sharpness"
BEST = "sharpest in burst"
SOFT = "much softer than burst peak"
RUNNER_UP = "burst runner-up"


def is_group_from_counts(with_faces: Column, one_face: Column, two_faces: Column) -> Column:
    """Whether the median face count of the frames with faces is at least 2, from plain counts.

    The median is below 2 exactly when ones fill at least half of the sorted list; with ones in exactly half, the two
    middle values are 1 and the smallest value from 2 up, and their mean reaches 2 only if no frame has two faces.
    """
    return (2 * one_face < with_faces) | ((2 * one_face == with_faces) & (with_faces > 0) & (two_faces == 0))


def gates(grouped: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Add the burst peak, size, whether it is a group shot, and each frame's eyes-closed gate."""
    df = with_burst_stats(
        laid_out(grouped),
        peak=F.max("sharpness"),
        n_frames=F.count("*"),
        _with_faces=F.count_if(F.col("face_count") > 0),
        _one_face=F.count_if(F.col("face_count") == 1),
        _two_faces=F.count_if(F.col("face_count") == 2),
    )
    return (
        df.withColumn("is_group", is_group_from_counts(F.col("_with_faces"), F.col("_one_face"), F.col("_two_faces")))
        .withColumn("is_single", F.col("n_frames") == 1)
        .withColumn(
            "gated",
            ~F.col("is_single") & ~F.col("is_group") & (F.col("face_count") >= 1) & eye_gate_fails("eye_score", params.open_gate),
        )
        .drop("_with_faces", "_one_face", "_two_faces")
    )


def best_candidate_first() -> list[Column]:
    """Order of the candidates of a burst: eyes first in a group shot, then sharpness, then capture order."""
    eyes = F.when(F.col("is_group"), F.coalesce("eye_score", F.lit(0.0))).otherwise(F.lit(0.0))
    return [-eyes, -F.col("sharpness"), *chron()]


def verdicts(grouped: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Add ``bin``, ``reason`` and ``rank_in_burst`` (0 best, -1 gated out) to every frame."""
    df = rank_in_burst(gates(grouped, params), ["gated"], best_candidate_first(), "_rank")
    single, gated, keeper = F.col("is_single"), F.col("gated"), F.col("_rank") < params.keep_per_burst
    blink = (F.col("face_count") == 1) & eye_gate_fails("eye_score", params.open_gate)
    unsure = F.col("sharpness") < params.single_sharpness_floor
    soft = (F.col("peak") > 0) & (F.col("sharpness") < F.col("peak") * params.reject_sharpness_ratio)
    best = F.when(F.col("is_group"), BEST_GROUP).otherwise(BEST)
    verdict = (
        F.when(single & blink, _verdict(REJECTED, SINGLE_BLINK))
        .when(single & unsure, _verdict(MAYBE, SINGLE_UNSURE))
        .when(single, _verdict(KEEPER, SINGLE_GOOD))
        .when(gated, _verdict(REJECTED, BLINK))
        .when(keeper, F.struct(F.lit(KEEPER).alias("bin"), best.alias("reason")))
        .when(soft, _verdict(REJECTED, SOFT))
        .otherwise(_verdict(MAYBE, RUNNER_UP))
    )
    return (
        df.withColumn("_v", verdict)
        .withColumn("bin", F.col("_v.bin"))
        .withColumn("reason", annotate(F.col("_v.reason"), F.col("exposure_flag") & (F.col("_v.bin") != REJECTED)))
        .withColumn("rank_in_burst", F.when(gated, F.lit(-1)).otherwise(F.col("_rank")).cast("int"))
        .drop("_v", "_rank")
    )


def _verdict(bin_: str, reason: str) -> Column:
    return F.struct(F.lit(bin_).alias("bin"), F.lit(reason).alias("reason"))


def top_keepers(grouped: DataFrame, k: int, params: SelectionParams = SelectionParams()) -> DataFrame:
    """The first ``k`` candidates of every burst.

    ``row_number <= k`` lets Spark drop all but k rows per burst and task before the shuffle, so a hot burst costs no
    more than k rows per task.
    """
    best = W.partitionBy("burst_id").orderBy(*best_candidate_first())
    ready = gates(grouped, params).where(~F.col("gated"))
    return ready.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def burst_peak(grouped: DataFrame) -> DataFrame:
    """Sharpest value per burst, gated frames included."""
    return grouped.groupBy("burst_id").agg(F.max("sharpness").alias("peak"))


def group_shots(grouped: DataFrame) -> DataFrame:
    """Per burst, whether it is a group shot."""
    counts = grouped.groupBy("burst_id").agg(
        F.count_if(F.col("face_count") > 0).alias("f"),
        F.count_if(F.col("face_count") == 1).alias("one"),
        F.count_if(F.col("face_count") == 2).alias("two"),
    )
    return counts.select("burst_id", is_group_from_counts(F.col("f"), F.col("one"), F.col("two")).alias("is_group"))


def bin_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("bin").agg(F.count("*").alias("frames"))
