"""Grouping frames into bursts by time gap or by perceptual-hash similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.functions.columns import hamming, hamming_words, seconds_between
from burstselect.params import SelectionParams
from burstselect.plans.ordered import CHUNK, SPANS, chron, number_islands


def time_bursts(frames: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """A new burst starts after a gap of more than ``gap_seconds``; every undated frame is a burst of its own."""

    def starts(p: Column, c: Column) -> Column:
        gap = seconds_between(p["when_ts"], c["when_ts"]) > F.lit(float(params.gap_seconds))
        return F.coalesce(gap, F.lit(True))

    return number_islands(frames, chron(), ["when_ts"], starts)


def similarity_bursts(frames: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """A new burst starts when a frame differs too much from the one just before it, or comes too long after it."""
    distance = hamming_words if params.phash_size > 8 else hamming

    def starts(p: Column, c: Column) -> Column:
        unlike = distance(p["phash"], c["phash"]) > F.lit(int(params.sim_max_distance))
        late = seconds_between(p["when_ts"], c["when_ts"]) > F.lit(float(params.sim_time_ceiling))
        return F.coalesce(unlike, F.lit(True)) | F.coalesce(late, F.lit(False))

    return number_islands(frames, chron(), ["when_ts", "phash"], starts)


# The grouping seam: a name -> a function that adds burst_id. Register further strategies here.
GROUPINGS: dict[str, Callable[[DataFrame, SelectionParams], DataFrame]] = {
    "time": time_bursts,
    "similarity": similarity_bursts,
}


def group_frames(frames: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    return GROUPINGS[params.group_method](frames, params)


def without_layout(df: DataFrame) -> DataFrame:
    """Drop the chunk bookkeeping before writing a table for others."""
    return df.drop(CHUNK, SPANS)


def group_summary(grouped: DataFrame) -> DataFrame:
    """One row: number of groups, of singles and of real bursts (groups of two or more)."""
    sizes = grouped.groupBy("burst_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("n") == 1).alias("singles"),
        F.count_if(F.col("n") > 1).alias("bursts"),
    )


def burst_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("burst_id").agg(F.count("*").alias("frames"))
