"""The subject region: which part of a frame its sharpness is read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstselect.functions.columns import box, center_box
from burstselect.params import SelectionParams
from burstselect.plans.ordered import CHUNK, into_chunks, laid_out, parts, settled

_AXES = ["x", "y", "w", "h"]


def _median_box(over=None) -> Column:
    """Component-wise exact median of the boxes; null where there is none."""
    m = [F.percentile(F.col(f"primary_box.{a}"), 0.5) for a in _AXES]
    if over is not None:
        m = [c.over(over) for c in m]
    return F.when(m[0].isNotNull(), box(*m))


def _split_medians(split: DataFrame) -> DataFrame:
    """Exact median boxes of the bursts that reach over chunk edges, at most one row per edge.

    ``percentile`` would gather all values of such a burst in one buffer, and it has no bound. Here the different values of each axis are laid out in
    order instead, with how often they come, and only the middle one or two are kept.
    """
    axes = [F.struct(F.lit(a).alias("axis"), F.col(f"primary_box.{a}").alias("v")) for a in _AXES]
    values = split.where(F.col("primary_box").isNotNull()).select("burst_id", F.explode(F.array(*axes)).alias("_a"))
    # Equal values are counted before they travel.
    values = values.groupBy("burst_id", "_a.axis", "_a.v").agg(F.count("*").alias("_times"))
    keys = ["burst_id", "axis"]
    dealt = into_chunks(values, [F.col(k) for k in (*keys, "v")])
    parts_of = dealt.groupBy(CHUNK, *keys).agg(F.sum("_times").alias("_n"))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    # At most one row per chunk, and one per axis of a burst.
    parts_of = parts_of.select(
        CHUNK, *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("_all")
    )
    upto = F.sum("_times").over(W.partitionBy(CHUNK, *keys).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    at = dealt.withColumn("_upto", upto).join(F.broadcast(parts_of), [CHUNK, *keys]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    # A value has the places from _upto - _times to _upto - 1; the middle places are those of the median.
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    middle = (F.col("_upto") > low) & (F.col("_upto") - F.col("_times") <= high)
    halves = at.where(middle).groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias("m"))
    axis = lambda a: F.max(F.when(F.col("axis") == a, F.col("m")))
    return halves.groupBy("burst_id").agg(box(*[axis(a) for a in _AXES]).alias("region"))


def with_locked_region(grouped: DataFrame) -> DataFrame:
    """Add ``region``: the consensus box of the burst, the centre where no frame of it has a box."""
    whole, split = parts(settled(laid_out(grouped)))
    whole = whole.withColumn("region", _median_box(W.partitionBy(CHUNK, "burst_id")))
    split = split.join(F.broadcast(_split_medians(split)), "burst_id", "left")
    return whole.unionByName(split).withColumn("region", F.coalesce("region", center_box()))


def locked_region(grouped: DataFrame) -> DataFrame:
    """One row per burst: its locked region."""
    whole, split = parts(settled(laid_out(grouped)))
    inside = whole.groupBy("burst_id").agg(_median_box().alias("region"))
    over = split.select("burst_id").distinct().join(F.broadcast(_split_medians(split)), "burst_id", "left")
    return inside.unionByName(over).withColumn("region", F.coalesce("region", center_box()))


def subject_region(frames: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Add ``region`` according to the subject mode; null means the whole frame.

    In ``auto`` (and ``face``, which is the same) time grouping locks one region per burst, while similarity grouping
    uses each frame's own box and needs no burst.
    """
    if params.subject_mode == "whole":
        return frames.withColumn("region", F.when(F.lit(False), center_box()))
    if params.subject_mode == "center":
        return frames.withColumn("region", center_box())
    if params.group_method == "similarity":
        return frames.withColumn("region", F.coalesce("primary_box", center_box()))
    return with_locked_region(frames)
