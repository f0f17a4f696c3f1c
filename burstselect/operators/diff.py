"""Regression diff of two manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(
    current: DataFrame, golden: DataFrame, fields: Sequence[str] = ("bin", "face_count", "burst_id"), key: str = "rel"
) -> DataFrame:
    """Every (key, field) that differs; a file on one side only is listed once, under the key's own name.

    Files are matched by their path. With ``key="filename"`` they are matched by name; the last row of a name counts then,
    and a name that either side has more than once is listed under ``copies`` with how often.
    """
    both = _last_rows(golden, fields, key, "gold").join(_last_rows(current, fields, key, "cur"), key, "full_outer")
    presence = F.struct(
        F.lit(key).alias("field"),
        F.when(F.col("gold").isNotNull(), F.col(key)).alias("expected"),
        F.when(F.col("cur").isNotNull(), F.col(key)).alias("actual"),
    )
    text = lambda side: F.coalesce(F.col(f"{side}.copies"), F.lit(0)).cast("string")
    copies = F.struct(F.lit("copies").alias("field"), text("gold").alias("expected"), text("cur").alias("actual"))
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"gold.{f}").alias("expected"), F.col(f"cur.{f}").alias("actual")) for f in fields]
    one_sided = F.col("gold").isNull() | F.col("cur").isNull()
    listed = F.when(one_sided, F.array(presence)).otherwise(F.filter(F.array(*cells), lambda d: ~d["expected"].eqNullSafe(d["actual"])))
    repeated = (F.coalesce(F.col("gold.copies"), F.lit(0)) > 1) | (F.coalesce(F.col("cur.copies"), F.lit(0)) > 1)
    listed = F.when(repeated, F.array_append(listed, copies)).otherwise(listed)
    return both.select(key, F.explode(listed).alias("d")).select(key, "d.*")


def _last_rows(manifest: DataFrame, fields: Sequence[str], key: str, side: str) -> DataFrame:
    """The last row per key in manifest order, its fields as text, and how many rows the key has."""
    row = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    place = F.struct("burst_id", F.col("when_iso") == "", "when_iso", "rel")
    last = manifest.groupBy(key).agg(F.max_by(row, place).alias("_row"), F.count("*").alias("copies"))
    return last.select(key, F.struct("_row.*", "copies").alias(side))
