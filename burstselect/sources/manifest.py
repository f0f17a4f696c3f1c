"""The manifest: 13 columns, one row per frame, as text cells and as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstselect.functions.columns import basename, fixed, iso_time
from burstselect.plans.ordered import chron
from burstselect.sources.onefile import write_csv_file

# The manifest's columns in order.
MANIFEST_FIELDS = [
    "rel", "filename", "burst_id", "when_iso", "face_count", "eye_score", "sharpness", "exposure_flag", "blown_frac",
    "crushed_frac", "bin", "reason", "rank_in_burst",
]

TEXT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in MANIFEST_FIELDS])


def manifest_cells(judged: DataFrame, *more: Column | str) -> DataFrame:
    """The manifest as text cells, and ``more`` columns as they are."""
    cells = dict(
        filename=basename("rel"),
        when_iso=F.coalesce(iso_time("when_ts"), F.lit("")),
        eye_score=F.coalesce(fixed("eye_score", 4), F.lit("")),
        sharpness=fixed("sharpness", 3),
        exposure_flag=F.col("exposure_flag").cast("int"),
        blown_frac=fixed("blown", 4),
        crushed_frac=fixed("crushed", 4),
    )
    return judged.select(*[cells.get(f, F.col(f)).cast("string").alias(f) for f in MANIFEST_FIELDS], *more)


def manifest_rows(judged: DataFrame) -> DataFrame:
    """The manifest with its typed columns, values unrounded."""
    return judged.select(
        "rel",
        basename("rel").alias("filename"),
        "burst_id",
        F.coalesce(iso_time("when_ts"), F.lit("")).alias("when_iso"),
        "face_count",
        "eye_score",
        "sharpness",
        "exposure_flag",
        F.col("blown").alias("blown_frac"),
        F.col("crushed").alias("crushed_frac"),
        "bin",
        "reason",
        "rank_in_burst",
    )


def write_manifest(judged: DataFrame, path: str) -> None:
    """CSV part files: burst order, capture order inside a burst."""
    ordered = judged.orderBy(F.col("burst_id").asc(), *chron())
    manifest_cells(ordered).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_manifest_file(judged: DataFrame, path: str) -> int:
    """The manifest as one CSV file in the same order, with the line ends and quotes of a spreadsheet program; returns its size."""
    keyed = judged.select("*", F.col("burst_id").alias("_burst"))
    quoted = lambda c: F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = manifest_cells(keyed, "_burst", "when_ts", F.col("rel").alias("_rel"))
    order = [F.col("_burst"), F.col("when_ts").isNull(), F.col("when_ts"), F.col("_rel")]
    return write_csv_file(cells, MANIFEST_FIELDS, order, path, "\r\n", quoted)


def parse_manifest(cells: DataFrame) -> DataFrame:
    """Typed rows from text cells, forgiving per cell: a bad integer is 0, a bad number 0.0, no eye score null."""
    given = [f for f in MANIFEST_FIELDS if f in cells.columns]
    raw = cells.select(*[F.col(f) if f in given else F.lit(None).cast("string").alias(f) for f in MANIFEST_FIELDS])
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    stripped = lambda f: F.regexp_replace(text(f), r"^\s+|\s+$", "")
    whole = lambda f: F.when(stripped(f).rlike("^[+-]?[0-9]+$"), stripped(f).try_cast("bigint"))
    integer = lambda f: F.coalesce(whole(f), F.lit(0))
    number = lambda f: F.coalesce(stripped(f).try_cast("double"), F.lit(0.0))
    typed: dict[str, Column] = dict(
        rel=text("rel"),
        filename=F.coalesce(F.nullif(F.col("filename"), F.lit("")), basename(text("rel"))),
        burst_id=integer("burst_id"),
        when_iso=text("when_iso"),
        face_count=integer("face_count").cast("int"),
        eye_score=stripped("eye_score").try_cast("double"),
        sharpness=number("sharpness"),
        exposure_flag=text("exposure_flag").isin("1", "True", "true"),
        blown_frac=number("blown_frac"),
        crushed_frac=number("crushed_frac"),
        bin=text("bin"),
        reason=text("reason"),
        rank_in_burst=integer("rank_in_burst").cast("int"),
    )
    return raw.select(*[typed[f].alias(f) for f in MANIFEST_FIELDS])


def read_manifest(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Typed rows of a manifest. ``line_breaks`` allows them inside cells, but then a file is read by one task."""
    return parse_manifest(spark.read.schema(TEXT_SCHEMA).csv(path, header=True, quote='"', escape='"', multiLine=line_breaks))


def judged_from_manifest(manifest: DataFrame) -> DataFrame:
    """A typed manifest as input for grouping, verdicts and review; an unreadable time is undated."""
    return manifest.withColumns(
        dict(
            when_ts=F.nullif(F.col("when_iso"), F.lit("")).try_cast("timestamp_ntz"),
            blown=F.col("blown_frac"),
            crushed=F.col("crushed_frac"),
        )
    )
