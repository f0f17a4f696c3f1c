"""The line protocol of a scoring run: progress objects while it runs, result objects at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.functions.columns import progress_metrics

PROGRESS_SCHEMA = "done bigint, total bigint, current_frame_name string, current_burst_label string, phase string"
FRAME_SCHEMA = (
    "struct<id:string,filename:string,sharpness:int,eyes:int,faces:int,exposure:string,mark:string,reason:string,"
    "size_bytes:bigint,rel_path:string>"
)
RESULT_SCHEMA = (
    f"grouping string, bursts array<struct<id:string,label:string,time:string,faces:boolean,keeper_id:string,frames:array<{FRAME_SCHEMA}>>>"
)

# The spellings the protocol allows.
PHASES = ["loading", "scoring"]
GROUPINGS = ["time", "similarity"]
MARKS = ["keeper", "maybe", "rejected"]
EXPOSURES = ["ok", "blown", "crushed"]


def route_events(lines: DataFrame) -> DataFrame:
    """Sort lines (``value``) into ``kind`` progress, result, error or skipped, with the decoded struct.

    A line with ``done`` is progress, else with ``grouping`` a result, anything else is skipped. A routed line that does
    not have its schema (a required field missing or of another type, an unknown spelling) is an error.
    """
    keys = F.json_object_keys(F.when(F.expr("try_parse_json(value)").isNotNull() & F.ltrim(F.col("value")).startswith("{"), F.col("value")))
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    out = (
        lines.withColumn("_route", F.when(has("done"), "progress").when(has("grouping"), "result").otherwise("skipped"))
        .withColumn("progress", F.when(F.col("_route") == "progress", F.from_json("value", PROGRESS_SCHEMA)))
        .withColumn("result", F.when(F.col("_route") == "result", F.from_json("value", RESULT_SCHEMA)))
    )
    required = lambda s, fields: [F.col(f"{s}.{f}").isNotNull() for f in fields]
    good_progress = _all(required("progress", ["done", "total", "current_frame_name", "current_burst_label"])) & (
        F.col("progress.phase").isNull() | F.col("progress.phase").isin(PHASES)
    )
    good_result = F.col("result.grouping").isin(GROUPINGS) & F.forall(F.col("result.bursts"), _good_burst)
    kind = (
        F.when((F.col("_route") == "progress") & ~F.coalesce(good_progress, F.lit(False)), "error")
        .when((F.col("_route") == "result") & ~F.coalesce(good_result, F.lit(False)), "error")
        .otherwise(F.col("_route"))
    )
    return out.withColumn("kind", kind).drop("_route")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _good_burst(b: Column) -> Column:
    return _all([b[f].isNotNull() for f in ("id", "label", "time", "faces", "keeper_id", "frames")]) & F.forall(b["frames"], _good_frame)


def _good_frame(f: Column) -> Column:
    needed = [f[c].isNotNull() for c in ("id", "filename", "sharpness", "faces", "reason", "size_bytes", "rel_path")]
    return _all(needed) & f["exposure"].isin(EXPOSURES) & f["mark"].isin(MARKS)


def progress_events(lines: DataFrame) -> DataFrame:
    return route_events(lines).where(F.col("kind") == "progress").select(*[c for c in lines.columns if c != "value"], "progress.*")


def result_events(lines: DataFrame) -> DataFrame:
    return route_events(lines).where(F.col("kind") == "result").select("result.*")


def with_progress_metrics(progress: DataFrame, elapsed: str = "elapsed") -> DataFrame:
    """Add fraction, percent and remaining seconds from done, total and the elapsed seconds."""
    return progress.select("*", progress_metrics("done", "total", elapsed).alias("_p")).select(*progress.columns, "_p.*")
