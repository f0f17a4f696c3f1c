"""Streams: progress of running passes, live bursts, incremental measurement."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from burstselect.functions.columns import as_instant, seconds_between
from burstselect.operators.cache import KEY, cache_append, cache_keys, cache_part, needs_measure
from burstselect.params import SelectionParams
from burstselect.plans.ordered import number_islands
from burstselect.session import scratch_path
from burstselect.sources.progress import progress_events


def run_available(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Process everything the stream's source holds now, then stop."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-state")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: every micro-batch has its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def replace_at(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for complete mode: the newest batch folder holds the whole answer."""
    return append_to(path)


def read_batches(spark: SparkSession, path: str, newest_only: bool = False) -> DataFrame:
    rows = spark.read.parquet(path)
    if newest_only:
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


# ---- progress --------------------------------------------------------------------------------------------------


def progress_state(lines: DataFrame, run: str = "run") -> DataFrame:
    """Newest progress per run over a stream (or table) of protocol lines (run, value).

    The state is one row per run, kept by partial maxima.
    """
    p = progress_events(lines)
    newest = F.max_by(F.struct("done", "total", "current_frame_name", "phase"), F.struct("done", "current_frame_name"))
    return p.groupBy(run).agg(newest.alias("p"), F.count("*").alias("events")).select(run, "p.*", "events")


# ---- live bursts -----------------------------------------------------------------------------------------------


# Frames that a task turns into bursts at once.
HELD_FRAMES = 200_000
BURST = "frames bigint, first_when timestamp_ntz, last_when timestamp_ntz, peak double, candidate string"


def live_time_bursts(frames: DataFrame, params: SelectionParams, source: str, delay: str = "1 hour") -> DataFrame:
    """Time bursts per source while frames arrive: a burst is emitted once no frame that is still allowed can reach it.

    The state of a source is the list of its open bursts, each with its size, span and sharpest frame. A frame that arrives late, but within
    ``delay``, may join two of them, which then are one. Frames of a micro-batch become bursts within each task first, so a busy
    source sends bursts, not frames, to the task that keeps its state. A timer emits bursts of a source that has gone quiet. An undated frame is
    a burst of its own and is emitted as it arrives. What is open when the stream stops stays in the state: see :func:`open_bursts`.
    """
    gap = int(round(params.gap_seconds * 1_000_000))
    kind = frames.schema[source].dataType.simpleString()
    dated = frames.where(F.col("when_ts").isNotNull())
    thin = dated.select(source, F.unix_micros(as_instant("when_ts")).alias("at"), F.coalesce("sharpness", F.lit(float("-inf"))).alias("sharpness"), "rel")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            if len(pdf):
                held, n = [*held, pdf], n + len(pdf)
            if n >= HELD_FRAMES:
                yield _frames_to_bursts(pd.concat(held, ignore_index=True), source, gap)
                held, n = [], 0
        if held:
            yield _frames_to_bursts(pd.concat(held, ignore_index=True), source, gap)

    columns = f"`{source}` {kind}, frames bigint, first bigint, last bigint, peak double, candidate string"
    bursts = thin.mapInPandas(partial, columns).withColumn("event_time", F.timestamp_micros("last")).withWatermark("event_time", delay)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = [tuple(b) for b in json.loads(state.get[0])] if state.exists else []
        for pdf in batches:
            known += zip(*(pdf[c].tolist() for c in ("frames", "first", "last", "peak", "candidate")), strict=True)
        known = merge_bursts(known, gap)
        reached = state.getCurrentWatermarkMs() * 1000
        over = [b for b in known if b[2] + gap < reached]
        rest = [b for b in known if b[2] + gap >= reached]
        if rest:
            state.update((json.dumps(rest),))
            state.setTimeoutTimestamp(max(min(b[2] for b in rest) + gap, reached) // 1000 + 1)
        elif state.exists:
            state.remove()
        if not over:
            return
        moments = lambda i: pd.Series([b[i] for b in over], dtype="int64").astype("datetime64[us]")
        yield pd.DataFrame({
            source: pd.Series([key[0]] * len(over), dtype="object" if key[0] is None else None), "frames": [b[0] for b in over],
            "first_when": moments(1), "last_when": moments(2), "peak": [b[3] for b in over], "candidate": [b[4] for b in over],
        })

    closed = bursts.groupBy(source).applyInPandasWithState(advance, f"`{source}` {kind}, {BURST}", "bursts string", "append", GroupStateTimeout.EventTimeTimeout)
    return closed.unionByName(_undated(frames, source))


def _frames_to_bursts(rows: pd.DataFrame, source: str, gap: int) -> pd.DataFrame:
    """The bursts of single frames (source, at, sharpness, rel) of any number of sources: what `merge_bursts` makes of each source's."""
    codes = pd.factorize(rows[source])[0]
    order = np.lexsort((rows["at"].to_numpy(), codes))
    code, at, sharp = codes[order], rows["at"].to_numpy()[order], rows["sharpness"].to_numpy()[order]
    begin = np.append(True, (code[1:] != code[:-1]) | (at[1:] - at[:-1] > gap))
    begins = np.flatnonzero(begin)
    ends, isle = np.append(begins[1:], len(at)), np.cumsum(begin) - 1
    peak = np.maximum.reduceat(sharp, begins)
    best = (sharp == peak[isle]) | np.isnan(sharp)
    names = rows["rel"].to_numpy()[order][best]
    if len(names) > len(begins):  # of equally sharp frames the last name
        names = pd.Series(names).groupby(isle[best]).max().to_numpy()
    columns = {"frames": ends - begins, "first": at[begins], "last": at[ends - 1], "peak": peak, "candidate": names}
    return pd.DataFrame({source: rows[source].to_numpy()[order[begins]], **columns})


def merge_bursts(bursts: list[tuple], gap: int) -> list[tuple]:
    """Bursts (frames, first, last, peak, candidate) with those joined that lie at most ``gap`` apart; ascending by time."""
    out: list[tuple] = []
    for n, first, last, peak, rel in sorted(bursts, key=lambda b: (b[1], b[2])):
        if out and first - out[-1][2] <= gap:
            m, begin, end, best, name = out[-1]
            out[-1] = (m + n, begin, max(end, last), *max((best, name), (peak, rel)))
        else:
            out.append((n, first, last, peak, rel))
    return out


def open_bursts(spark: SparkSession, checkpoint: str, source: str) -> DataFrame:
    """The bursts that a stopped stream of :func:`live_time_bursts` still holds open, from the state in its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    kind = "array<array<string>>"
    each = state.select(F.col(f"key.{source}").alias(source), F.explode(F.from_json("value.groupState.bursts", kind)).alias("b"))
    moment = lambda i: F.timestamp_micros(F.col("b")[i].cast("bigint")).cast("timestamp_ntz")
    return each.select(
        source, F.col("b")[0].cast("bigint").alias("frames"), moment(1).alias("first_when"), moment(2).alias("last_when"),
        F.col("b")[3].cast("double").alias("peak"), F.col("b")[4].alias("candidate"),
    )


def batch_time_bursts(frames: DataFrame, params: SelectionParams, source: str) -> DataFrame:
    """The same bursts from a finished table, undated frames included; a busy source is spread over chunks of it."""
    dated = frames.where(F.col("when_ts").isNotNull())

    def starts(p: Column, c: Column) -> Column:
        late = seconds_between(p["when_ts"], c["when_ts"]) > F.lit(float(params.gap_seconds))
        return ~p[source].eqNullSafe(c[source]) | late

    islands = number_islands(dated, [F.col(source), F.col("when_ts"), F.col("rel")], [source, "when_ts"], starts, name="_island")
    bursts = islands.groupBy("_island", source).agg(*_burst_columns()).drop("_island")
    return bursts.unionByName(_undated(frames, source))


def _burst_columns() -> list[Column]:
    return [
        F.count("*").alias("frames"),
        F.min("when_ts").alias("first_when"),
        F.max("when_ts").alias("last_when"),
        F.max("sharpness").alias("peak"),
        F.max_by("rel", F.struct("sharpness", F.col("rel"))).alias("candidate"),
    ]


def _undated(frames: DataFrame, source: str) -> DataFrame:
    """Every undated frame as a burst of its own."""
    alone = frames.where(F.col("when_ts").isNull())
    return alone.select(
        source, F.lit(1).cast("bigint").alias("frames"), F.col("when_ts").alias("first_when"), F.col("when_ts").alias("last_when"),
        F.col("sharpness").alias("peak"), F.col("rel").alias("candidate"),
    )


def _same(a: DataFrame, b: DataFrame, source: str) -> Column:
    cells = [a[c].eqNullSafe(b[c]) for c in (source, "first_when", "last_when", "frames", "candidate")]
    return reduce(lambda x, y: x & y, cells)


def reconcile(frames: DataFrame, emitted: DataFrame, params: SelectionParams, source: str) -> DataFrame:
    """Bursts of the finished table that the stream did not emit as they are: open tails, and bursts late frames changed."""
    known = emitted.alias("emitted")
    done = batch_time_bursts(frames, params, source).alias("done")
    return done.join(known, _same(done, known, source), "left_anti")


def settled(frames: DataFrame, emitted: DataFrame, params: SelectionParams, source: str) -> DataFrame:
    """All bursts once the table is finished: the emitted ones it confirms, and the ones to reconcile."""
    known = emitted.dropDuplicates([source, "first_when", "last_when", "frames", "candidate"]).alias("emitted")
    done = batch_time_bursts(frames, params, source).alias("done")
    confirmed = known.join(done, _same(known, done, source), "left_semi")
    return confirmed.unionByName(reconcile(frames, emitted, params, source))


# ---- incremental measurement -----------------------------------------------------------------------------------


def incremental_measure(
    frames: DataFrame, cache_path: str, tag: str, measure: Callable[[DataFrame], DataFrame], checkpoint: str | None = None
) -> None:
    """Measure the frames of each micro-batch that the cache does not hold yet, and append them.

    Only keys are read, from the parts of the cache that the batch touches. A batch that is repeated after a failure finds
    its frames in the cache; the last run of a key wins in any case, whatever checkpoint the stream started from.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(KEY)
        touched = [r.part for r in fresh.select(cache_part("rel").alias("part")).distinct().collect()]
        known = cache_keys(batch.sparkSession, cache_path, tag, touched)
        cache_append(measure(fresh if known is None else needs_measure(fresh, known)), cache_path, tag)

    run_available(frames, "append", write, checkpoint)
