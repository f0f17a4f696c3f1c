"""Order-dependent work without a one-task window.

A window with no partition key sends the whole table to one task, and a window keyed by burst sends a hot burst to
one task. Both are avoided the same way: sort the rows into range *chunks* on a unique key (so no chunk can be hot),
do the window inside each chunk, and correct each chunk by what the chunks before it held. The correction table has
one row per chunk, at most ``MAX_CHUNKS`` rows whatever the size of the data, so it is safe to order it in one task and
to broadcast it.

A chunk is a plain column: the number of boundaries at or below the row's key. The rows are written once before they are
dealt, so that what they come from runs once: their number comes from that write and the boundaries from a small sample of the
written keys. With few chunks a condition finds a row's own, with many Spark partitions by range, and that is written too. Then the rows are shuffled once, chunk ``i`` to partition ``i``; windows by chunk, and by chunk and burst, work
on that layout without another exchange, and reading it twice in a plan reuses the exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Observation
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from burstselect.session import pin

CHUNK = "_chunk"
SPANS = "_spans"

# Rows of one chunk, until there are MAX_CHUNKS of them; keys sampled for each chunk.
CHUNK_ROWS = 200_000
MAX_CHUNKS = 16_384
SAMPLED_KEYS = 20
# Up to 2 ** TREE_DEPTH chunks a row looks for its own by compiled conditions. They are slow until the machine has compiled them as
# well, which for 30 takes longer than to deal six million rows, and for 180 it never does.
TREE_DEPTH = 3
# Marks the chunk column of a layout of more chunks.
MANY = {"many": True}


def chron() -> list[Column]:
    """Capture order: dated rows first, by time, then by path. Paths are unique, so this is a total order."""
    return [F.col("when_ts").isNull(), F.col("when_ts"), F.col("rel")]


def into_chunks(df: DataFrame, order: Sequence[Column], rows: int | None = None, once: bool = False) -> DataFrame:
    """Deal the rows into chunks by ``order``, expressions that sort ascending, and add the chunk number.

    ``rows`` is the number of rows of a table that is written already, so that it is not written again. ``once`` promises that one plan alone
    reads the chunks, which then need not be written here.
    """
    if rows is None:
        seen = Observation()
        df = pin(df.observe(seen, F.count("*").alias("rows")))
        rows = seen.get["rows"]
    chunks = min(MAX_CHUNKS, math.ceil(rows / CHUNK_ROWS))
    if chunks < 2:
        return df.repartition(1).withColumn(CHUNK, F.lit(0))
    if chunks > 2**TREE_DEPTH:
        # Many bounds are Spark's to look up; its bounds differ from plan to plan, so the number of a row's range is written.
        number = F.spark_partition_id()
        # Always so; see `_at_or_below`.
        ranges = df.repartitionByRange(chunks, *order).withColumn(CHUNK, F.when(number >= 0, number))
        return (ranges if once else pin(ranges)).repartitionById(chunks, CHUNK).withMetadata(CHUNK, MANY)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("key")).select("key.*")
    share = min(1.0, SAMPLED_KEYS * chunks / rows)
    # Every so many sampled keys, in order, as text: they become one literal.
    sample = keys.sample(share, seed=7).repartition(1).sortWithinPartitions(*keys.columns).select(*[F.col(c).cast("string") for c in keys.columns]).collect()
    step = max(1, len(sample) // chunks)
    bounds = sample[step::step]
    kinds = [f.dataType.simpleString() for f in keys.schema.fields]
    if not bounds:
        return df.repartition(1).withColumn(CHUNK, F.lit(0))
    # The key is a column of its own, so that its expressions run once for each row, not at each condition.
    dealt = df.withColumn("_key", key).withColumn(CHUNK, _at_or_below(bounds, kinds, F.col("_key"))).drop("_key")
    return dealt.repartitionById(len(bounds) + 1, CHUNK)


def _literal(row: Sequence[str | None], kinds: Sequence[str]) -> str:
    """A struct, given as text, that Spark folds into a literal."""

    def cell(text: str | None, kind: str) -> str:
        if text is None:
            return f"cast(null as {kind})"
        escaped = text.replace("\\", "\\\\").replace("'", "\\'")
        return f"cast('{escaped}' as {kind})"

    return "named_struct(" + ", ".join(f"'k{i}', {cell(x, k)}" for i, (x, k) in enumerate(zip(row, kinds, strict=True))) + ")"


def _at_or_below(rows: Sequence[Sequence[str | None]], kinds: Sequence[str], key: Column) -> Column:
    """How many ascending bounds are at or below the key, by a tree of conditions, which Spark compiles."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        below = F.expr(_literal(rows[middle], kinds)) <= key
        return F.when(below, tree(middle + 1, high)).otherwise(tree(low, middle))

    # Always so; the schema then shows a column that may be null, unlike the constant of one chunk (see `_single`).
    return F.when(key.isNotNull(), tree(0, len(rows)))


def _place(in_order: WindowSpec) -> dict[str, Column]:
    """The row's number in its chunk, and whether it is the last."""
    return dict(_row=F.row_number().over(in_order), _end=F.lead(F.lit(True)).over(in_order).isNull())


def _edge_rows(rows: DataFrame, keys: Sequence[str]) -> GroupedData:
    """First and last row of every chunk, grouped by chunk."""
    ends = rows.where((F.col("_row") == 1) | F.col("_end"))
    return ends.withColumn("_key", F.struct(*keys)).groupBy(CHUNK)


def number_islands(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str],
    is_break: Callable[[Column, Column], Column],
    name: str = "burst_id",
) -> DataFrame:
    """Number the islands of a totally ordered table 0, 1, 2, ... in order.

    ``is_break(previous, current)`` gets two structs of ``keys`` and says (never null) whether a new island starts at
    the current row. Adds ``name``, the chunk of each row and whether the row's island reaches into another chunk.
    """
    in_order = W.partitionBy(CHUNK).orderBy(*order)
    so_far = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = (
        into_chunks(df, order, once=True)
        .withColumns(dict(_place(in_order), _prev=F.lag(F.struct(*keys)).over(in_order)))
        .withColumn("_brk", F.when(F.col("_prev").isNull(), 0).otherwise(is_break(F.col("_prev"), F.struct(*keys)).cast("int")))
        .withColumn("_isle", F.sum("_brk").over(so_far))
        .drop("_prev", "_brk")
    )
    if _single(rows):
        return rows.withColumns({name: F.col("_isle").cast("bigint"), SPANS: F.lit(False)}).drop("_row", "_end", "_isle")

    many = _many(rows)
    if many:
        # Written, so that the edges and all that follows read numbers instead of sorting the chunks again.
        rows = pin(rows)
    by_chunk = W.orderBy(CHUNK)
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    upto = by_chunk.rowsBetween(W.unboundedPreceding, W.currentRow)
    edges = (
        _edge_rows(rows, keys)
        .agg(
            F.min_by("_key", "_row").alias("_first"),
            F.max_by("_key", "_row").alias("_last"),
            F.max("_isle").alias("_isles"),
        )
        .withColumn("_before", F.lag("_last").over(by_chunk))
        .withColumn(
            "_starts", F.when(F.col("_before").isNull(), 0).otherwise(is_break(F.col("_before"), F.col("_first")).cast("int"))
        )
        .withColumn("_offset", F.sum("_starts").over(upto) + F.coalesce(F.sum("_isles").over(before), F.lit(0)))
        .withColumn("_joins", F.col("_before").isNotNull() & (F.col("_starts") == 0))
        .withColumn("_runs_on", F.coalesce(F.lead("_joins").over(by_chunk), F.lit(False)))
        .select(CHUNK, "_isles", "_offset", "_joins", "_runs_on")
    )
    spans = ((F.col("_isle") == 0) & F.col("_joins")) | ((F.col("_isle") == F.col("_isles")) & F.col("_runs_on"))
    return (
        rows.join(F.broadcast(pin(edges) if many else edges), CHUNK)
        .withColumn(name, (F.col("_isle") + F.col("_offset")).cast("bigint"))
        .withColumn(SPANS, spans)
        .drop("_row", "_end", "_isle", "_isles", "_offset", "_joins", "_runs_on")
    )


def _single(rows: DataFrame) -> bool:
    """Whether `into_chunks` made one chunk: its number is then a constant, which the schema shows as never null."""
    return not rows.schema[CHUNK].nullable


def _many(rows: DataFrame) -> bool:
    """Whether `into_chunks` made more chunks than conditions tell apart. Islands of such a layout are written, so reading them again is cheap."""
    return bool(rows.schema[CHUNK].metadata.get("many"))


def settled(laid: DataFrame) -> DataFrame:
    """A laid-out table that several plans may read, and what lies behind it runs once."""
    return laid if _many(laid) else pin(laid)


def numbered(laid: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based place of each row of a laid-out table in its whole order."""
    counts = laid.groupBy(CHUNK).agg(F.count("*").alias("_n"))
    before = W.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(CHUNK).orderBy(*order)) - 1
    return laid.withColumn(name, place).join(F.broadcast(starts), CHUNK).withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def lay_out(df: DataFrame, group: str = "burst_id") -> DataFrame:
    """Chunk a table that already carries ``group``, in (group, capture order)."""
    return number_islands(
        df.drop(CHUNK, SPANS), [F.col(group), *chron()], [group], lambda p, c: p[group] != c[group], name="_isle_id"
    ).drop("_isle_id")


def laid_out(df: DataFrame) -> DataFrame:
    return df if {CHUNK, SPANS} <= set(df.columns) else lay_out(df)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, rows: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, for groups of any size.

    Same result as ``row_number() over (partition by group order by order) - 1``; with no group, the position in the
    whole table. ``order`` are expressions that sort ascending; they must make the order within a group total.
    ``rows``: see `into_chunks`.
    """
    keys = list(group) or ["_all"]
    src = df.drop(CHUNK, SPANS) if group else df.drop(CHUNK, SPANS).withColumn("_all", F.lit(0))
    full = [*[F.col(k) for k in keys], *order]
    dealt = into_chunks(src, full, rows)
    rows = dealt.withColumn("_nth", F.row_number().over(W.partitionBy(CHUNK, *keys).orderBy(*order)))
    if _single(rows):
        return rows.withColumn(name, (F.col("_nth") - 1).cast("bigint")).drop(CHUNK, "_nth", "_all")

    by_chunk = W.orderBy(CHUNK)
    edges = (
        # Groups are counted, not sorted: a chunk's first and last are known by their keys.
        dealt.groupBy(CHUNK, *keys).agg(F.count("*").alias("_n")).withColumn("_key", F.struct(*keys)).groupBy(CHUNK)
        .agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"), F.max_by("_n", "_key").alias("_tail"))
        # Chunks ending in the same group follow each other, so their tails add up to what the next chunk continues.
        .withColumn("_run", F.sum("_tail").over(W.partitionBy("_last").orderBy(CHUNK)))
        .withColumn("_carry", F.when(F.col("_first").eqNullSafe(F.lag("_last").over(by_chunk)), F.lag("_run").over(by_chunk)))
        .select(CHUNK, "_first", F.coalesce("_carry", F.lit(0)).alias("_carry"))
    )
    carried = F.when(F.struct(*keys).eqNullSafe(F.col("_first")), F.col("_carry")).otherwise(0)
    return (
        rows.join(F.broadcast(edges), CHUNK)
        .withColumn(name, (F.col("_nth") - 1 + carried).cast("bigint"))
        .drop(CHUNK, "_nth", "_first", "_carry", "_all")
    )


def ranked_in_few(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, rows: int) -> DataFrame:
    """`ranked` for a table of ``rows`` rows with few groups: a table of one row per group and range is broadcast.

    The rows are dealt by range, sorted and numbered by the tasks that write them, so a rank is the row's number in its range, less that of
    the first row of its group there, plus the group's rows in the ranges before. Nothing is sorted or dealt again.
    """
    full = [*[F.col(k) for k in group], *order]
    ranges = df.repartitionByRange(max(1, min(MAX_CHUNKS, math.ceil(rows / CHUNK_ROWS))), *full).sortWithinPartitions(*full)
    # This number holds the range in its upper bits and the row's number in the range in the 33 lower ones.
    placed = pin(ranges.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns(dict(_range=F.shiftright("_at", 33), _at=F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = starts.select("*", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_carry"))
    keys = {k: f"_of_{k}" for k in ("_range", *group)}
    starts = starts.select("_carry", *[F.col(k).alias(v) for k, v in keys.items()])
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in keys.items()]
    met = placed.join(F.broadcast(starts), same)
    return met.withColumn(name, (F.col("_at") + F.col("_carry")).cast("bigint")).drop("_at", "_range", "_carry", *keys.values())


def rank_in_burst(df: DataFrame, extra: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based position within (burst, *extra) of a laid-out table.

    A burst inside one chunk is ranked there; the rows of the others, at most one burst per chunk edge, are laid out
    once more in the order asked for. All are written in between, so nothing behind them runs for each part again. ``extra`` has few values.
    """
    position = (F.row_number().over(W.partitionBy(CHUNK, "burst_id", *extra).orderBy(*order)) - 1).cast("bigint")
    if _many(df):
        return _rank_parts(df, extra, order, name, position)
    seen = Observation()
    whole, split = parts(pin(df.withColumn(name, position).observe(seen, F.count_if(SPANS).alias("split"))))
    if not (rows := seen.get["split"]):
        return whole
    # The chunk of these rows stays that of the original layout.
    far = ranked(split.drop(name, SPANS).withColumnRenamed(CHUNK, "_home"), ["burst_id", *extra], order, name, rows)
    far = far.withColumnRenamed("_home", CHUNK).withColumn(SPANS, F.lit(True))
    return whole.unionByName(far)


def _rank_parts(df: DataFrame, extra: Sequence[str], order: Sequence[Column], name: str, position: Column) -> DataFrame:
    """`rank_in_burst` for many chunks: the rows of split bursts, which may be all there are, are sorted and written once only."""
    whole, split = parts(df)
    whole = pin(whole.withColumn(name, position)).withColumn(SPANS, F.lit(False))
    if not (rows := split.count()):
        return whole
    far = ranked_in_few(split.drop(SPANS), ["burst_id", *extra], order, name, rows)
    return whole.unionByName(far.withColumn(SPANS, F.lit(True)))


def with_burst_stats(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Add per-burst aggregates to every row of a laid-out table.

    They are taken by a window over chunk and burst. At most one burst per chunk edge is split; those are aggregated with
    partial sums and come back through a broadcast of at most one row per chunk. Use aggregates with small buffers
    only (sum, count, max, min).
    """
    if _many(df):
        return _stats_of_parts(df, aggregates)
    inside = W.partitionBy(CHUNK, "burst_id")
    far = [f"_far_{k}" for k in aggregates]
    split = df.where(F.col(SPANS)).groupBy(F.col("burst_id").alias("_far_burst"))
    stats = split.agg(*[c.alias(f) for f, c in zip(far, aggregates.values(), strict=True)])
    rows = df.withColumns({k: c.over(inside) for k, c in aggregates.items()})
    rows = rows.join(F.broadcast(stats), F.col("burst_id") == F.col("_far_burst"), "left")
    is_far = F.col("_far_burst").isNotNull()
    return rows.withColumns({k: F.when(is_far, F.col(f)).otherwise(F.col(k)) for k, f in zip(aggregates, far, strict=True)}).drop("_far_burst", *far)


def _stats_of_parts(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """`with_burst_stats` for many chunks: the rows of split bursts, which may be all there are, pass no window and no exchange."""
    whole, split = parts(df)
    inside = W.partitionBy(CHUNK, "burst_id")
    whole = whole.withColumns({k: c.over(inside) for k, c in aggregates.items()})
    stats = split.groupBy(F.col("burst_id").alias("_far_burst")).agg(*[c.alias(k) for k, c in aggregates.items()])
    split = split.join(F.broadcast(stats), F.col("burst_id").eqNullSafe(F.col("_far_burst"))).drop("_far_burst")
    return whole.unionByName(split)


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A laid-out table as (bursts inside one chunk, bursts reaching over a chunk edge).

    The span column becomes a constant in each part, so taking a part of the union of both drops the other from the plan.
    """
    whole, split = df.where(~F.col(SPANS)), df.where(F.col(SPANS))
    return whole.withColumn(SPANS, F.lit(False)), split.withColumn(SPANS, F.lit(True))


def join_burst_table(df: DataFrame, table: DataFrame) -> DataFrame:
    """Join one-row-per-burst data to a laid-out table.

    A burst inside one chunk has at most a chunk of rows, so a plain shuffle join is even. The rows of split bursts, at
    most one burst per chunk edge, stay where they are and get their few table rows by broadcast.
    """
    whole, split = parts(df)
    few = table.join(F.broadcast(split.select("burst_id").distinct()), "burst_id", "left_semi")
    return whole.join(table, "burst_id").unionByName(split.join(F.broadcast(few), "burst_id"))
