"""Review tables: filters, counts, staging plan, contact sheet, neighbours, comparison of groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from burstselect.functions.columns import (
    basename,
    exposure_warning,
    eyes_text,
    frame_id,
    iso_time,
    mark_label,
    sharpness_band,
    sharpness_fill,
    sharpness_text,
    slug,
)
from burstselect.plans.ordered import CHUNK, SPANS, chron, join_burst_table, laid_out, parts, rank_in_burst, ranked
from burstselect.session import pin


def mark_filter(judged: DataFrame, mark: str = "all") -> DataFrame:
    """Frames of one mark; a burst without such a frame disappears with them."""
    return judged if mark == "all" else judged.where(F.col("bin") == mark)


def nothing_matches(judged: DataFrame, mark: str = "all") -> bool:
    return mark_filter(judged, mark).isEmpty()


def mark_counts(judged: DataFrame) -> DataFrame:
    """Frames per mark, and of all marks together under ``all``."""
    return judged.rollup("bin").agg(F.count("*").alias("frames")).select(F.coalesce("bin", F.lit("all")).alias("mark"), "frames")


def mark_counts_wide(judged: DataFrame) -> DataFrame:
    is_ = lambda m: F.count_if(F.col("bin") == m).alias(m)
    return judged.agg(F.count("*").alias("all"), is_("keeper"), is_("maybe"), is_("rejected"))


def best_count(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if(F.col("bin") == "keeper").alias("best"))


def display_order() -> list[Column]:
    """Keepers first, then by falling displayed sharpness, then the order of the result."""
    return [F.col("mark") != "keeper", -F.col("sharpness"), F.col("position")]


def visible_frames(documents: DataFrame, mark: str = "all") -> DataFrame:
    """Frame documents that pass the filter, with their place ``shown_at`` among the shown frames of the burst."""
    kept = documents if mark == "all" else documents.where(F.col("mark") == mark)
    return rank_in_burst(kept, [], display_order(), "shown_at")


def display_columns(documents: DataFrame) -> DataFrame:
    return documents.select(
        "id",
        mark_label("mark").alias("label"),
        sharpness_text("sharpness").alias("sharpness_text"),
        eyes_text("eyes").alias("eyes_text"),
        F.coalesce(exposure_warning("exposure"), F.lit("")).alias("warning"),
        sharpness_band("sharpness").alias("band"),
        sharpness_fill("sharpness").alias("fill"),
    )


# ---- staging ---------------------------------------------------------------------------------------------------


def staged_rows(manifest: DataFrame, bins: Sequence[str] = ("keeper", "maybe")) -> DataFrame:
    """Manifest rows of the wanted bins with their destination below the staging folder."""
    b = F.col("burst_id").cast("string")
    dest = (
        F.when(F.col("bin") == "keeper", F.concat(F.lit("keepers/b"), b, F.lit("_"), F.col("filename")))
        .when(F.col("bin") == "maybe", F.concat(F.lit("maybe/b"), b, F.lit("/"), F.col("filename")))
        .otherwise(F.concat(F.lit("rejected/"), slug("reason"), F.lit("_"), F.col("filename")))
    )
    return manifest.where(F.col("bin").isin(*bins)).withColumn("dest", dest)


def staging_plan(manifest: DataFrame, bins: Sequence[str] = ("keeper", "maybe")) -> DataFrame:
    """What each destination ends up pointing at: of rows with the same destination the last in manifest order."""
    place = F.struct(F.col("burst_id"), F.col("when_iso") == "", F.col("when_iso"), F.col("rel"))
    last = F.max_by(F.struct("rel", "bin", "burst_id"), place).alias("_r")
    return staged_rows(manifest, bins).groupBy("dest").agg(last).select("dest", "_r.*")


def staging_counts(manifest: DataFrame, bins: Sequence[str] = ("keeper", "maybe")) -> DataFrame:
    """Links made per bin, replaced ones included."""
    return staged_rows(manifest, bins).groupBy("bin").agg(F.count("*").alias("links"))


# ---- contact sheet ---------------------------------------------------------------------------------------------


def contact_order() -> list[Column]:
    """Keeper, maybe, rejected, anything else; then rank; then manifest order."""
    place = F.when(F.col("bin") == "keeper", 0).when(F.col("bin") == "maybe", 1).when(F.col("bin") == "rejected", 2).otherwise(9)
    return [place, F.col("rank_in_burst"), *chron()]


def contact_cards(judged: DataFrame) -> DataFrame:
    """Every frame as a card with its place on the contact sheet."""
    placed = rank_in_burst(laid_out(judged), [], contact_order(), "place")
    return placed.withColumn("filename", basename("rel"))


def contact_sheet(judged: DataFrame) -> DataFrame:
    """Every card with its place, and its burst's size, first time in display order and number of cards of each bin."""
    cards = contact_cards(judged)
    n = lambda bin_: F.count_if(F.col("bin") == bin_)
    heads = cards.groupBy("burst_id").agg(
        F.count("*").alias("frames"),
        F.min_by("when_ts", F.when(F.col("when_ts").isNotNull(), F.col("place"))).alias("_first"),
        n("keeper").alias("keepers"),
        n("maybe").alias("maybes"),
        n("rejected").alias("rejects"),
    )
    card = ["place", "filename", "bin", "reason", "rank_in_burst", "sharpness", "eye_score", "face_count", "exposure_flag"]
    return join_burst_table(cards, heads).select(
        "burst_id", "frames", "keepers", "maybes", "rejects", F.coalesce(iso_time("_first"), F.lit("")).alias("when_iso"), *card
    )


def contact_totals(judged: DataFrame) -> DataFrame:
    """The head of the sheet: photos, bursts and the number of each bin."""
    n = lambda bin_: F.count_if(F.col("bin") == bin_)
    return judged.agg(
        F.count("*").alias("photos"), F.countDistinct("burst_id").alias("bursts"), n("keeper").alias("keepers"), n("maybe").alias("maybes"), n("rejected").alias("rejects")
    )


# ---- neighbours ------------------------------------------------------------------------------------------------


def _ring(df: DataFrame, group: Sequence[str], at: str, value: str) -> DataFrame:
    """Add the previous and next ``value`` in a group, wrapping around.

    Positions inside a group are dense and unique, so a neighbour is found by an equi-join on (group, position), which
    spreads evenly whatever the size of a group. Only the first and the last row of a group look up its other end.
    """
    keys = list(group) or ["_all"]
    df = pin(df if group else df.withColumn("_all", F.lit(0)))
    ends = df.groupBy(*keys).agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"), F.max(at).alias("_end"))
    # The row before the first is the last, and the row after the last is the first.
    wrap_back = ends.select(*keys, F.lit(0).cast("bigint").alias(at), F.col("_last").alias(f"prev_{value}"))
    wrap_on = ends.select(*keys, F.col("_end").alias(at), F.col("_first").alias(f"next_{value}"))
    before = df.select(*keys, (F.col(at) + 1).alias(at), F.col(value).alias(f"prev_{value}"))
    after = df.where(F.col(at) > 0).select(*keys, (F.col(at) - 1).alias(at), F.col(value).alias(f"next_{value}"))
    out = df.join(before.unionByName(wrap_back), [*keys, at]).join(after.unionByName(wrap_on), [*keys, at])
    return out.drop("_all")


def frame_step(documents: DataFrame, mark: str = "all") -> DataFrame:
    """Previous and next shown frame in the burst, wrapping.

    Inside a chunk they are the window's neighbours; only the bursts over chunk edges are looked up by position.
    """
    whole, split = parts(visible_frames(documents, mark).select("burst_id", "shown_at", "id", CHUNK, SPANS))
    in_burst = W.partitionBy(CHUNK, "burst_id").orderBy("shown_at")
    all_of_it = in_burst.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = whole.withColumns(
        dict(
            prev_id=F.coalesce(F.lag("id").over(in_burst), F.last("id").over(all_of_it)),
            next_id=F.coalesce(F.lead("id").over(in_burst), F.first("id").over(all_of_it)),
        )
    )
    around = _ring(split.drop(CHUNK, SPANS), ["burst_id"], "shown_at", "id")
    return whole.drop(CHUNK, SPANS).unionByName(around)


def burst_step(documents: DataFrame, mark: str = "all") -> DataFrame:
    """Previous and next burst with shown frames, wrapping."""
    kept = documents if mark == "all" else documents.where(F.col("mark") == mark)
    order = ranked(kept.select("burst_id").distinct(), [], [F.col("burst_id")], "place")
    return _ring(order, [], "place", "burst_id")


# ---- lookups and comparisons -----------------------------------------------------------------------------------


def keeper_lookup(bursts: DataFrame, documents: DataFrame) -> DataFrame:
    """The frame document of each burst's keeper, looked up inside the burst: ids are short hashes and may repeat elsewhere."""
    frames = documents.drop("faces", "_chunk", "_spans")
    wanted = bursts.select("burst_id", "keeper_rel", F.col("keeper_id").alias("id"))
    return wanted.join(frames, ["burst_id", "id"]).where(F.col("rel_path") == F.col("keeper_rel")).drop("keeper_rel").withColumn("keeper_id", F.col("id"))


def compare_groupings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both verdicts of every frame, matched by path, and whether they differ."""
    a = left.select("rel", F.col("burst_id").alias("left_burst"), F.col("bin").alias("left_bin"))
    b = right.select("rel", F.col("burst_id").alias("right_burst"), F.col("bin").alias("right_bin"))
    both = a.join(b, "rel", "full_outer")
    return both.withColumn("id", frame_id("rel")).withColumn("differs", ~F.col("left_bin").eqNullSafe(F.col("right_bin")))


def compare_summary(compared: DataFrame) -> DataFrame:
    """Best count per grouping and the number of frames judged differently."""
    return compared.agg(
        F.count_if(F.col("left_bin") == "keeper").alias("left_best"),
        F.count_if(F.col("right_bin") == "keeper").alias("right_best"),
        F.count_if("differs").alias("differing"),
    )
