"""Exact duplicates by deterministic block naming, with DataFrame functions only.

Each text is cut into blocks of a fixed number of bytes. Equal blocks get the same integer name: blocks are sorted, and the
smallest occurrence number names all of them. Then the names of adjacent blocks are paired and named the same way, level
after level, until each document has one name. Two documents with the same number of blocks are equal exactly if their last
names are: names compare whole blocks, never hashes, so nothing collides.

A block that very many documents share doesn't meet in one task: occurrences are first grouped within each input task (the
group is never larger than what that task read), and only one row for each task and block travels on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.llm.common import pin, row_mark, text_or_empty, without

BLOCK_BYTES = 4096


def name_items(items: DataFrame, key: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """(carry..., occ, name): items with equal keys get one name, the smallest of their occurrence numbers ``occ``."""
    rows = F.collect_list(F.struct("occ", *carry))
    local = (
        items.withColumn("_task", F.spark_partition_id())
        .groupBy(*key, "_task")
        .agg(rows.alias("_rows"))
        .withColumn("_low", F.array_min(F.transform("_rows", lambda r: r["occ"])))
    )
    names = (
        local.groupBy(*key)
        .agg(F.min("_low").alias("name"), F.collect_list("_low").alias("_lows"))
        .select("name", F.explode("_lows").alias("_low"))
    )
    return local.select("_low", "_rows").join(names, "_low").select("name", F.inline("_rows"))


def exact_groups(docs: DataFrame, text: str = "text", carry: dict[str, Column] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, and the columns of ``carry`` (expressions over ``docs``).

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest doc_id stays; among
    rows that share it exactly one does. A null doc_id is smaller than any other. An empty table gives no rows.
    """
    carry = carry or {}
    thin = ["rid", "doc_id", "n", "pos", *carry]
    source = docs.select(
        F.col("doc_id"), text_or_empty(text).cast("binary").alias("_bytes"), *[c.alias(k) for k, c in carry.items()]
    ).withColumn("rid", F.monotonically_increasing_id())
    source = source.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("_bytes") / block_bytes)).cast("int"))
    cut = f"transform(sequence(0, n - 1), i -> substring(_bytes, i * {block_bytes} + 1, {block_bytes}))"
    blocks = source.select(
        "rid", "doc_id", "n", F.posexplode(F.expr(cut)).alias("pos", "block"),
        *carry,
    )
    # Carried values stay with the first block alone.
    blocks = blocks.select(
        "rid", "doc_id", "n", "pos", "block", *[F.when(F.col("pos") == 0, F.col(k)).alias(k) for k in carry]
    ).withColumn("occ", F.monotonically_increasing_id())
    # The hash goes first because comparing it is quick; the block itself decides.
    level = pin(name_items(blocks.withColumn("h", F.xxhash64("block")), ["h", "block"], thin))
    most = level.agg(F.max("n")).first()[0] or 1
    whole = [level.where("n = 1").select("rid", "doc_id", "n", "name", *carry)]
    heads = level.where("n > 1 and pos = 0").select("rid", F.col("doc_id"), F.col("n"), *carry)
    now = level.where("n > 1").select("rid", "pos", F.col("n").alias("left_n"), "name", "occ")
    tops = []
    for _ in range(math.ceil(math.log2(most))):
        pairs = now.groupBy("rid", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max("left_n").alias("left_n"),
            F.min("occ").alias("occ"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
        )
        pairs = pairs.withColumn("left_n", F.ceil(F.col("left_n") / 2).cast("int"))
        level = pin(name_items(pairs, ["first", "second"], ["rid", "pos", "left_n"]))
        tops.append(level.where("left_n = 1").select("rid", "name"))
        now = level.where("left_n > 1").select("rid", "pos", "left_n", "name", "occ")
    if tops:
        top = tops[0]
        for x in tops[1:]:
            top = top.unionByName(x)
        whole.append(heads.join(top, "rid").select("rid", "doc_id", "n", "name", *carry))
    ids = whole[0] if len(whole) == 1 else whole[0].unionByName(whole[1])
    ids = pin(ids)
    groups = pin(
        ids.groupBy("n", "name").agg(F.max(F.struct("doc_id", "rid")).alias("_best"), F.count("*").alias("group_size"))
    )
    # Both sides are plain tables here, so adaptive execution can split a group that holds many of the rows.
    return ids.join(groups, ["n", "name"]).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("_best.rid")).alias("kept"),
        *carry,
    )


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row for each different text, all columns kept: the one with the largest doc_id."""
    marks = exact_groups(docs, text, {"mark": row_mark(text)}).where("group_size > 1")
    gone = marks.groupBy(F.col("doc_id").alias("id"), "mark").agg(
        F.max("kept").alias("keep_one"), F.count("*").alias("_rows")
    )
    # Where an id is not repeated, its kept row needs no second look.
    gone = gone.where("not keep_one or _rows > 1").select("id", "mark", "keep_one")
    return without(docs, gone, text=text)
