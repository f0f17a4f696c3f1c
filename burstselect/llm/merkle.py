"""A Merkle manifest of a dataset: one digest for all rows, and for each row a proof that it belongs to it.

Rows are leaves. Those of a partition, in ascending order, are paired level by level until one digest is left; the digests of all partitions,
in order, are paired the same way up to the root. A node's digest is that of its children's, so the tree is a graph addressed by
content: the store maps a digest to the digests of its children, and equal subtrees are stored once.

A proof is found by descent. The digits of a leaf's rank, to the base of two, tell at each node which child to follow; what isn't selected
is collected, and the path, reversed, is the proof. Records of LEVELS levels are stored together under the digest at their top, as a
page, so a digit of the rank to the base of 2^LEVELS selects the next page: the requests of a whole page travel as one row, and each round is
an equality join by digest. Rounds grow with the logarithm of the table; no task holds more than a page and its requests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.llm.common import pin, tidy

LEVELS = 8

NODE = "tree bigint, place bigint"
STEP = "array<struct<digest: string, before: boolean>>"
RECORDS = "array<struct<digest: string, children: array<string>>>"
_RECORDS = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
_STEP = pa.list_(pa.struct([("digest", pa.string()), ("before", pa.bool_())]))


def field(value: Column) -> Column:
    """How a value enters a leaf: ``-`` if null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row from its values."""
    return digest(*map(field, values))


def parent(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def folded(leaf_digest: Column | str, siblings: Column | str) -> Column:
    """The root that follows from a leaf and its siblings, from the leaf upwards; null siblings stand for none on that level."""
    leaf_digest, siblings = (F.col(x) if isinstance(x, str) else x for x in (leaf_digest, siblings))
    missing = lambda s: s["digest"].isNull()
    step = lambda d, s: digest(F.when(missing(s), d).when(s["before"], F.concat(s["digest"], d)).otherwise(F.concat(d, s["digest"])))
    return F.aggregate(siblings, leaf_digest, step)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: (tree, place, what was carried); ``trees``: (tree, its partition, subroot, rounds, depth); ``store``: (digest, records)."""

    leaves: DataFrame
    trees: DataFrame
    store: DataFrame
    root: str | None


def numbered(rows: DataFrame, part: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``tree``, the number of its ``part`` in ascending order, null first, and ``place``, its number in the part.

    Rows are sorted by range; each task numbers its stretch, and a small table with one row for each task corrects that.
    """
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, tree, place = TaskContext.get().partitionId(), (), -1, 0
        for batch in batches:
            trees, places = [], []
            for value in batch.column(part).to_pylist():
                if last != (value,):
                    last, tree, place = (value,), tree + 1, 0
                trees.append(tree)
                places.append(place)
                place += 1
            more = [pa.array([task] * len(trees), pa.int64()), pa.array(trees, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "task", "tree", "place"])

    order = [F.col(part).asc_nulls_first(), *order]
    dealt = pin(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(over), f"{kinds}, task bigint, tree bigint, place bigint"))
    ends = dealt.groupBy("task").agg(
        F.min(F.struct("tree", F.col(part).alias("part"))).alias("first"),
        F.max(F.struct("tree", "place", F.col(part).alias("part"))).alias("last"),
    )
    shifts, now, trees, places = [], (), 0, 0
    for row in ends.orderBy("task").collect():
        follows = now == (row["first"]["part"],)
        if now and not follows:
            trees, places = trees + 1, 0
        shifts.append((row["task"], trees, places))
        places = row["last"]["place"] + 1 + (places if row["last"]["tree"] == 0 else 0)
        trees += row["last"]["tree"]
        now = (row["last"]["part"],)
    shift = rows.sparkSession.createDataFrame(shifts, "task bigint, trees bigint, places bigint")
    moved = dealt.join(F.broadcast(shift), "task")
    place = F.when(F.col("tree") == 0, F.col("places")).otherwise(F.lit(0)) + F.col("place")
    return moved.select((F.col("tree") + F.col("trees")).alias("tree"), place.alias("place"), *names)


def _grown(nodes: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From nodes (tree, place, digest) and (tree, n): tops (tree, digest, rounds, depth) and pages (tree, round, place, digest, records)."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, records = [], []
            for members, n in zip(batch.column("members").to_pylist(), batch.column("n").to_pylist(), strict=True):
                level, made = [m["digest"] for m in members], {}
                for _ in range(min(LEVELS, (n - 1).bit_length())):
                    pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
                    level = [parent(p) for p in pairs]
                    made.update(zip(level, pairs, strict=True))
                tops.append(level[0])
                records.append([{"digest": d, "children": c} for d, c in made.items()])
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("place"), pa.array(tops, pa.string()), pa.array(records, _RECORDS)], ["tree", "place", "digest", "records"])

    most = counts.agg(F.max("n")).first()[0] or 0
    made, tops, done = [], [], 0
    while True:
        blocks = nodes.groupBy("tree", F.expr(f"shiftright(place, {LEVELS})").alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("members"))
        blocks = blocks.join(counts, "tree")
        done += 1
        now = pin(blocks.mapInArrow(tidy(pages), f"{NODE}, digest string, records {RECORDS}"))
        made.append(now.withColumn("round", F.lit(done)))
        left = F.expr(f"shiftright(n - 1, {LEVELS}) + 1")
        met = now.select("tree", "place", "digest").join(counts, "tree")
        levels = F.expr("if(n > 1, length(bin(n - 1)), 0)") + LEVELS * (done - 1)
        tops.append(met.where(left == 1).select("tree", "digest", F.lit(done).alias("rounds"), levels.alias("depth")))
        most = ((most - 1) >> LEVELS) + 1
        if most <= 1:
            break
        nodes = met.where(left > 1).select("tree", "place", "digest")
        counts = counts.where(left > 1).select("tree", left.alias("n"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return pin(union(tops)), union(made)


def manifest(rows: DataFrame, part: str, order: Sequence[str], leaf_digest: str = "leaf") -> Manifest:
    """The manifest of ``rows``, which have their digest in ``leaf_digest``: a tree for each value of ``part`` over the rows ascending by ``order``.

    Null is a value of ``part`` and of ``order``, the first one. Rows that ``order`` doesn't tell apart go by their digest, so repeated rows are
    leaves of their own and the root doesn't depend on how the table is stored. An empty table has no root. The columns tree, place, task,
    subroot, root and siblings are this operator's own; others are kept.
    """
    taken = {"tree", "place", "task", "salt", "trees", "places"} & {c.lower() for c in rows.columns}
    if taken:
        raise ValueError(f"rename {sorted(taken)} first")
    rows = pin(rows.withColumn("salt", F.monotonically_increasing_id()))
    leaves = pin(numbered(rows, part, [*(F.col(c).asc_nulls_first() for c in order), F.col(leaf_digest), F.col("salt")]).drop("salt"))
    counts = pin(leaves.groupBy("tree").agg(F.count("*").alias("n"), F.first(part).alias(part)))
    tops, pages = _grown(leaves.select("tree", "place", F.col(leaf_digest).alias("digest")), counts.select("tree", "n"))
    trees = pin(tops.join(counts.select("tree", part), "tree"))
    above = trees.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), "digest")
    top, over = _grown(above, above.groupBy("tree").agg(F.count("*").alias("n")))
    found = top.first()
    store = pages.select("digest", "records").unionByName(over.select("digest", "records")).where(F.size("records") > 0).dropDuplicates(["digest"])
    trees = trees.withColumnRenamed("digest", "subroot").withColumn("top_rounds", F.lit(found["rounds"] if found else 0)).withColumn("top_depth", F.lit(found["depth"] if found else 0))
    return Manifest(leaves, trees, pin(store), found["digest"] if found else None)


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The requests of one page a row: from the page's top by the lowest digits of their places, down as many levels as the page has."""
    names = ["tree", "place", "digest", "path", "top", "depth", "carried"]
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("tree", "levels", "digest", "path", "top", "depth", "records", "requests"))
        for tree, levels, page, path, top, depth, records, requests in zip(*columns, strict=True):
            children = {r["digest"]: r["children"] for r in records or ()}
            for request in requests:
                now, passed = page, list(path)
                for k in range(levels - 1, -1, -1):
                    digit, pair = (request["place"] >> k) & 1, children[now]
                    passed.append({"digest": pair[1 - digit] if len(pair) == 2 else None, "before": digit == 1})
                    now = pair[digit]
                rows.append((tree, request["place"], now, passed, top, depth, request["carried"]))
        carried = batch.schema.field("requests").type.value_type.field("carried").type
        kinds = [pa.int64(), pa.int64(), pa.string(), _STEP, pa.string(), pa.int32(), carried]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _walk(tops: DataFrame, requests: DataFrame, store: DataFrame, most: int, kind: str) -> DataFrame:
    """(tree, place, digest, path, top, carried): ``requests`` (tree, place, carried) from the tops (tree, digest, path, rounds, depth) on."""
    none = F.lit(None).cast("string")
    asked = [requests.select("tree", "place", "carried")]
    for _ in range(most - 1):
        asked.append(asked[-1].select("tree", F.expr(f"shiftright(place, {LEVELS})").alias("place")).distinct().withColumn("carried", none))
    begin = tops.select("tree", F.lit(0).cast("bigint").alias("place"), "digest", "path", F.col("digest").alias("top"), "depth", "rounds")
    front = None
    for r in range(most, 0, -1):
        here = begin.where(F.col("rounds") == r).drop("rounds")
        front = here if front is None else front.unionByName(here)
        pages = asked[r - 1].groupBy("tree", F.expr(f"shiftright(place, {LEVELS})").alias("page")).agg(F.collect_list(F.struct("place", "carried")).alias("requests"))
        met = front.join(pages.withColumnRenamed("page", "place"), ["tree", "place"])
        # The page at a tree's top has what is left of its depth, the others LEVELS levels.
        levels = F.least(F.lit(LEVELS), F.col("depth") - LEVELS * (r - 1)).alias("levels")
        met = met.join(store, "digest", "left").select("tree", levels, "digest", "path", "top", "depth", "records", "requests")
        schema = f"{NODE}, digest string, path {STEP}, top string, depth int, carried {kind if r == 1 else 'string'}"
        front = met.mapInArrow(tidy(_descend), schema)
        if r > 1:
            front = pin(front.drop("carried"))
    return front


def proofs(made: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """One row for each of ``leaves`` (all of the manifest unless some of its rows are given): its columns, subroot, root and siblings.

    ``siblings`` are the digests that aren't on the leaf's path, from the leaf upwards to the root: (digest, before), where ``before`` tells
    that the sibling stands first; digest is null on a level without one. `folded` leads from a leaf and them to the root.
    """
    leaves = made.leaves if leaves is None else leaves
    carried = [c for c in leaves.columns if c not in ("tree", "place")]
    info = made.trees.agg(F.max("rounds"), F.max("top_rounds"), F.max("top_depth")).first()
    if made.root is None:
        return leaves.select(*carried, F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(STEP).alias("siblings")).where("1 = 0")
    spark = leaves.sparkSession
    start = spark.createDataFrame([(0, made.root, [], info[1], info[2])], f"tree bigint, digest string, path {STEP}, rounds int, depth int")
    wanted = leaves.select("tree").distinct()
    above = made.trees.join(wanted, "tree").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), F.lit(None).cast("string").alias("carried"))
    tops = _walk(start, above, made.store, info[1], "string").select(F.col("place").alias("tree"), "digest", "path")
    tops = pin(tops.join(made.trees.select("tree", "rounds", "depth"), "tree"))
    payload = F.struct(*[F.col(f"`{c}`") for c in carried])
    kind = leaves.select(payload.alias("carried")).schema["carried"].dataType.simpleString()
    found = _walk(tops, leaves.select("tree", "place", payload.alias("carried")), made.store, info[0], kind)
    return found.select("carried.*", F.col("top").alias("subroot"), F.lit(made.root).alias("root"), F.reverse("path").alias("siblings"))
