"""Candidates among sets of hashes: blocks that like sets have in common, an equality join on them, and hubs.

A set's SimHash has one vote of each element in every bit. Between sets of similarity 0.8 each bit turns with 15 to 20 %, so blocks
of it that are safe by the pigeonhole principle have four bits and tell nothing apart. Here a block is voted by few elements alone, those
that come first in the block's own random order, and it stays the same as long as those few do: the chance is a power of the sets'
similarity, whatever the size of the table. With several blocks, each with another order, like sets share one almost surely. The whole
SimHash then drops pairs that can't be alike, before anything longer than a fingerprint travels.

All rows of a block are first compared with its hubs, the first few of its nodes, and links are followed in chains. Blocks with more nodes than
hubs are crowded: all their nodes that are not in one group by then are compared with each other (`rest_pairs`), so every pair that shares a
block is either judged or in one group already. Copies of one group cost as much as they are; different nodes of a block cost their pairs, in
cells of bounded memory that are dealt to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstselect.llm.common import bit_counts, pin, tidy
from burstselect.session import unpin

#: The share of a sample from which a block is hot, the sample (one node of so many), and the tasks for a hot block.
HOT = 0.002
SAMPLED = 32
SALTS = 64
#: Rows of one side of a cell and bytes of their contents, comparisons made at once, and pairs judged at once.
CELL_ROWS = 32768
#: Rows of cells that are dealt at once, unless there are more nodes than that.
TURN_ROWS = 100_000
CELL_BYTES = 16 << 20
AT_ONCE = 1 << 18
JUDGED = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Another hash of each hash, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(tokens: Sequence) -> np.ndarray:
    """The 64-bit hashes of many strings (all str or all bytes), by their UTF-8 bytes and the places of these; each different one hashed once."""
    if not len(tokens):
        return np.empty(0, np.uint64)
    coded = pa.array(tokens, pa.large_string() if isinstance(tokens[0], str) else pa.large_binary()).dictionary_encode()
    _, offsets, content = coded.dictionary.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1]
    letters, sizes = np.frombuffer(content, np.uint8)[: ends[-1]].astype(np.uint64), np.diff(ends)
    place = (np.arange(len(letters)) - np.repeat(ends[:-1], sizes)).astype(np.uint64)
    some = sizes > 0
    sums = np.zeros(len(sizes), np.uint64)
    if some.any():
        sums[some] = np.add.reduceat(mixed(letters + (place << np.uint64(8)) + _ODD), ends[:-1][some])
    return mixed(sums ^ sizes.astype(np.uint64) * _ODD)[coded.indices.to_numpy()]


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def told_apart(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hashes of each group, where a hash that comes again in it is another one each time."""
    group = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    bits = np.uint64(max(1, len(sizes).bit_length()))
    # The group in the highest bits, the hash in the others: far more of them than a group has members.
    both = (group << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(both, kind="stable")
    same = both[order]
    begins = np.flatnonzero(np.append(True, same[1:] != same[:-1])) if len(same) else np.empty(0, np.int64)
    times = np.empty(len(hashes), np.uint64)
    times[order] = np.arange(len(same)) - np.repeat(begins, np.diff(np.append(begins, len(same))))
    again = times > 0
    out = hashes.copy()
    out[again] = mixed(hashes[again] + times[again] * _ODD)
    return out


def fingerprints(hashes: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """(groups, words): the SimHash of each group of hashes, 64 bits a word, each word from another mixing; no group is empty."""
    out = np.empty((len(sizes), words), np.uint64)
    for w in range(words):
        ones = bit_counts(hashes if w == 0 else mixed(hashes + _ODD * np.uint64(w)), starts_of(sizes))
        out[:, w] = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def block_keys(hashes: np.ndarray, sizes: np.ndarray, blocks: int, votes: int) -> np.ndarray:
    """(groups, blocks): each block of a group is named by the ``votes`` different hashes that are first in its order; no group is empty."""
    out, starts, most = np.empty((len(sizes), blocks), np.uint64), starts_of(sizes), np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(blocks):
        # An odd factor puts the hashes in another order.
        order = hashes * (mixed(np.array([b + 1], np.uint64))[0] | np.uint64(1))
        name = np.full(len(sizes), b + 1, np.uint64)
        for v in range(votes):
            first = np.minimum.reduceat(order, starts)
            name = mixed(name * _ODD + first)
            if v + 1 < votes:
                order = np.where(order == np.repeat(first, sizes), most, order)
        out[:, b] = name
    return out.view(np.int64)


def hub_pairs(
    rows: DataFrame, signs: Sequence[str], ratio: float, most_apart: int, masks: Sequence[str] = (), hubs: int = 2, crowd: str | None = None
) -> DataFrame:
    """Different pairs (a, b), a < b, of a block's hubs and its other nodes that may be alike; written.

    ``rows`` (a written table) are (node, size, keys) and the words of the fingerprint, in columns ``signs``; a node is in any number of them. Sizes
    must have at least the ratio, fingerprints at most ``most_apart`` different bits, and ``masks`` no more than may change (see `_may_be_alike`).
    A block that holds more than HOT of a sample of the rows is dealt to SALTS tasks, each with hubs of its own, which are then compared with one of
    them. ``crowd`` is a folder to which the nodes (block, node) of the blocks are written that have more nodes than meet each other here.
    """
    info = ["node", "size", *signs, *masks]
    keyed = rows.select(*info, F.explode("keys").alias("key"))
    sample = keyed.where(f"pmod(node, {SAMPLED}) = 0")
    least = max(SALTS, int(sample.count() * HOT))
    # At most 1 / HOT blocks.
    hot = [r.key for r in sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()]
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)

    def met(some: DataFrame, block: Column, crowded: bool) -> DataFrame:
        # Fingerprints and sizes travel with the blocks, once and in narrow columns: only likely pairs leave the task, and nothing else is shuffled whole.
        dealt = some.select(*info, block.alias("block")).repartition("block").sortWithinPartitions("block", "node")
        return dealt.mapInArrow(tidy(_beside_hubs(signs, ratio, most_apart, masks, hubs, crowded)), "a bigint, b bigint, crowded boolean")

    near = met(keyed.where(~is_hot), F.col("key"), crowd is not None)
    if hot:
        parts = keyed.where(is_hot).withColumn("block", F.xxhash64("key", F.pmod(F.xxhash64("node"), F.lit(SALTS))))
        near = near.unionByName(met(parts, F.col("block"), False))
        low = F.min(F.struct(*info)).alias("low")
        tops = pin(parts.groupBy("key", "block").agg(low))  # at most SALTS rows a hot block, few from each task
        first = tops.groupBy("key").agg(F.min("low").alias("hub"))
        apart = sum((F.bit_count(F.col(f"low.{s}").bitwiseXOR(F.col(f"hub.{s}"))) for s in signs), F.lit(0))
        sizes = [F.col("low.size"), F.col("hub.size")]
        fit = F.least(*sizes) >= F.greatest(*sizes) * ratio - 1e-9
        both = tops.join(first, "key").where((F.col("low.node") != F.col("hub.node")) & fit & (apart <= most_apart))
        ends = [F.col("low.node"), F.col("hub.node")]
        near = near.unionByName(both.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"), F.lit(False).alias("crowded")))
        if crowd is not None:
            near = near.unionByName(parts.select(F.col("key").alias("a"), F.col("node").alias("b"), F.lit(True).alias("crowded")))
    near = near.distinct()
    if crowd is None:
        return pin(near.select("a", "b"))
    near.write.partitionBy("crowded").parquet(crowd)
    return rows.sparkSession.read.schema("a bigint, b bigint, crowded boolean").parquet(crowd).where("not crowded").select("a", "b")


def crowd_nodes(spark: SparkSession, crowd: str) -> DataFrame:
    """The nodes of the crowded blocks that `hub_pairs` left in ``crowd``."""
    rows = spark.read.schema("a bigint, b bigint, crowded boolean").parquet(crowd).where("crowded")
    return rows.select(F.col("b").alias("node")).distinct()


def rest_pairs(
    crowd: str,
    rows: DataFrame,
    roots: DataFrame,
    signs: Sequence[str],
    ratio: float,
    most_apart: int,
    contents: DataFrame | None = None,
    judge: Judge | None = None,
    bytes_each: int = 0,
) -> DataFrame:
    """Different pairs (a, b), a < b, of the crowded blocks that `hub_pairs` left in ``crowd``, may be alike and are not in one group yet; written.

    ``rows`` are those of `hub_pairs`, ``roots`` (node, root) the groups that its pairs made. All pairs of a block with different roots are compared.
    A block is cut into sides of CELL_ROWS nodes or CELL_BYTES of contents by hash; each two sides meet in a cell, so no task holds more than two
    of them. With ``contents`` (node, content: binary, of about ``bytes_each`` for each member of a row) and a ``judge`` the pairs are judged there, and what comes are links; pairs that
    links of the same cell have put in one group are left out. The rows of all cells may be many times the nodes, as a side meets all others; so cells are dealt
    in turns of about as many rows as there are nodes, and each turn gives its shuffle files back if the session does so (`short_lived_shuffles`).
    """
    members = rows.sparkSession.read.schema("a bigint, b bigint, crowded boolean").parquet(crowd).where("crowded")
    members = members.select(F.col("a").alias("block"), F.col("b").alias("node"))
    few = members.select("node").distinct()
    info = rows.select("node", F.col("size").cast("bigint").alias("size"), *signs).join(few, "node", "left_semi").dropDuplicates(["node"])
    info = info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    info = pin(info)
    found = members.join(info.select("node", "root", (F.col("size") * bytes_each).alias("long")), "node")
    groups = found.groupBy("block").agg(F.count("*").alias("n"), F.sum("long").alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high"))
    sides = F.ceil(F.greatest(F.col("n") / CELL_ROWS, F.col("bytes") / CELL_BYTES)).cast("int").alias("sides")
    open_blocks = pin(groups.where("low < high").select("block", "n", sides))
    again = pin(members.join(open_blocks, "block").select("node").distinct())
    done = [info, open_blocks, again]
    if contents is not None:
        # Contents of the nodes that meet again, each once.
        held = pin(contents.join(again, "node", "left_semi").dropDuplicates(["node"]))
        done.append(held)
    total = open_blocks.agg(F.sum(F.col("n") * F.col("sides"))).first()[0] or 0
    turns = max(1, min(-(-total // max(1, again.count())), -(-total // TURN_ROWS)))
    met = members.join(open_blocks, "block").withColumn("side", F.pmod(F.xxhash64("node"), "sides").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    cells = met.select("block", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "node")
    found = []
    for turn in range(turns):
        some = cells if turns == 1 else cells.where(F.pmod(F.xxhash64("block", "x", "y"), F.lit(turns)) == turn)
        # An explode is sized like its input; what it returns must not be broadcast.
        some = some.hint("merge").join(info, "node")
        if contents is not None:
            some = some.join(held, "node")
        dealt = some.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y")
        found.append(pin(dealt.mapInArrow(tidy(_in_cells(signs, ratio, most_apart, judge)), "a bigint, b bigint").distinct()))
    for table in done:
        unpin(table)
    return found[0] if turns == 1 else pin(reduce(DataFrame.unionByName, found).distinct())


def _may_be_alike(one: dict, two: dict, signs: Sequence[str], ratio: float, most_apart: int, masks: Sequence[str]) -> np.ndarray:
    """Whether rows of two tables of arrays, paired by place or by broadcasting, may be alike.

    A mask has the bits that the elements of a row set: an element that the other row lacks accounts for one bit at most, and alike rows
    lack no more of each other's than the larger one may lose.
    """
    small, large = np.minimum(one["size"], two["size"]), np.maximum(one["size"], two["size"])
    fit = small >= large * ratio - 1e-9
    if masks:
        lost = np.floor(large * (1 - ratio) + 1e-9)
        for left, right in ((one, two), (two, one)):
            fit &= sum(_ones(left[m] & ~right[m]) for m in masks) <= lost
    return fit & (sum(_ones(one[s] ^ two[s]) for s in signs) <= most_apart)


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).astype(np.uint16)


def _arrays(batch: pa.RecordBatch, columns: Sequence[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy().astype(np.int64) for c in columns}


def _beside_hubs(
    signs: Sequence[str], ratio: float, most_apart: int, masks: Sequence[str] = (), hubs: int = 2, crowded: bool | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of rows and the hubs of their block, from rows in the order of (block, node).

    The hubs are a block's first nodes; they and two more go on to the next batch, so a block of any length takes the memory of a batch. With
    ``crowded`` given, a third column tells pairs from the (block, node) of blocks whose nodes do not all meet, which come if it is true.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "node", "size", *signs, *masks)
        kept = {c: np.empty(0, np.int64) for c in names}
        for batch in batches:
            rows = {c: np.concatenate([kept[c], x]) for c, x in _arrays(batch, names).items()}
            if not len(rows["node"]):
                continue
            other = lambda c: np.append(True, rows[c][1:] != rows[c][:-1])
            once = other("block") | other("node")
            rows = {c: x[once] for c, x in rows.items()}
            n = len(rows["node"])
            begins = np.flatnonzero(other("block"))
            lengths = np.diff(np.append(begins, n))
            first = np.repeat(begins, lengths)
            at = np.arange(n)
            later = [at[at > first + h] for h in range(hubs)]
            of, hub = np.concatenate(later), np.concatenate([first[x] + h for h, x in enumerate(later)])
            pick = lambda i: {c: rows[c][i] for c in ("size", *signs, *masks)}
            fit = _may_be_alike(pick(of), pick(hub), signs, ratio, most_apart, masks)
            found = [rows["node"][hub[fit]], rows["node"][of[fit]]]
            if crowded is None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])
            else:
                many = np.repeat(lengths > hubs + 1, lengths) & crowded
                both = [np.concatenate([x, y]) for x, y in zip(found, (rows["block"][many], rows["node"][many]), strict=True)]
                kinds = np.arange(len(both[0])) >= len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*both, kinds)], ["a", "b", "crowded"])
            kept = {c: x[begins[-1] : begins[-1] + hubs + 2] for c, x in rows.items()}

    return over


class Judge:
    """Decides by their contents which rows of a cell are alike; or which may be, and others decide."""

    decides = True

    def masks(self, contents: Sequence[bytes]) -> dict[str, np.ndarray]:
        """Masks of rows (see `_may_be_alike`), by name."""
        return {}

    def alike(self, one: Sequence[bytes], two: Sequence[bytes]) -> np.ndarray:
        """For each pair of contents whether they are alike."""
        raise NotImplementedError


class _Groups:
    """Groups of the rows of a cell, which links put together; they are named by places among ``names``."""

    def __init__(self, roots: np.ndarray):
        self.names = np.unique(roots)
        self.parent, self.flat = np.arange(len(self.names)), True

    def places(self, roots: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, roots)

    def of(self, places: np.ndarray) -> np.ndarray:
        while not self.flat:
            up = self.parent[self.parent]
            self.flat, self.parent = np.array_equal(up, self.parent), up
        return self.parent[places]

    def link(self, one: np.ndarray, two: np.ndarray) -> None:
        for a, b in zip(one.tolist(), two.tolist(), strict=True):
            while self.parent[a] != a:
                a = self.parent[a]
            while self.parent[b] != b:
                b = self.parent[b]
            self.parent[max(a, b)] = min(a, b)
            self.flat = False


def _in_cells(
    signs: Sequence[str], ratio: float, most_apart: int, judge: Judge | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of different roots that may be alike, or that the judge calls alike, from rows in the order of their cells (block, x, y).

    In a cell of one side all rows meet, in a cell of two sides those of one meet those of the other.
    """
    names = ("block", "x", "y", "side", "node", "size", "root", *signs)

    def within(cell: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        masks = judge.masks(cell["content"]) if judge else {}
        # The least size that is like a row's, so that two comparisons of whole numbers tell whether two sizes have the ratio.
        least = np.ceil(cell["size"] * ratio - 1e-9).astype(np.int32)
        groups = _Groups(cell["root"])
        cell = {**cell, **masks, "length": cell["size"].astype(np.int32), "least": least, "root": groups.places(cell["root"])}
        alone = cell["x"][0] == cell["y"][0]
        one = cell if alone else {c: x[cell["side"] == cell["x"]] for c, x in cell.items()}
        two = cell if alone else {c: x[cell["side"] == cell["y"]] for c, x in cell.items()}
        step = max(1, AT_ONCE // max(1, len(two["node"])))
        pick = lambda side, at: {c: side[c][at] for c in ("size", *signs, *masks)}
        for i in range(0, len(one["node"]), step):
            some = {c: one[c][i : i + step, None] for c in ("node", "length", "least", "root", *signs)}
            fit = groups.of(some["root"]) != groups.of(two["root"])
            fit &= (some["length"] >= two["least"]) & (two["length"] >= some["least"])
            if alone:
                fit &= some["node"] < two["node"]
            if not fit.any():
                continue
            fit &= sum(_ones(some[s] ^ two[s]) for s in signs) <= most_apart
            left, right = np.nonzero(fit)
            left += i
            if masks:
                likely = _may_be_alike(pick(one, left), pick(two, right), signs, ratio, most_apart, list(masks))
                left, right = left[likely], right[likely]
            for k in range(0, len(left), JUDGED if judge else len(left) + 1):
                a, b = left[k : k + JUDGED] if judge else left, right[k : k + JUDGED] if judge else right
                if judge:
                    apart = groups.of(one["root"][a]) != groups.of(two["root"][b])
                    a, b = a[apart], b[apart]
                    near = judge.alike(one["content"][a], two["content"][b]) if len(a) else np.zeros(0, bool)
                    a, b = a[near], b[near]
                    if judge.decides:
                        groups.link(one["root"][a], two["root"][b])
                ends = one["node"][a], two["node"][b]
                yield np.minimum(*ends), np.maximum(*ends)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # parts of the cell that is not known to be whole

        def pairs(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in within({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = _arrays(batch, names)
            if judge:
                rows["content"] = np.empty(batch.num_rows, object)
                rows["content"][:] = batch.column("content").to_pylist()
            cell = [rows[c] for c in ("block", "x", "y")]
            if not len(cell[0]):
                continue
            begins = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cell], axis=0)))
            for low, high in zip(begins, np.append(begins[1:], len(cell[0])), strict=True):
                part = {c: x[low:high] for c, x in rows.items()}
                if held and any(held[0][c][0] != part[c][0] for c in ("block", "x", "y")):
                    yield from pairs(held)
                    held = []
                held.append(part)
        if held:
            yield from pairs(held)

    return over
