"""Near duplicates by SimHash and deletion-variant signatures.

A fingerprint has 64 bits; two documents are linked when theirs differ in at most three. Cut into two segments of 32 bits, at
least one segment of a linked pair differs by at most one bit. Each segment is therefore indexed whole and once for each bit
with that bit as a wildcard; equal variants meet in an equality join, where all 64 bits are compared.

Only different fingerprints enter the index, so copies cost one row however many there are. A wildcard variant joins
fingerprints that have 0 in that place with those that have 1, the whole variant those with an equal segment: no pair is
met twice for one segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.llm.blocks import Judge, block_keys, crowd_nodes, fingerprints, hashed, hub_pairs, mixed, rest_pairs, starts_of
from burstselect.llm.common import arrow_map, bytes_of, pin, row_mark, slices, tidy, without
from burstselect.llm.components import components
from burstselect.session import scratch_path, short_lived_shuffles

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Of sets of shingles: words of 64 bits of the fingerprint, blocks, votes in a block, and bits in which like sets may differ: at 0.8 they
#: differ in 29 of 192 on average, with a deviation of 5.
WIDE = 3
BLOCKS = 8
VOTES = 4
MOST_APART = 55
#: Shingles that come last in the order of prefixes, at most; the sample (one text of so many) that shows them; nodes of a shared shingle that are
#: paired at once, and rows from which it is left to cells without looking further.
COMMON = 100_000
SAMPLED = 16
MEET = 64
HELD = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_runs(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some megabytes at a time, so that a very long text needs little memory."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles. Fewer words than a shingle: the whole sequence; none: zero."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_runs(text):
        words = tail + words
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            m = len(words) - shingle + 1
            hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, m)
            for i in range(0, m, 1 << 16):
                part = hashes[i : i + (1 << 16)].view(np.uint8)
                ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
            n += m
            tail = words[-(shingle - 1) :] if shingle > 1 else []
        else:
            tail = words
    if not n:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with its text replaced by the fingerprint (long)."""
    rest = [c for c in docs.columns if c != text]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in bytes_of(batch, text)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(prints)], [*rest, name])

    fields = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` bigint"])
    return arrow_map(docs.withColumn(text, F.col(text).cast("string")), schema, text, work)


def linked(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a pair of fingerprints that differ in at most ``max_bits`` (3) bits, for a table of different fingerprints ``fp``."""
    if max_bits > 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")
    low32 = 0xFFFFFFFF
    # slot: 33 for each segment; 0 is the whole segment, i the one whose bit i - 1 is a wildcard.
    slots = prints.select("fp", F.explode(F.expr("sequence(0, 65)")).alias("slot"))
    slots = slots.withColumn("bit", F.expr("cast(slot % 33 - 1 as int)")).withColumn(
        "seg", F.expr(f"shiftrightunsigned(fp, 32 * cast(slot div 33 as int)) & {low32}L")
    )
    mask = F.expr("if(bit < 0, 0L, shiftleft(1L, bit))")
    slots = slots.select(
        "fp",
        F.expr("bit < 0").alias("whole"),
        F.expr("bit >= 0 and (shiftrightunsigned(seg, bit) & 1) = 1").alias("one"),
        (F.shiftleft(F.col("slot").cast("long"), 32).bitwiseOR(F.col("seg").bitwiseAND(F.bitwise_not(mask)))).alias("variant"),
    )
    zeros = slots.where("whole or not one").select("variant", "whole", F.col("fp").alias("a"))
    ones = slots.where("whole or one").select("variant", F.col("fp").alias("b"))
    # Spark sizes what an explode returns like what goes in, and would broadcast tens of rows for each fingerprint.
    met = zeros.hint("merge").join(ones.hint("merge"), "variant")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return met.where(near & (~F.col("whole") | (F.col("a") < F.col("b")))).select("a", "b")


def near_groups(docs: DataFrame, text: str = "text", max_bits: int = MAX_BITS, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id, and the columns named in ``carry``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked; component_id is the smallest doc_id that can be
    reached. Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is never the smallest
    unless the group has no other. An empty table gives no rows.
    """
    carry = carry or []
    prints = pin(with_fingerprint(docs.select("doc_id", *carry, text), text, "fp"))
    nodes = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(linked(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    rooted = pin(rooted)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # Both sides are plain tables, so that a fingerprint with many copies can be split.
    labels = pin(rooted.select("fp", "root").join(lows, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id", *carry)


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the different hashes of each text's word shingles, ascending. Fewer words: the whole sequence; none: no hash."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    words = hashed([w for x in split for w in x])
    # Each word starts a run of words; one that would leave its text is no shingle, unless the whole text is shorter than one.
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    runs = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(shingle, np.uint64)])
    for k in range(shingle):
        runs = np.where(left > k, mixed(runs * np.uint64(3) + padded[k : k + len(words)] + np.uint64(k)), runs)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.arange(len(words)) == starts_of(sizes)[owner]
    whole = (left >= shingle) | (first & (sizes[owner] < shingle))
    owner, runs = owner[whole], runs[whole]
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (runs[1:] != runs[:-1])
    return runs[new], np.bincount(owner[new], minlength=len(sizes))


def common_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that several texts of a sample of rows (mark, text) have, by hash; COMMON at most, the most common ones."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashes, _ = shingle_hashes(bytes_of(part, "text"), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    sample = rows.where(F.pmod("mark", F.lit(SAMPLED)) == 0).select(F.col("text").cast("string").alias("text"))
    counted = pin(sample.mapInArrow(tidy(over), "hash bigint").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    least, total = 0, 0
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("hashes")).collect(), key=lambda r: -r.n):
        total += r.hashes
        if total > COMMON:
            least = r.n + 1
            break
    found = counted.where(F.col("n") >= least).collect()
    hashes, counts = np.array([r.hash for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def first_shingles(hashes: np.ndarray, sizes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): so many of each set's shingles that two sets of the similarity have one of these in common, whatever the sets.

    All sets put their shingles in the same order, common ones last, and take the first ones. The hashes of a set are ascending.
    """
    listed, counts = common
    last = np.zeros(len(hashes), np.int64)
    if len(listed):
        place = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
        last = np.where(listed[place] == hashes, counts[place], 0)
    order = np.lexsort((hashes, last, np.repeat(np.arange(len(sizes)), sizes)))
    some = np.minimum(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, sizes)
    at = np.arange(len(hashes)) - np.repeat(starts_of(sizes), sizes)
    return hashes[order][at < np.repeat(some, sizes)], some


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set its size and a bit string: a power of two of places, no fewer than members, each the parity of the members that fall there."""
    places = 1 << np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)
    begins, owner = starts_of(places), np.repeat(np.arange(len(sizes)), sizes)
    odd = np.bincount(begins[owner] + (hashes & (places[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=places.sum()) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [n.to_bytes(8, "little") + bits[a // 8 : (a + w) // 8] for n, a, w in zip(sizes.tolist(), begins.tolist(), places.tolist(), strict=True)]


class SketchJudge(Judge):
    """Tells by `sketches` which sets may have the Jaccard similarity. Each member that one of two sets lacks changes one place, so none that has it is lost."""

    decides = False

    def __init__(self, similarity: float):
        self.most = (1 - similarity) / (1 + similarity)

    def near(self, p: bytes, q: bytes) -> bool:
        if len(p) > len(q):
            p, q = q, p
        most = (int.from_bytes(p[:8], "little") + int.from_bytes(q[:8], "little")) * self.most + 1e-9
        width = len(q) - 8
        x, y = int.from_bytes(p[8:], "little"), int.from_bytes(q[8:], "little")
        while width > len(p) - 8:
            width //= 2
            y = (y >> (8 * width)) ^ (y & ((1 << (8 * width)) - 1))
        return (x ^ y).bit_count() <= most

    def alike(self, one: Sequence[bytes], two: Sequence[bytes]) -> np.ndarray:
        return np.array([self.near(p, q) for p, q in zip(one, two, strict=True)], bool)


SIGNED = "node bigint, size bigint, sign array<bigint>, keys array<bigint>, first array<bigint>, sketch binary"


def signed(docs: DataFrame, text: str, shingle: int, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """``docs`` with its text replaced by ``node``, the name of its set of shingles, ``size``, ``sign`` (the set's SimHash), ``keys`` (its blocks),
    ``first`` (its `first_shingles`) and ``sketch``."""
    rest = [c for c in docs.columns if c != text]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, sizes = shingle_hashes(bytes_of(batch, text), shingle)
        cuts = np.cumsum([0, *sizes])
        names = [xxhash.xxh64_intdigest(shingles[a:b].tobytes(), SEED) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        some = sizes > 0
        signs, keys = np.zeros((len(sizes), WIDE), np.int64), np.zeros((len(sizes), BLOCKS), np.int64)
        if some.any():
            signs[some], keys[some] = fingerprints(shingles, sizes[some], WIDE), block_keys(shingles, sizes[some], BLOCKS, VOTES)
        listed = lambda rows, width, n: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]) * width, pa.int32()), pa.array(rows.ravel()))
        first, taken = first_shingles(shingles, sizes, common, similarity)
        columns = [
            pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes.astype(np.int64)),
            listed(signs, WIDE, np.ones(len(sizes), np.int64)), listed(keys[some], BLOCKS, some),
            listed(first.view(np.int64), 1, taken), pa.array(sketches(shingles, sizes), pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, "node", "size", "sign", "keys", "first", "sketch"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                yield work(part)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(tidy(over), ", ".join([*fields, SIGNED]))


def texts_of(docs: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the sets (node), by the text of one document of each; a text is shorter than its shingles."""
    asked = names.select("node", "doc_id", "mark").join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at"))
    asked = asked.select("node", F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark"))
    rows = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return rows.groupBy("node").agg(F.first(F.col("text").cast("string")).alias("text"))


def in_common(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted hashes, have the Jaccard similarity."""
    place = np.searchsorted(p, q)
    common = int((p[np.minimum(place, len(p) - 1)] == q).sum()) if len(p) else 0
    return common >= similarity * (len(p) + len(q) - common) - 1e-9


class JaccardJudge(Judge):
    """Judges sets, given as the bytes of their sorted hashes, by their Jaccard similarity."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def alike(self, one: Sequence[bytes], two: Sequence[bytes]) -> np.ndarray:
        of = lambda x: np.frombuffer(x, np.uint64)
        return np.array([in_common(of(p), of(q), self.similarity) for p, q in zip(one, two, strict=True)], bool)


def set_contents(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, content) of sets (node, text): the bytes of their sorted hashes."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashes, sizes = shingle_hashes(bytes_of(part, "text"), shingle)
                cuts = np.cumsum([0, *sizes])
                packed = [hashes[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(packed, pa.binary())], ["node", "content"])

    return texts.select("node", "text").mapInArrow(tidy(over), "node bigint, content binary")


def jaccard_pairs(docs: DataFrame, names: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard similarity, counted over all their shingles, is ``similarity`` or more."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = pin(texts_of(docs, names, ends))
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text_b", 2 << 20):
                # A hub comes many times, its shingles are made once.
                hubs = some.column("a").dictionary_encode()
                at = hubs.indices.to_numpy()
                whose = np.unique(at, return_index=True)[1]
                x, sizes_x = shingle_hashes(bytes_of(some.take(pa.array(whose)), "text_a"), shingle)
                y, sizes_y = shingle_hashes(bytes_of(some, "text_b"), shingle)
                cuts_x, cuts_y, near = np.cumsum([0, *sizes_x]), np.cumsum([0, *sizes_y]), []
                for k, i in enumerate(at):
                    p, q = x[cuts_x[i] : cuts_x[i + 1]], y[cuts_y[k] : cuts_y[k + 1]]
                    near.append(in_common(p, q, similarity))
                yield some.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(close), "a bigint, b bigint")


def _in_shared_shingles(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of nodes of different groups that share a first shingle and may have the similarity by their sizes and the places of the shingle in them.

    Rows come in the order of (block, root, node), a block for each shingle. Of blocks of more than MEET nodes (block, node) come, ``crowded``.
    """
    names = ("block", "root", "node", "size", "pos")

    def whole(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.append(True, rows["block"][1:] != rows["block"][:-1])
        once = new | np.append(True, rows["node"][1:] != rows["node"][:-1])
        rows = {c: x[once] for c, x in rows.items()}
        begins = np.flatnonzero(new[once])
        lengths = np.diff(np.append(begins, len(rows["node"])))
        # Rows of a block are in the order of their groups.
        ends = begins + lengths - 1
        mixed_groups = rows["root"][begins] != rows["root"][ends]
        crowd = np.repeat(mixed_groups & (lengths > MEET), lengths)
        yield _ends(rows["block"][crowd], rows["node"][crowd], True)
        few = np.repeat(mixed_groups & (lengths <= MEET), lengths)
        rows = {c: x[few] for c, x in rows.items()}
        at = np.arange(len(few[few]))
        for k in range(1, MEET):
            at = at[at + k < len(rows["block"])]
            at = at[rows["block"][at] == rows["block"][at + k]]
            if not len(at):
                break
            one, two = ({c: x[i] for c, x in rows.items()} for i in (at, at + k))
            small, large = np.minimum(one["size"], two["size"]), np.maximum(one["size"], two["size"])
            # If this is the first that they share, no more than what follows can be shared.
            most = np.minimum(one["size"] - one["pos"], two["size"] - two["pos"])
            fit = (one["root"] != two["root"]) & (small >= large * similarity - 1e-9) & (most >= (small + large) * similarity / (1 + similarity) - 1e-9)
            yield _ends(np.minimum(one["node"], two["node"])[fit], np.maximum(one["node"], two["node"])[fit], False)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, long = {c: np.empty(0, np.int64) for c in names}, None  # a block that is not known to be whole; one that goes on and is crowded
        for batch in batches:
            rows = {c: np.concatenate([kept[c], batch.column(c).to_numpy().astype(np.int64)]) for c in names}
            if long is not None:
                more = rows["block"] == long
                yield _ends(rows["block"][more], rows["node"][more], True)
                rows = {c: x[~more] for c, x in rows.items()}
            if not len(rows["block"]):
                kept = rows
                continue
            last = len(rows["block"]) - int((rows["block"] == rows["block"][-1]).sum())
            if last:
                yield from whole({c: x[:last] for c, x in rows.items()})
            kept, long = {c: x[last:] for c, x in rows.items()}, None
            if len(kept["block"]) > HELD:
                long = kept["block"][0]
                yield _ends(kept["block"], kept["node"], True)
                kept = {c: x[:0] for c, x in kept.items()}
        if len(kept["block"]):
            yield from whole(kept)

    return over


def _ends(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], ["a", "b", "crowded"])


def unmet_pairs(names: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b), a < b, of sets that may have the similarity and are not in one group (node, root) yet; no pair that has it is missing.

    Two sets of the similarity share one of their `first_shingles`, so sets meet in an equality join on these. Their `sketches` drop most pairs
    that don't have it. A shingle of more than MEET sets of different groups is dealt to cells (`rest_pairs`).
    """
    spark, folder = names.sparkSession, scratch_path(names.sparkSession, "shared")
    sets = pin(names.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("content")))
    rooted = names.select("node", "size", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rooted.select("root", "node", F.col("size").cast("int").alias("size"), F.posexplode("first").alias("pos", "block"))
    dealt = rows.repartition("block").sortWithinPartitions("block", "root", "node")
    found = dealt.mapInArrow(tidy(_in_shared_shingles(similarity)), "a bigint, b bigint, crowded boolean")
    found.write.partitionBy("crowded").parquet(folder)
    pairs = spark.read.schema("a bigint, b bigint, crowded boolean").parquet(folder).where("not crowded").select("a", "b").distinct()
    side = lambda x: sets.select(F.col("node").alias(x), F.col("content").alias(f"content_{x}"))
    judge = SketchJudge(similarity)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = judge.alike(batch.column("content_a").to_pylist(), batch.column("content_b").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "content_a", "content_b")
    met = met.mapInArrow(tidy(likely), "a bigint, b bigint")
    rest = rest_pairs(folder, sets, roots, [], similarity, 0, sets.select("node", "content"), judge, 1)
    return pin(met.unionByName(rest).distinct())


def alike(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, mark, component_id) for the rows of ``docs`` and their near copies: sets of word shingles with the Jaccard similarity.

    Equal sets are one node. Others are candidates if they share a block of their SimHash (`blocks`); the whole fingerprints drop those that
    can't be alike, and the sets decide. That finds nearly all links and the large groups. At a similarity of exactly 0.8 a pair shares one of eight
    blocks in 98.5 % of cases; so sets that are not in one group by then meet once more by their first shingles (`unmet_pairs`), which no
    pair of the similarity escapes.
    """
    with short_lived_shuffles(docs.sparkSession):
        names, labels = _labels(docs, text, shingle, similarity)
    return names.select("doc_id", "mark", "node").join(labels, "node").select("doc_id", "mark", "component_id")


def _labels(docs: DataFrame, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as `signed` has them, and (node, component_id) of their sets; written."""
    rows = docs.select("doc_id", row_mark(text).alias("mark"), F.col(text).alias("text"))
    names = pin(signed(rows, "text", shingle, common_shingles(rows, shingle), similarity))
    nodes = names.groupBy("node").agg(F.min("doc_id").alias("low"))
    words = [f"sign_{w}" for w in range(WIDE)]
    signs = [F.col("sign")[w].alias(name) for w, name in enumerate(words)]
    sets, crowd = names.select("node", "size", "keys", *signs), scratch_path(docs.sparkSession, "crowded")
    pairs = hub_pairs(sets, words, similarity, MOST_APART, [], 2, crowd)
    roots = pin(components(jaccard_pairs(rows, names, pairs, shingle, similarity)))
    # Sets of one block that are not in one group yet have met no more than its hubs.
    contents = set_contents(texts_of(rows, names, crowd_nodes(docs.sparkSession, crowd)), shingle)
    more = rest_pairs(crowd, sets, roots, words, similarity, MOST_APART, contents, JaccardJudge(similarity), 8)
    roots = _joined(roots, more)
    roots = _joined(roots, pin(jaccard_pairs(rows, names, unmet_pairs(names, roots, similarity), shingle, similarity)))
    rooted = pin(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return names, pin(rooted.select("node", "root").join(lows, "root").select("node", "component_id"))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The groups (node, root) with further links (a, b)."""
    if more.isEmpty():
        return roots
    return pin(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))


def drop_near_copies(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest doc_id; all columns kept.

    Where several rows share that doc_id, the one with the smallest text mark stays, once. Rows of a group without any
    doc_id stay as they are, since nothing tells them apart. Null and empty texts are alike.
    """
    groups = alike(docs, text, shingle, similarity)
    rows = groups.groupBy("component_id", F.col("doc_id").alias("id"), "mark").agg(F.count("*").alias("rows"))
    rows = pin(rows.where("component_id is not null"))
    first = rows.where("id = component_id").groupBy("id").agg(F.min("mark").alias("first_mark"))
    gone = rows.join(first.withColumnRenamed("id", "component_id"), "component_id").select(
        "id", "mark", (F.col("id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first_mark"))).alias("keep_one"), "rows"
    )
    return without(docs, gone.where("not keep_one or rows > 1").select("id", "mark", "keep_one"), text=text)
