"""Fuzzy duplicate lines: SimHash of normalised lines, an equality join on blocks, edit similarity, one occurrence of each group.

Lines are normalised (lower case, words of letters and digits, numbers alike); equal normalised lines are alike, and one node. Of others the
blocks of their SimHash meet (`blocks`): a block is voted by few words of the line, so a changed word leaves most blocks as they
are. Candidates whose whole fingerprints are near enough are verified by the edit similarity of their word sequences, and of each
connected group the first occurrence stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.llm.blocks import Judge, block_keys, crowd_nodes, fingerprints, hashed, hub_pairs, mixed, rest_pairs, starts_of, told_apart
from burstselect.llm.common import pin, row_mark, slices, text_or_empty, tidy
from burstselect.llm.components import components
from burstselect.session import scratch_path, short_lived_shuffles, unpin

SIMILARITY = 0.8
#: Blocks, votes in a block, and bits of 64 in which like lines may differ: at 0.8 they differ in 13 on average, with a deviation of 3.2.
#: Lines of SHORT words and fewer have blocks of two votes; lines of LONG words and more have blocks of three, which tell more apart.
BLOCKS = 8
SHORT, LONG = 15, 12
MOST_APART = 27
REMEMBERED = 200_000
#: Nodes of a block that all others of it are compared with at once; larger blocks are settled in a second turn.
HUBS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|\n")
_NUMBER = re.compile(r"\d+")
_ZEROS = re.compile("00+")
#: Stands for a line feed among words; it is no part of any.
BREAK = "\x01"


def normal_words(line: str) -> list[str]:
    """The words of a line: runs of letters and digits, lower-cased, every run of digits as one 0."""
    return _WORD.findall(_NUMBER.sub("0", line.lower()))


def _letters() -> bytes:
    """For each character below 256 what `normal_words` makes of it: itself in lower case, 0 for a digit, else a blank; line feeds become BREAK."""
    plain = lambda c: "0" if c.isdecimal() else c.lower() if _WORD.fullmatch(c) else BREAK if c == "\n" else " "
    return "".join(plain(chr(i)) for i in range(256)).encode("latin-1")


def _tokens(text: str) -> list[str]:
    """The normalised words of a text, and a BREAK for each line feed."""
    try:
        plain = text.encode("latin-1").translate(_PLAIN).decode("latin-1")
    except UnicodeEncodeError:
        text = text.lower()
        return [BREAK if w == "\n" else w for w in _TOKEN.findall(_NUMBER.sub("0", text))]
    if "00" in plain:
        plain = _ZEROS.sub("0", plain)
    return plain.replace(BREAK, f" {BREAK} ").split()


_PLAIN = _letters()


def line_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, size, owner, no) of the lines that have a word, in order: how many words, of which text, which line of it."""
    tokens = [_tokens(t) for t in texts]
    sizes = np.array([len(x) for x in tokens], np.int64)
    flat = [w for x in tokens for w in x]
    breaks = np.array([w == BREAK for w in flat], bool)
    words = hashed(flat)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # Lines are numbered through all texts: a text begins one, and so does what follows a line feed.
    before = np.cumsum(breaks) - breaks
    line = before + owner
    words, line, owner, before = words[~breaks], line[~breaks], owner[~breaks], before[~breaks]
    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), sizes)[breaks], minlength=len(texts)))])
    return words, np.diff(np.append(starts, len(words))), owner[starts], before[starts] - first[owner[starts]]


def line_names(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each line's words in their order."""
    if not len(sizes):
        return np.empty(0, np.int64)
    place = np.arange(len(words)) - np.repeat(starts_of(sizes), sizes)
    named = np.add.reduceat(mixed(words + mixed(place.astype(np.uint64) + np.uint64(1))), starts_of(sizes))
    return mixed(named ^ sizes.astype(np.uint64)).view(np.int64)


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements between two sequences, a row of the table at a time as the bits of one integer."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for x in b:
        same = places.get(x, 0) | down
        straight = (((same & up) + up) ^ up) | same
        plus, minus = down | (~(straight | up) & full), up & straight
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        same = places.get(x, 0) | down
        up, down = minus | (~(same | plus) & full), plus & same
    return distance


def edit_similarity(a: Sequence, b: Sequence) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b), 1)


def within(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sequences have the edit similarity. Equal ends are cut off, and words that the other lacks are counted, before the table is made."""
    allowed = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    n = min(len(a), len(b))
    if max(len(a), len(b)) - n > allowed:
        return False
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= allowed:
        return True
    _, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    kinds = number.max(initial=0) + 1
    more = np.bincount(number[: len(a)], minlength=kinds) - np.bincount(number[len(a) :], minlength=kinds)
    if max(more[more > 0].sum(), -more[more < 0].sum()) > allowed:
        return False
    return edit_distance(a.tolist(), b.tolist()) <= allowed


LINES = "mark bigint, no int, node bigint, size int, words array<int>"
SIGNED = "node bigint, size int, sign bigint, bits bigint, keys array<bigint>"


def hashed_lines(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, mark, no, node, size, words) of the lines that have a word.

    ``node`` is a hash of a line's words in order, ``words`` 32 bits of each (numbers, of which files keep each different one once); these are with a
    line's first occurrence in each task alone, and null where no other line can be alike.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fewest = min(n for n in range(1, 1000) if int(int(n / similarity + 1e-9) * (1 - similarity) + 1e-9) > 0) if similarity < 1 else 1 << 30

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words, sizes, owner, no = line_words(part.column("text").to_pylist())
                if not len(sizes):
                    continue
                nodes = line_names(words, sizes)
                if len(seen) > REMEMBERED:
                    seen.clear()  # a line that comes again is no harm
                new = np.zeros(len(nodes), bool)
                new[np.unique(nodes, return_index=True)[1]] = True
                new &= sizes >= fewest
                new[new] = [n not in seen for n in nodes[new].tolist()]
                seen.update(nodes[new].tolist())
                few = (words[np.repeat(new, sizes)] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                cuts = np.concatenate([[0], np.cumsum(new * sizes)]).astype(np.int32)
                there = np.packbits(new, bitorder="little")
                packed = pa.Array.from_buffers(pa.list_(pa.int32()), len(new), [pa.py_buffer(x.tobytes()) for x in (there, cuts)], children=[pa.array(few)])
                columns = [
                    part.column("doc_id").take(pa.array(owner)), part.column("mark").take(pa.array(owner)), pa.array(no, pa.int32()),
                    pa.array(nodes), pa.array(sizes, pa.int32()), packed,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "no", "node", "size", "words"])

    return docs.mapInArrow(tidy(over), f"doc_id {kind}, {LINES}")


def packed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a column of `hashed_lines` without nulls, or of their bytes, one row after the other, and how many each row has."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        cuts = column.offsets.to_numpy().astype(np.int64)
        return column.values.to_numpy()[cuts[0] : cuts[-1]].view(np.uint32), np.diff(cuts)
    _, offsets, content = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    cuts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    words = np.frombuffer(content, np.uint32, cuts[-1]) if content is not None and cuts[-1] else np.empty(0, np.uint32)
    return words[cuts[0] :], np.diff(cuts)


def enough_in_common(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, similarity: float) -> np.ndarray:
    """For each pair of rows whether all but the allowed edits of the longer one's words are in the other; words that repeat count as often."""
    pair = lambda sizes: np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes)
    both = np.concatenate([pair(sizes_a) | a, pair(sizes_b) | b])
    sides = np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)])
    order = np.argsort(both, kind="stable")
    both, sides = both[order], sides[order]
    starts = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
    more = np.add.reduceat(sides, starts) if len(starts) else np.empty(0, np.int64)
    of = (both[starts] >> np.uint64(32)).astype(np.int64)
    count = lambda x: np.bincount(of, weights=np.maximum(x, 0), minlength=len(sizes_a))
    return np.maximum(count(more), count(-more)) <= np.floor(np.maximum(sizes_a, sizes_b) * (1 - similarity) + 1e-9)


def signed_lines(known: DataFrame, similarity: float) -> DataFrame:
    """(node, size, sign, bits, keys) of lines (node, size, words): the line's SimHash, a bit for each of its words (of 64), and its blocks.

    A line of LONG to SHORT words has blocks of both kinds, so lines whose lengths have the ratio have some of a kind.
    """
    if LONG / similarity > SHORT + 1:
        raise ValueError(f"lines of {LONG - 1} words could be like lines of more than {SHORT}")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if not part.num_rows:
                    continue
                words, sizes = packed_words(part.column("words"))
                plain = mixed(words.astype(np.uint64) * _ODD + _ODD)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (plain >> np.uint64(58)), starts_of(sizes)).view(np.int64)
                votes = told_apart(plain, sizes)
                of, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for number, fits in ((2, sizes <= SHORT), (3, sizes >= LONG)):
                    if fits.any():
                        keys.append(block_keys(votes[np.repeat(fits, sizes)], sizes[fits], BLOCKS, number).ravel())
                        of.append(np.repeat(np.flatnonzero(fits), BLOCKS))
                of, keys = np.concatenate(of), np.concatenate(keys)
                cuts = pa.array(np.cumsum([0, *np.bincount(of, minlength=len(sizes))]), pa.int32())
                listed = pa.ListArray.from_arrays(cuts, pa.array(keys[np.argsort(of, kind="stable")]))
                sign = pa.array(fingerprints(votes, sizes, 1)[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("size"), sign, pa.array(bits), listed], ["node", "size", "sign", "bits", "keys"]
                )

    return known.select("node", "size", "words").mapInArrow(tidy(over), SIGNED)


class EditJudge(Judge):
    """Judges lines, given as the bytes of their words, by their edit similarity."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def masks(self, contents: Sequence[bytes]) -> dict[str, np.ndarray]:
        """A bit of 256 for each word of a line; a word that comes again is another one."""
        words, sizes = _joined(contents)
        votes = told_apart(mixed(words.astype(np.uint64) * _ODD + _ODD), sizes)
        bit, part = np.uint64(1) << ((votes >> np.uint64(56)) & np.uint64(63)), votes >> np.uint64(62)
        of = lambda k: np.bitwise_or.reduceat(np.where(part == k, bit, np.uint64(0)), starts_of(sizes)).view(np.int64)
        return {f"mask_{k}": of(k) for k in range(4)}

    def alike(self, one: Sequence[bytes], two: Sequence[bytes]) -> np.ndarray:
        (a, sizes_a), (b, sizes_b) = _joined(one), _joined(two)
        return have_edit_similarity(a, sizes_a, b, sizes_b, self.similarity)


def _joined(contents: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of packed lines, one line after the other, and how many each has."""
    return np.frombuffer(b"".join(contents), np.uint32), np.array([len(x) // 4 for x in contents], np.int64)


def have_edit_similarity(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, similarity: float) -> np.ndarray:
    """For each pair of rows of words whether they have the edit similarity."""
    near = enough_in_common(a, sizes_a, b, sizes_b, similarity)
    from_a, from_b = starts_of(sizes_a), starts_of(sizes_b)
    for i in np.flatnonzero(near):
        near[i] = within(a[from_a[i] : from_a[i] + sizes_a[i]], b[from_b[i] : from_b[i] + sizes_b[i]], similarity)
    return near


def like_groups(lines: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the normalised lines, by their hash, that are like another one, in chains too; root is the smallest node of the group.

    All lines that share a block are compared, but for those that are in one group already when their block's turn comes.
    """
    known = lines.where("words is not null")
    signed, crowd = pin(signed_lines(known, similarity)), scratch_path(lines.sparkSession, "crowded")
    pairs = hub_pairs(signed, ["sign"], similarity, MOST_APART, ["bits"], HUBS, crowd)
    # Only nodes of crowded blocks meet again, without their keys.
    few = pin(signed.select("node", "size", "sign").join(crowd_nodes(lines.sparkSession, crowd), "node", "left_semi"))
    unpin(signed)
    roots = pin(components(edit_pairs(known, pairs, similarity)))
    more = rest_pairs(crowd, few, roots, ["sign"], similarity, MOST_APART, line_contents(known), EditJudge(similarity), 4)
    return roots if more.isEmpty() else pin(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))


def line_contents(known: DataFrame) -> DataFrame:
    """(node, content) of lines (node, words): the bytes of their words."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = packed_words(batch.column("words"))
            cuts = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(words.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("node"), packed], ["node", "content"])

    return known.select("node", "words").mapInArrow(tidy(over), "node bigint, content binary")


def edit_pairs(known: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of lines (node, words) that have the edit similarity; written."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    words = pin(known.select("node", "words").join(ends, "node").dropDuplicates(["node"]))
    side = lambda x: words.select(F.col("node").alias(x), F.col("words").alias(f"words_{x}"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                (a, sizes_a), (b, sizes_b) = (packed_words(part.column(c)) for c in ("words_a", "words_b"))
                near = have_edit_similarity(a, sizes_a, b, sizes_b, similarity)
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    links = pin(met.select("a", "b", "words_a", "words_b").mapInArrow(tidy(close), "a bigint, b bigint"))
    unpin(words)
    return links


def duplicate_lines(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (ascending numbers, from 0, of the lines to drop), and ``carry``.

    Lines are what stands between line feeds. Of each group of like lines the occurrence with the smallest doc_id, then the smallest line
    number, stays; a null doc_id is larger than any other. Rows with the same doc_id and text are one document and have the same
    result. Lines without a word are never removed. Null and empty texts have one line, without a word. Equal normalised lines are
    alike; others are if they have an edit similarity of ``similarity`` or more in words, in chains too. An empty table gives no rows. A text may
    have any number of lines; a pair of very long lines that differ takes time by the product of what lies between their equal ends, a word at
    a time over all of the other at once. A carried column must not have the name of one of the first four.
    """
    rest = [c for c in carry if c != "doc_id"]
    own = {"doc_id", "n_lines", "n_removed", "removed"} & {c.lower() for c in rest}
    if own:
        raise ValueError(f"rename {sorted(own)} first")
    names = [f"carried_{i}" for i in range(len(rest))]
    docs = docs.select("doc_id", *[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], text_or_empty(f"`{text}`").alias("text"))
    docs = docs.withColumn("mark", row_mark("text"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "no")
    with short_lived_shuffles(docs.sparkSession):
        lines = pin(hashed_lines(docs.select("doc_id", "mark", "text"), similarity))
        roots = like_groups(lines, similarity)
        # Only lines that occur again, or are like others, have anything to drop.
        first = lines.groupBy("node").agg(F.min(place).alias("place"), F.count("*").alias("n")).join(roots, "node", "left")
        first = pin(first.where("n > 1 or root is not null"))
        kept = first.where("root is not null").groupBy("root").agg(F.min("place").alias("kept"))
        near = first.where("root is not null").select("node", "root").join(kept, "root").select("node", "kept")
        kept = pin(near.unionByName(first.where("root is null and n > 1").select("node", F.col("place").alias("kept"))))
    gone = lines.select("node", place.alias("place")).join(kept, "node").where("place <> kept")
    gone = gone.groupBy("place.doc_id", "place.mark").agg(F.array_sort(F.collect_set("place.no")).alias("removed"))
    gone = gone.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    counted = docs.withColumn("n_lines", F.expr("length(text) - length(replace(text, '\n', '')) + 1")).select("doc_id", *names, "mark", "n_lines")
    rows = counted.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    more = [F.col(n).alias(c) for c, n in zip(rest, names, strict=True)]
    return rows.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"), *more)


def drop_lines(text: str, removed: Sequence[int]) -> str:
    """The text without the lines of these numbers."""
    gone = set(removed)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
