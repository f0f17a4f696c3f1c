"""Encoding and decoding with a public BPE vocabulary, exactly as the tokenizers library does.

Texts are encoded word by word, and a worker remembers the words it has met. A text longer than a part is cut, its parts are
encoded in parallel by many tasks, and the parts are joined pairwise, as a tree. Where the cut is at a space, nothing crosses
it. Where long unsplit text had to be cut, a window around the join is encoded anew and grows until it agrees with both
sides: from a token that the left side and the window share, to one that the window and the right side share, the window's
tokens replace theirs. That is exact: the pieces that the vocabulary's pattern cuts depend on what follows only, and a sequence
of BPE tokens is the right one if every adjacent pair of it is.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.llm.common import clear_of, pin, slices, text_or_empty, tidy

PART_CHARS = 1 << 16
MARGIN = 16
REMEMBERED = 200_000
WORD_CHARS = 64


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding, and on one thread: Spark has the others."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it can be printed, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


END_OF_WORD = "</w>"
#: Stands for the end of a word; the byte is in no UTF-8 text.
_END = b"\xff"


@lru_cache(maxsize=4)
def ranked_bytes(path: str):
    """The vocabulary of a file for tiktoken, which merges the adjacent pair with the smallest id, as the file's merges do.

    That holds if every token is what its own bytes become under the merges, which the tests check for the public files.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {}
    for token, i in file["model"]["vocab"].items():
        if token not in special:
            ends = token.endswith(END_OF_WORD) and file["model"].get("end_of_word_suffix") == END_OF_WORD
            stem = token[: -len(END_OF_WORD)] if ends else token
            ranks[bytes(letters[c] for c in stem) + _END * ends] = i
    return tiktoken.Encoding(path, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)


# Fixed value: how byte-level vocabularies cut a text before merging.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class WholeTexts:
    """Encodes texts under a byte-level vocabulary without a normaliser."""

    def __init__(self, path: str):
        self.encoding, self.path = ranked_bytes(path), path
        self.special = list(self.encoding.special_tokens_set)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        return [array("I", self._ids(t)).tobytes() for t in texts]

    def _ids(self, text: str) -> list[int]:
        # A text that names a special token is rare; the library itself finds it.
        if any(s in text for s in self.special):
            return tokenizer(self.path).encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)


class _Memory(dict):
    """Word: its ids. Long words are not kept, and when there are too many all are forgotten."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class WordEnds:
    """Encodes texts under a vocabulary with word ends that drops white space.

    A word is what stands between blanks or line ends; nothing the library does reaches over those. Words of common Latin letters,
    digits and signs are cut and merged here, where lower case and the pattern are plain; others go to the library. Most words are
    letters, and perhaps signs behind them, which are one piece each; pieces are remembered as words are.
    """

    # Letters that are composed already and have one lower case, and the pattern for them.
    plain = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
    common = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")

    def __init__(self, path: str):
        self.encoding, self.path = ranked_bytes(path), path
        self.special = list(self.encoding.special_tokens_set)
        self.known, self.pieces = _Memory(self._word), _Memory(self._piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        get = self.known.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if len(word) <= WORD_CHARS:
            if found := self.common.fullmatch(word):
                letters, signs = found.groups()
                return self.pieces[letters.lower()] + (self.pieces[signs] if signs else b"")
            if self.plain.fullmatch(word) and not any(s in word for s in self.special):
                return b"".join([self.pieces[piece] for piece in self.cut.findall(word.lower())])
        return array("I", tokenizer(self.path).encode(word, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", self.encoding._encode_single_piece(piece.encode() + _END)).tobytes()


@lru_cache(maxsize=4)
def word_ends(path: str) -> WordEnds:
    return WordEnds(path)


@lru_cache(maxsize=4)
def whole_texts(path: str) -> WholeTexts:
    return WholeTexts(path)


class Part:
    """An encoded stretch of a text: ids, and where each token starts and ends in the whole text."""

    def __init__(self, text: str, at: int, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.text, self.at, self.ids, self.starts, self.ends = text, at, ids, starts, ends

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @staticmethod
    def of(t, text: str, at: int) -> Part:
        e = t.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        return Part(text, at, np.array(e.ids, np.uint32), spans[:, 0], spans[:, 1])


def _agreeing(a: Part, b: Part, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Places (i, j) of a token that both have, that lies within [low, high), with nothing near it that a cut could change."""
    mine = {}
    for i in np.flatnonzero((a.starts >= low) & (a.ends <= high) & (a.ends > a.starts)):
        mine[(int(a.starts[i]), int(a.ends[i]), int(a.ids[i]))] = int(i)
    found = None
    for j in np.flatnonzero((b.starts >= low) & (b.ends <= high) & (b.ends > b.starts)):
        key = (int(b.starts[j]), int(b.ends[j]), int(b.ids[j]))
        if key in mine and _steady(a, b, key[0], key[1]):
            found = (mine[key], int(j))
            if not last:
                break
    return found


def _steady(a: Part, b: Part, start: int, end: int) -> bool:
    """Whether the token can't be part of a contraction, of a special token or of a character put together from several."""
    text = a.text[max(0, start - MARGIN - a.at) : end + 1 - a.at]
    if "'" in text or "<" in text or any(unicodedata.combining(c) for c in text):
        return False
    for p in (a, b):  # a character of several tokens would have its place more than once
        if np.count_nonzero((p.starts < end) & (p.ends > start)) != 1:
            return False
    return True


def join_parts(t, left: Part, right: Part, window: int = 128) -> Part:
    """The encoding of two adjacent stretches together, equal to encoding them as one."""
    whole, cut = left.text + right.text, left.end
    while True:
        low, high = max(left.at, cut - window), min(right.end, cut + window)
        mid = Part.of(t, whole[low - left.at : high - left.at], low)
        i = j = None
        if low > left.at:
            i = _agreeing(left, mid, low + MARGIN, cut - MARGIN, last=False)
        if high < right.end:
            j = _agreeing(mid, right, cut + MARGIN, high - MARGIN, last=True)
        if (i or low == left.at) and (j or high == right.end):
            a = (left, i[0]) if i else (left, 0)
            m0, m1 = (i[1] if i else 0), (j[0] if j else len(mid.ids))
            rest = right if j else None
            pieces = [
                (left.ids[: a[1]], left.starts[: a[1]], left.ends[: a[1]]) if i else None,
                (mid.ids[m0:m1], mid.starts[m0:m1], mid.ends[m0:m1]),
                (right.ids[j[1] :], right.starts[j[1] :], right.ends[j[1] :]) if rest else None,
            ]
            ids, starts, ends = (np.concatenate(x) for x in zip(*(p for p in pieces if p), strict=True))
            return Part(whole, left.at, ids, starts, ends)
        window *= 2


def join_all(t, texts: list[str]) -> np.ndarray:
    """Ids of a text cut into stretches without regard to spaces, joined pairwise as a tree."""
    parts, at = [], 0
    for x in texts:
        parts.append(Part.of(t, x, at))
        at += len(x)
    while len(parts) > 1:
        parts = [join_parts(t, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].ids


def cut_text(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """Parts of at most ``size`` characters, each with a flag: whether it was cut off after a space or the text ends there."""
    at = 0
    while len(text) - at > size:
        gap = max(text.rfind(" ", at + size // 2, at + size), text.rfind("\n", at + size // 2, at + size))
        end = gap + 1 if gap >= 0 else at + size
        yield text[at:end], gap >= 0
        at = end
    yield text[at:], True


def _id_array(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in encoded)])
    values = pa.array(np.frombuffer(b"".join(encoded), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` with the text replaced by its ids (array of int) under the vocabulary at ``path``, one row for each row.

    For vocabularies that drop white space. Null counts as empty; an empty text has no ids; repeated rows stay; other columns are
    passed on whatever their names. The file at ``path`` has to be where the executors are.
    """
    names = docs.columns
    rid, no, soft = clear_of(names, "rid"), clear_of(names, "no"), clear_of(names, "soft")
    rest = [c for c in names if c != text]
    base = docs.withColumn(text, text_or_empty(f"`{text}`"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    thin = ", ".join(f"`{c}` {kinds[c]}" for c in rest)
    comma = ", " if rest else ""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ends(path)
        for batch in batches:
            for part in slices(batch, text):
                ids = _id_array(words.encode(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), ids], [*rest, out])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                for k, (piece, gap) in enumerate(cut_text(row.column(text)[0].as_py(), part_chars)):
                    head = [row.column(c) if k == 0 else pa.nulls(1, row.column(c).type) for c in rest]
                    yield pa.RecordBatch.from_arrays(
                        [*head, row.column(rid), pa.array([k], pa.int32()), pa.array([gap]), pa.array([piece])],
                        [*rest, rid, no, soft, text],
                    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ends(path)
        for batch in batches:
            for part in slices(batch, text):
                ids = _id_array(words.encode(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, out])

    def together(group: pa.Table) -> pa.Table:
        group = group.sort_by(no)
        t = tokenizer(path)
        softs, texts, own = group.column(soft).to_pylist(), group.column(text).to_pylist(), group.column(out).to_pylist()
        ids: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            k = i
            while not softs[k]:
                k += 1
            ids.append(np.array(own[i], np.uint32) if k == i else join_all(t, texts[i : k + 1]))
            i = k + 1
        joined = _id_array([b"".join(x.astype("<u4").tobytes() for x in ids)])
        return pa.Table.from_arrays([*(group.column(c).slice(0, 1) for c in rest), joined], names=[*rest, out])

    size = F.length(f"`{text}`")
    short = base.where(size <= part_chars).mapInArrow(tidy(whole), f"{thin}{comma}`{out}` array<int>")
    # The rows of a long text are numbered before they are cut, and written so that the numbers hold.
    long = base.where(size > part_chars).withColumn(rid, F.monotonically_increasing_id())
    long = pin(long.mapInArrow(cut, f"{thin}{comma}`{rid}` bigint, `{no}` int, `{soft}` boolean, `{text}` string"))
    dealt = long.repartition(F.col(rid), F.col(no))
    coded = dealt.mapInArrow(tidy(parts), f"{thin}{comma}`{rid}` bigint, `{no}` int, `{soft}` boolean, `{text}` string, `{out}` array<int>")
    joined = coded.groupBy(rid).applyInArrow(together, f"{thin}{comma}`{out}` array<int>")
    return short.unionByName(joined)


@lru_cache(maxsize=4)
def _strings(path: str) -> list[str]:
    t = tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with a column ``out``: the text of its ids, as the library's decode with special tokens kept.

    The vocabulary at ``path`` has no decoder, so tokens stand as they are, with a blank between two. Null or no ids: empty text.
    """
    names = rows.columns

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(path)
        get = strings.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [" ".join(map(get, x or ())) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(tidy(over), f"{kinds}, `{out}` string")
