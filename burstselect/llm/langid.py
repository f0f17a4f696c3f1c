"""Language identification by cross-parsing.

From a bounded sample of labelled passages a suffix automaton is built for each language. A text is parsed greedily against each of
them: the longest stretch that occurs in the language's sample is one phrase, and the next begins behind it. The fewer phrases a
text needs, normalised by the sample's size, the closer it is to the language; the smallest number wins.

Texts are parsed whole, in stretches of fixed length side by side, so that numpy advances thousands of parses at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from burstselect.llm.common import slices, text_or_empty, tidy

PASSAGES = 64
PASSAGE_CHARS = 1500
SAMPLE_CHARS = 60_000
STRETCH = 512
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words of letters, one blank around each."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def sample(
    docs: DataFrame, label: str, text: str, learn: Column, passages: int = PASSAGES, chars: int = PASSAGE_CHARS, whole: int = SAMPLE_CHARS
) -> dict[str, str]:
    """Label: a bounded sample of its text, from the rows where ``learn`` holds.

    For each label at most ``passages`` passages of ``chars`` characters are taken, from the different texts with the smallest hashes, at a
    place that the hash determines; ``whole`` bounds their sum. So many characters reach the driver, however large the table.
    """
    rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("h")
    )
    # Copies count once, and only hashes are sorted.
    order = W.partitionBy("label").orderBy("h")
    chosen = rows.groupBy("label", "h").agg(F.lit(1).alias("_one")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= passages)
    at = F.expr(f"cast(1 + pmod(h, greatest(length(text) - {chars}, 1)) as int)")
    taken = rows.join(F.broadcast(chosen.select("label", "h")), ["label", "h"])
    taken = taken.groupBy("label", "h").agg(F.min(F.substring("text", at, F.lit(chars))).alias("passage"))
    out: dict[str, list[str]] = {}
    for r in sorted(taken.collect()):
        out.setdefault(r.label, []).append(letters(r.passage))
    return {k: x for k, v in sorted(out.items()) if (x := "".join(v)[:whole]).strip()}


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that accepts every stretch of ``text``; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in moves[p]:
            moves[p][ch] = new
            p = link[p]
        if p >= 0:
            q = moves[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(ch) == q:
                    moves[p][ch] = copy
                    p = link[p]
        last = new
    return moves


class Parser:
    """Counts the phrases of texts against several samples at once."""

    def __init__(self, samples: tuple[str, ...]):
        chars = sorted(set("".join(samples)))
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        kind = {c: i + 1 for i, c in enumerate(chars)}
        built = [automaton(s) for s in samples]
        starts = np.cumsum([1, *(len(b) for b in built)])
        # State 0 leads nowhere, so that the next character begins a phrase; class 0 is a character that no sample has.
        self.table = np.zeros((starts[-1], self.width), np.int32)
        for at, moves in zip(starts, built, strict=False):
            for i, m in enumerate(moves):
                for c, to in m.items():
                    self.table[at + i, kind[c]] = at + to
        self.roots = starts[:-1].astype(np.int32)
        self.first = self.table[self.roots]
        self.norms = np.array([math.log2(len(s) + 1) for s in samples])

    def phrases(self, texts: list[str], stretch: int = STRETCH) -> np.ndarray:
        """(texts, samples): how many phrases each text needs; a new one begins with every stretch."""
        codes = [self.classes[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [-(-len(c) // stretch) for c in codes])
        parts = [c[i : i + stretch] for c in codes for i in range(0, len(c), stretch)]
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        if not parts:
            return out
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((sizes.max(), len(parts)), np.int32)
        for k, i in enumerate(order):
            grid[: sizes[i], k] = parts[i]
        active = np.searchsorted(-sizes[order], -np.arange(len(grid)), side="left")
        state = np.zeros((len(self.roots), len(parts)), np.int32)
        count = np.zeros((len(self.roots), len(parts)), np.int64)
        flat = self.table.ravel()
        for step, n in enumerate(active):
            now, chars = state[:, :n], grid[step, :n]
            to = flat[now * self.width + chars]
            stuck = to == 0
            count[:, :n] += stuck
            state[:, :n] = np.where(stuck, self.first[:, chars], to)
        np.add.at(out, owner[order], count.T)
        return out


@lru_cache(maxsize=2)
def parser(samples: tuple[str, ...]) -> Parser:
    return Parser(samples)


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with its text replaced by the predicted label and a score; columns of their names give way to them.

    The score is the share that the winner has when labels are weighted by 2 to the power of minus their normalised phrases. Null
    text, text without a letter and an empty model give ``und`` and 0. Of equal labels the one first in alphabetical order wins.
    """
    rest = [c for c in docs.columns if c != text and c.lower() not in (label.lower(), score.lower())]
    labels, texts_of = list(samples), tuple(samples.values())

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [letters(t) if t else "" for t in part.column(text).to_pylist()]
        rows = [t if any(map(str.isalpha, t)) else "" for t in rows]
        names, scores = [UNKNOWN] * len(rows), [0.0] * len(rows)
        if labels:
            p = parser(texts_of)
            bits = p.phrases(rows) * p.norms
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 500)).sum(axis=1)
            for i, t in enumerate(rows):
                if t:
                    names[i], scores[i] = labels[best[i]], float(share[i])
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in rest), pa.array(names), pa.array(scores, pa.float64())], [*rest, label, score]
        )

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                yield work(part)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in rest]
    schema = ", ".join([*kinds, f"`{label}` string", f"`{score}` double"])
    whole = F.when(F.col(f"`{text}`").isNotNull(), text_or_empty(text)).alias(text)
    return docs.select(*[f"`{c}`" for c in rest], whole).mapInArrow(tidy(over), schema)
