"""Runs of words that repeat with a period, found by recursive frequency splitting and a lag scan.

A run of length >= max(least, 2 * period) holds each of its words twice at least. So a word that occurs once in a segment is in no run of
it and splits it; pieces shorter than ``least`` are dropped, and what is left is counted anew, until no segment changes. A word
that is frequent in the text but rare in a piece of it splits that piece: that is what the recursion is for.

The segments that survive are scanned at every lag, all texts of a batch at once. Short lags compare words. A longer lag q in [Q, 2Q) has
at least Q equal words in a row, which hold a whole block of Q/2 words that begins at a multiple of Q/2; so only blocks are
compared, by a hash that doubling makes from that of two halves, and equal ones are extended word by word. Each doubling
of the lags costs time in proportion to the words, and the words themselves confirm every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.llm.common import bytes_of, clear_of, slices, tidy

LEAST_WORDS = 12
SHORT_LAGS = 8
STEP = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)


def segments(words: np.ndarray, text: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(places, segment): the places that may be in a run, ascending, and the number of the segment each belongs to.

    ``words`` are numbers, ``text`` tells which text each is of, ascending. A segment is a stretch of neighbours of one text, ``least`` long
    or longer, in which every word occurs twice or more.
    """
    places, segment = np.arange(len(words)), text.astype(np.int64)
    done_places, done_segment, following = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while len(places):
        key = segment * (int(words.max()) + 1) + words[places]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[inverse] > 1
        # A new segment begins at another segment's first place and behind every place that goes.
        begins = np.ones(len(places), bool)
        begins[1:] = (segment[1:] != segment[:-1]) | (places[1:] != places[:-1] + 1) | ~keep[:-1]
        old, now = segment, np.cumsum(begins) - 1
        size = np.bincount(now[keep], minlength=now[-1] + 1)
        whole = np.ones(old.max() + 1, bool)
        whole[old[~keep]] = False
        long = keep & (size[now] >= least)
        steady = long & whole[old]
        done_places.append(places[steady])
        done_segment.append(now[steady] + following)
        following += int(now[-1]) + 1
        again = long & ~steady
        places, segment = places[again], now[again]
        if len(segment):
            segment = np.unique(segment, return_inverse=True)[1]
    places, segment = np.concatenate(done_places), np.concatenate(done_segment)
    order = np.argsort(places)
    return places[order], segment[order]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extended(line: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray, forward: bool) -> np.ndarray:
    """How many words further line[a + k] == line[b + k] holds (or line[a - 1 - k] == line[b - 1 - k]); ``q`` = b - a."""
    out, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(line)
    step = np.arange(STEP)
    while len(live):
        x = a[live] + out[live] if forward else a[live] - 1 - out[live]
        at = x[:, None] + (step if forward else -step)
        inside = (at >= 0) & (at + q[live][:, None] < n)
        at = np.where(inside, at, 0)
        same = inside & (line[at] == line[np.minimum(at + q[live][:, None], n - 1)])
        more = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
        out[live] += more
        live = live[more == STEP]
    return out


def _short(line: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Rows (start, end, period) of stretches with lags below SHORT_LAGS."""
    for q in range(1, min(SHORT_LAGS, len(line))):
        same = np.concatenate([[False], line[q:] == line[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, end = edges[::2], edges[1::2]
        long = end - start >= max(least - q, q)
        yield np.stack([start[long], end[long] + q, np.full(long.sum(), q)], axis=1)


def _blocks(line: np.ndarray, hashes: np.ndarray, low: int, known: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of stretches with lags in [low, 2 low). ``hashes`` name the low/2 words from each place on."""
    half, n = low // 2, len(line)
    first = np.arange(0, n - low, half)
    at, lag = [], []
    padded = np.concatenate([hashes, np.zeros(2 * low, hashes.dtype)])
    ahead = np.lib.stride_tricks.sliding_window_view(padded, low)
    rows = max(1, (1 << 22) // low)
    for i in range(0, len(first), rows):
        some = first[i : i + rows]
        where, q = np.nonzero(ahead[some + low] == hashes[some][:, None])
        fits = some[where] + q + low + half <= n
        at.append(some[where][fits])
        lag.append(q[fits] + low)
    at, lag = np.concatenate([np.empty(0, np.int64), *at]), np.concatenate([np.empty(0, np.int64), *lag])
    if not len(at):
        return np.empty((0, 3), np.int64)
    # Neighbouring blocks that are equal at one lag are one stretch; it ends within half a block beyond them.
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    new = np.ones(len(at), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + half)
    start, lag = at[new], lag[new]
    end = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + half
    # What lies in a known run whose period divides the lag is that run again.
    fresh = np.ones(len(start), bool)
    for s, e, p in known[known[:, 1] - known[:, 0] >= low + half]:
        fresh &= ~((start >= s) & (end + lag <= e) & (lag % p == 0))
    start, end, lag = start[fresh], end[fresh], lag[fresh]
    start = start - _extended(line, start, start + lag, lag, False)
    end = end + _extended(line, end, end + lag, lag, True)
    long = end - start >= lag
    return np.unique(np.stack([start[long], end[long] + lag[long], lag[long]], axis=1), axis=0)


def _primitive(found: np.ndarray) -> np.ndarray:
    """One row for each stretch: the one with the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def runs(words: np.ndarray, text: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, end, period), by start and then period: all maximal runs with their smallest period, as places in ``words``."""
    places, segment = segments(words, text, least)
    if not len(places):
        return np.empty((0, 3), np.int64)
    # Segments in a line, a number that occurs nowhere else between two of them.
    begins = np.ones(len(places), bool)
    begins[1:] = segment[1:] != segment[:-1]
    number = np.cumsum(begins) - 1
    size = np.bincount(number)
    spot = np.arange(len(places)) + number
    line = np.empty(len(places) + number[-1] + 1, np.int64)
    line[spot] = words[places]
    owner = np.repeat(np.arange(len(size)), size + 1)
    ends = np.cumsum(size + 1) - 1
    line[ends] = int(words.max()) + 1 + np.arange(len(size))
    source = np.empty(len(line), np.int64)
    source[spot] = places
    found = _primitive(np.concatenate(list(_short(line, least)) or [np.empty((0, 3), np.int64)]))
    out = [np.stack([source[found[:, 0]], source[found[:, 1] - 1] + 1, found[:, 2]], axis=1)]
    hashes, half, low = _mixed(line.astype(np.uint64) + _ODD), 1, SHORT_LAGS
    while True:
        fits = size[owner] >= 2 * low
        if not fits.any():
            break
        line, source, owner, hashes = line[fits], source[fits], owner[fits], hashes[fits]
        while half < low // 2:
            hashes = _mixed(hashes * _ODD + np.concatenate([hashes[half:], _mixed(np.arange(1, min(half, len(hashes)) + 1).astype(np.uint64))]))
            half *= 2
        # Known runs by their places in the shorter line.
        known = np.concatenate(out)
        known = known[known[:, 1] - known[:, 0] >= low + half]
        back = np.full(len(words) + 1, -1, np.int64)
        real = np.flatnonzero(line <= words.max())
        back[source[real]] = real
        known = np.stack([back[known[:, 0]], back[known[:, 1] - 1] + 1, known[:, 2]], axis=1)
        found = _blocks(line, hashes, low, known[known[:, 0] >= 0])
        for s, e, q in found:
            if not np.array_equal(line[s : e - q], line[s + q : e]):
                raise ArithmeticError("two different blocks of words have one hash")
        out.append(np.stack([source[found[:, 0]], source[found[:, 1] - 1] + 1, found[:, 2]], axis=1))
        low *= 2
    found = _primitive(np.concatenate(out))
    return found[np.lexsort((found[:, 2], found[:, 0]))]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text", carry: list[str] | None = None, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period), collapsed, and the columns named in ``carry``.

    Words stand between blanks, tabs and line ends. A run is a stretch of words with its smallest period, ``least`` words and two
    periods long or longer, that no neighbour extends. ``collapsed`` is the text, its words joined by one space, without what a run
    holds after its first period. Null and empty texts have no words; repeated rows have the same result; an empty table gives no
    rows; a carried column may have any name but the four above. Memory is in proportion to the longest text, time a little more than that.
    """
    carry = [c for c in carry or [] if c != "doc_id"]
    inner = clear_of(["doc_id", *carry], "text")
    rows = docs.select("doc_id", *carry, F.col(text).cast("string").alias(inner))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != inner]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        split = [t.split() for t in bytes_of(part, inner)]
        size = np.array([len(x) for x in split], np.int64)
        words = pa.array([w for x in split for w in x], pa.large_binary())
        del split
        number = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        found = runs(number, owner, least) if len(number) else np.empty((0, 3), np.int64)
        mark = np.zeros(len(number) + 1, np.int32)
        np.add.at(mark, found[:, 0] + found[:, 2], 1)
        np.add.at(mark, found[:, 1], -1)
        kept = np.cumsum(mark[:-1]) == 0
        left = np.bincount(owner[kept], minlength=len(size))
        collapsed = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *left])), words.filter(pa.array(kept)))
        collapsed = pa.compute.binary_join(collapsed, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
        of = owner[found[:, 0]]
        each = pa.StructArray.from_arrays([pa.array(found[:, 0] - begin[of]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], fields=list(run))
        offsets = np.cumsum([0, *np.bincount(of, minlength=len(size))])
        columns = [pa.array(size), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), collapsed]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, *(part.column(c) for c in carry)], ["doc_id", "n_words", "runs", "collapsed", *carry])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner, 2 << 20):
                yield work(part)

    return rows.mapInArrow(tidy(over), ", ".join([kinds[0], f"n_words bigint, runs {RUNS}, collapsed string", *kinds[1:]]))
