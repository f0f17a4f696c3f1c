"""Packing of token sequences by bounded-space online best fit.

Each task reads its documents once and keeps a fixed number of windows open. A document goes to the fullest open window it fits
into. When none fits and no more may be opened, the fullest window is emitted; if it has a gap worth filling, the head of the
document is cut off to fill it. What is still open at the end of a task is merged: whole windows of a fixed number of tasks are
put together, again by best fit. A task holds its open windows and one batch of texts, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.llm.bpe import whole_texts
from burstselect.llm.common import pin, slices, text_or_empty, tidy

CAPACITY = 2048
OPEN_WINDOWS = 32
MERGED_TASKS = 64
GAP = 16
END_ID = 1


class Packer:
    """Places lengths into windows. Each placed piece is (window number, offset, what came with it)."""

    def __init__(self, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, gap: int = GAP):
        self.capacity, self.most, self.gap, self.next = capacity, open_windows, gap, 0
        self.open: dict[int, list] = {}  # number: [fill, pieces]

    def _new(self) -> int:
        self.next += 1
        self.open[self.next - 1] = [0, []]
        return self.next - 1

    def _put(self, number: int, length: int, piece: tuple) -> Iterator[tuple]:
        window = self.open[number]
        window[1].append((number, window[0], piece))
        window[0] += length
        if window[0] == self.capacity:
            yield from self.open.pop(number)[1]

    def add(self, key: object, total: int) -> Iterator[tuple]:
        """Place a document of ``total`` ids; yields the pieces (number, offset, (key, start, length)) of windows that are closed."""
        start = 0
        while start < total:
            left = total - start
            if left >= self.capacity:
                length, number = self.capacity, self._new()
            else:
                length = left
                fits = [(w[0], -n) for n, w in self.open.items() if w[0] + left <= self.capacity]
                if fits:
                    number = -max(fits)[1]
                elif len(self.open) < self.most:
                    number = self._new()
                else:
                    fill, number = max((w[0], -n) for n, w in self.open.items())
                    number = -number
                    if self.capacity - fill <= self.gap:
                        yield from self.open.pop(number)[1]
                        continue
                    length = self.capacity - fill
            yield from self._put(number, length, (key, start, length))
            start += length

    def leftovers(self) -> Iterator[tuple]:
        for number in list(self.open):
            yield from self.open.pop(number)[1]


def merge_windows(fills: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """For each window, the window that takes it in (perhaps itself) and the offset there: fullest first, by best fit."""
    hosts: list[list[int]] = []  # fill, index
    out = [(0, 0)] * len(fills)
    for i in sorted(range(len(fills)), key=lambda i: (-fills[i], i)):
        fits = [h for h in hosts if h[0] + fills[i] <= capacity]
        if fits:
            host = max(fits, key=lambda h: (h[0], -h[1]))
            out[i] = (host[1], host[0])
            host[0] += fills[i]
            if host[0] == capacity:
                hosts.remove(host)
        else:
            out[i] = (i, 0)
            if fills[i] < capacity:
                hosts.append([fills[i], i])
    return out


PIECE = "task bigint, window bigint, open boolean, start bigint, length bigint, doc_tokens bigint, offset bigint, ids binary"


def pack(
    docs: DataFrame,
    path: str,
    text: str = "text",
    id_col: str = "doc_id",
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit numbers).

    A document is the ids of its text under the byte-level vocabulary at ``path``, then ``end_id``; null text counts as empty, so
    every row has at least one id. Each id lies in exactly one piece; the pieces of a sequence_id have no gap between them and
    hold at most ``capacity`` ids. Repeated rows are packed once each; an empty table gives no rows; a null doc_id is kept.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, task = whole_texts(path), Packer(capacity, open_windows), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        id_kind, rows = pa.null(), []

        def batch_of(rows: list[tuple], still_open: bool) -> pa.RecordBatch:
            numbers, offsets, pieces = zip(*rows, strict=True)
            keys, starts, lengths = zip(*pieces, strict=True)
            n = len(rows)
            columns = [
                pa.array([k[0] for k in keys], id_kind), pa.array([task] * n, pa.int64()), pa.array(numbers, pa.int64()),
                pa.array([still_open] * n), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([len(k[1]) // 4 for k in keys], pa.int64()), pa.array(offsets, pa.int64()),
                pa.array([k[1][4 * s : 4 * (s + m)] for k, s, m in zip(keys, starts, lengths, strict=True)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "task", "window", "open", "start", "length", "doc_tokens", "offset", "ids"]
        for batch in batches:
            id_kind = batch.column("doc_id").type
            for part in slices(batch, "text", 4 << 20):
                encoded = words.encode(part.column("text").to_pylist())
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += end
                    rows += packer.add((doc_id, ids), len(ids) // 4)
                if rows:
                    yield batch_of(rows, False)
                    rows = []
        if rest := list(packer.leftovers()):
            yield batch_of(rest, True)

    def merged(group: pa.Table) -> pa.Table:
        tasks, windows, fills = (group.column(c).to_pylist() for c in ("task", "window", "fill"))
        order = sorted(range(len(tasks)), key=lambda i: (tasks[i], windows[i]))
        hosts = merge_windows([fills[i] for i in order], capacity)
        return pa.table(
            {
                "task": pa.array([tasks[i] for i in order], pa.int64()),
                "window": pa.array([windows[i] for i in order], pa.int64()),
                "host_task": pa.array([tasks[order[h]] for h, _ in hosts], pa.int64()),
                "host_window": pa.array([windows[order[h]] for h, _ in hosts], pa.int64()),
                "base": pa.array([b for _, b in hosts], pa.int64()),
            }
        )

    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    pieces = pin(source.mapInArrow(tidy(over), f"doc_id {id_type}, {PIECE}"))
    still = pieces.where("open")
    windows = still.groupBy("task", "window").agg(F.sum("length").alias("fill"))
    windows = windows.groupBy(F.expr(f"task div {MERGED_TASKS}").alias("part")).applyInArrow(
        merged, "task bigint, window bigint, host_task bigint, host_window bigint, base bigint"
    )
    sequence = lambda task, window: F.shiftleft(F.col(task), 32).bitwiseOR(F.col(window)).alias("sequence_id")
    columns = ["doc_id", "start", "length", "doc_tokens"]
    moved = still.join(windows, ["task", "window"]).select(
        *columns, sequence("host_task", "host_window"), (F.col("offset") + F.col("base")).alias("offset"), "ids"
    )
    return pieces.where("not open").select(*columns, sequence("task", "window"), "offset", "ids").unionByName(moved)
