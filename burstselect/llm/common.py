"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.session import pin

__all__ = ["arrow_map", "bit_counts", "bytes_of", "clear_of", "hash_split", "pin", "slices", "text_or_empty", "tidy", "without"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_split(key: str, parts: int) -> Column:
    """The remainder by which rows are set apart for testing: crc32 of the key as text. A null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def clear_of(names: Sequence[str], wish: str) -> str:
    """A column name like ``wish`` that no column of the table has (Spark ignores case)."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def slices(batch: pa.RecordBatch, column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of one text column each, so that few texts become Python objects at once."""
    start, total = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        if total and total + (n or 0) > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, after which the worker gives back the memory it no longer uses.

    Spark keeps Python workers for later tasks, and allocators keep freed memory; over several stages that adds up.
    """

    def over(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return over


def arrow_map(
    df: DataFrame, schema: str, text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]
) -> DataFrame:
    """``work`` over the table in parts of bounded size, one row out for each row in."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield work(part)

    return df.mapInArrow(tidy(over), schema)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``gone`` doesn't name, with all their columns.

    ``gone`` has a row (id, mark, keep_one) for each id and text to drop: ``mark`` is `row_mark`, ``keep_one`` tells that
    one of several equal rows stays. Only these thin rows meet the table; Spark broadcasts them if they are few.
    """
    own = docs.columns
    mark, key, flag = clear_of(own, "_mark"), clear_of(own, "_key"), clear_of(own, "_keep_one")
    gone = gone.select(F.col("id").alias(key), F.col("mark").alias(mark + "r"), F.col("keep_one").alias(flag))
    met = docs.withColumn(mark, row_mark(text)).join(
        gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(mark) == F.col(mark + "r")), "left"
    )
    kept = [F.col(f"`{c}`") for c in own]
    stay = met.where(F.col(flag).isNull()).select(*kept)
    one = met.where(F.col(flag)).dropDuplicates([id_col, mark]).select(*kept)
    return stay.unionByName(one)


def row_mark(text: str = "text") -> Column:
    """Tells rows apart that share an id; null and empty text are alike."""
    return F.xxhash64(text_or_empty(text), F.length(text_or_empty(text)))


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, 64): how many of each group's 64-bit hashes have each bit; ``starts``: where the groups begin, none of them empty.

    Eight bits of a hash are counted at once, one in each byte of a 64-bit sum, over at most 255 hashes.
    """
    ends = np.append(starts[1:], len(hashes))
    parts = [np.arange(a, b, 255) for a, b in zip(starts, ends, strict=True)] if (ends - starts).max(initial=0) > 255 else None
    cuts = np.concatenate(parts) if parts else starts
    counts = np.empty((len(cuts), 64), np.int64)
    lane = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lane, cuts)
        counts[:, j::8] = sums.view(np.uint8).reshape(-1, 8)
    if parts:
        return np.add.reduceat(counts, np.cumsum([0, *(len(p) for p in parts[:-1])]), axis=0)
    return counts
