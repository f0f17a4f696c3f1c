"""Token ids in files of fixed-width numbers: each id takes as many bits as the largest id of the vocabulary needs.

A file holds a stretch of the documents, in ascending order of their ids:

    blocks   each BLOCK_IDS ids (the last one fewer), packed from the lowest bit on, then one line feed
    index    an Arrow stream of (doc_id, start, n): where each document's ids begin, counted from the file's first id
    footer   FOOTER: magic, bits, ids in a block, number of the file, ids, bytes of the blocks, bytes of the index; then a line feed

Blocks have a fixed size, so the offset of each is its number times that; the footer is found from the file's end. Any stretch of ids is
read from the blocks that it touches, which numpy unpacks at once, without the rest of the file.

The files are written by Spark's own writer for lines, a block a line, and so appear whole or not at all, also where a task runs
twice, on any file system that Spark can write to. They lie in ``ids``; ``files`` is a small table of their numbers and first ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstselect.llm.bpe import tokenizer, word_ends
from burstselect.llm.common import row_mark, slices, text_or_empty, tidy

BLOCK_IDS = 1 << 16
FILE_CHARS = 1 << 24
MAGIC = b"ids.bits"
FOOTER = struct.Struct("<8sIIqqqq")


def bits_needed(ids: int) -> int:
    """Bits of a number below ``ids``."""
    return max(1, (ids - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits, one behind the other, from the lowest bit on, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack_bits(packed: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` numbers from number ``first`` on."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count, first * (bits // 8)).astype("<u4")
    low, high = first * bits // 8, -(-(first + count) * bits // 8)
    each = np.unpackbits(np.frombuffer(packed, np.uint8, high - low, low), bitorder="little")
    skip = first * bits - 8 * low
    each = each[skip : skip + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class TokenFile:
    """Random access to the bytes of one file."""

    def __init__(self, content: bytes | memoryview):
        self.content = memoryview(content)
        magic, self.bits, self.block_ids, self.number, self.ids, self.blocks, index = FOOTER.unpack(self.content[-FOOTER.size - 1 : -1])
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.index = pa.ipc.open_stream(self.content[self.blocks : self.blocks + index]).read_all()

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``, counted from the file's first one; other blocks are not touched."""
        if not 0 <= start <= stop <= self.ids:
            raise IndexError(f"{start}:{stop} of {self.ids}")
        width = self.block_ids * self.bits // 8 + 1
        parts = [np.empty(0, "<u4")]
        while start < stop:
            block, first = divmod(start, self.block_ids)
            count = min(stop - start, self.block_ids - first)
            parts.append(unpack_bits(self.content[block * width : self.blocks], self.bits, first, count))
            start += count
        return np.concatenate(parts)

    def document(self, row: int) -> np.ndarray:
        """The ids of the document in a row of the index."""
        start = self.index.column("start")[row].as_py()
        return self.stretch(start, start + self.index.column("n")[row].as_py())


class _Writer:
    """The lines of one file from its documents in order. Holds one block and the index."""

    def __init__(self, number: int, bits: int, block_ids: int):
        self.number, self.bits, self.block_ids = number, bits, block_ids
        self.waiting, self.held, self.ids, self.bytes = [], 0, 0, 0
        self.docs: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []

    def _line(self, ids: np.ndarray) -> bytes:
        line = pack_bits(ids, self.bits)
        self.bytes += len(line) + 1
        return line

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append(doc_ids)
        self.sizes.append(sizes)
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) - len(ids) % self.block_ids
            for i in range(0, whole, self.block_ids):
                yield self._line(ids[i : i + self.block_ids])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def end(self) -> Iterator[bytes]:
        if self.held:
            yield self._line(np.concatenate(self.waiting))
        sizes = np.concatenate(self.sizes)
        table = pa.table({"doc_id": pa.chunked_array(self.docs), "start": np.cumsum(sizes) - sizes, "n": sizes})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        index = sink.getvalue().to_pybytes()
        yield index + FOOTER.pack(MAGIC, self.bits, self.block_ids, self.number, self.ids, self.bytes, len(index))


def write_tokens(
    docs: DataFrame, path: str, out: str, end_id: int = 2, text: str = "text", file_chars: int = FILE_CHARS, block_ids: int = BLOCK_IDS
) -> None:
    """Write the token ids of ``docs`` to the folder ``out``: files numbered in ascending order of doc_id, a null one first.

    The vocabulary at ``path`` drops white space. Null text counts as empty; every row ends with ``end_id`` and so has one id at least.
    Rows that share a doc_id are each written, in the order of a hash of their text. Documents are never split, so a file has the ids of
    about ``file_chars`` characters, or of one very long document. An empty table writes no file with ids in it. Other columns don't matter.
    """
    if block_ids % 8:
        raise ValueError("a block has to fill whole bytes")
    bits = bits_needed(max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1))
    # The salt parts rows that share a doc_id and a text; either may come first.
    rows = docs.select("doc_id", text_or_empty(text).alias("text"), row_mark(text).alias("mark"), F.monotonically_increasing_id().alias("salt"))
    files = (rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // file_chars + 1

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ends(path), np.array([end_id], "<u4")
        writer = _Writer(TaskContext.get().partitionId(), bits, block_ids)
        lines = lambda found: (pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["line"]) for x in found)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = [y for x in words.encode(part.column("text").to_pylist()) for y in (np.frombuffer(x, "<u4"), end)]
                sizes = np.array([len(x) + 1 for x in ids[::2]], np.int64)
                yield from lines(writer.add(part.column("doc_id"), sizes, np.concatenate([np.empty(0, "<u4"), *ids])))
        if writer.docs:
            yield from lines(writer.end())

    order = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("salt")]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    lines = dealt.select("doc_id", "text").mapInArrow(tidy(over), "line binary")
    lines.select(F.col("line").cast("string")).write.option("lineSep", "\n").text(f"{out}/ids")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = TokenFile(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([file.number], pa.int64()), pa.array([file.ids], pa.int64())], ["file", "ids"])

    # One row for each file. Reading all of them back shows that they are whole.
    before, bases = 0, []
    for row in sorted(_contents(docs.sparkSession, out).mapInArrow(tidy(totals), "file bigint, ids bigint").collect()):
        bases.append((row.file, row.ids, before))
        before += row.ids
    docs.sparkSession.createDataFrame(bases, "file bigint, ids bigint, base bigint").coalesce(1).write.parquet(f"{out}/files")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids").where("length > 0").select("content")


def read_tokens(spark: SparkSession, path: str, doc_type: str = "bigint", wanted: Sequence | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files at ``path``, or of those named in ``wanted``.

    ``start`` counts the ids of all documents before it, in all files; ``ids`` are little-endian unsigned 32-bit numbers.
    """
    own = set(wanted) if wanted is not None else None

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = TokenFile(content.as_buffer())
                rows = np.arange(file.index.num_rows)
                if own is not None:
                    rows = np.array([i for i, x in enumerate(file.index.column("doc_id").to_pylist()) if x in own], np.int64)
                for i in range(0, len(rows), 256):
                    some = file.index.take(pa.array(rows[i : i + 256])).combine_chunks()
                    ids = [file.document(int(r)).tobytes() for r in rows[i : i + 256]]
                    columns = [some.column("doc_id").combine_chunks(), some.column("start").combine_chunks(), some.column("n").combine_chunks()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file.number] * len(ids), pa.int64()), *columns, pa.array(ids, pa.binary())], ["file", "doc_id", "at", "n_tokens", "ids"]
                    )

    base = spark.read.parquet(f"{path}/files").select("file", "base")
    rows = _contents(spark, path).mapInArrow(tidy(over), f"file bigint, doc_id {doc_type}, at bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(base), "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
