"""One ordered text file, written by many tasks.

Rows are dealt into ranges of their order. The bytes of each range are summed first, so every range knows where in the file it starts; then each
task writes its ranges into a hidden file, all at the same time, and the commit gives it its name. No row passes through the driver, a task that
is run again writes the same bytes at the same place, and a failed job leaves whatever was under that name before.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from burstselect.functions.columns import csv_escape
from burstselect.plans.ordered import CHUNK, into_chunks
from burstselect.session import pin


@dataclass
class Written(WriterCommitMessage):
    size: int


class OneFile(DataSource):
    """Sink of (chunk, line), sorted, into ``path``; ``starts`` maps each chunk to its place in the file, ``size`` is the size of the whole."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite: bool) -> "OneFileWriter":
        o = self.options
        return OneFileWriter(o["path"], o["head"], json.loads(o["starts"]), int(o["size"]))


class OneFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, starts: dict[str, int], size: int):
        self.path, self.head, self.size = path, head.encode(), size
        self.starts = {int(k): v for k, v in starts.items()}
        folder, name = os.path.split(path)
        self.hidden = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        ends: dict[int, int] = {}
        # Tasks share the file, so none may cut it to nothing.
        with os.fdopen(os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as fh:
            for batch in iterator:
                for chunk in batch.column(0).unique():
                    at = chunk.as_py()
                    lines = batch.filter(pc.equal(batch.column(0), chunk)).column(1)
                    fh.seek(ends.get(at, self.starts[at]))
                    fh.writelines(line.as_buffer() for line in lines)
                    ends[at] = fh.tell()
            fh.flush()
            os.fsync(fh.fileno())
        return Written(sum(end - self.starts[at] for at, end in ends.items()))

    def commit(self, messages: list[Written | None]) -> None:
        written = sum(m.size for m in messages if m is not None)
        if len(self.head) + written != self.size:
            self.abort(messages)
            raise RuntimeError(f"{self.path}: {len(self.head) + written} bytes written, {self.size} expected")
        with os.fdopen(os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as fh:
            fh.write(self.head)
            fh.flush()
            os.fsync(fh.fileno())
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.unlink(self.hidden)


def write_lines(lines: DataFrame, order: Sequence[Column], path: str, head: str = "") -> int:
    """Write the column ``line`` of ``lines``, by ``order`` (expressions that sort ascending), to the file ``path`` behind ``head``; returns its size.

    ``path`` is on a folder that every executor shares and whose file system writes at any place. Lines carry their own ends; null is left out.
    The driver holds one number for each range, whatever the number of rows.
    """
    spark = lines.sparkSession
    spark.dataSource.register(OneFile)
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    ready = pin(lines.where(F.col("line").isNotNull()).select("line", *keys))
    by = [F.col(f"_o{i}") for i in range(len(keys))]
    dealt = into_chunks(ready, by)
    sizes = dealt.groupBy(CHUNK).agg(F.sum(F.octet_length("line")).alias("n")).orderBy(CHUNK).collect()
    places = list(accumulate((r["n"] for r in sizes), initial=len(head.encode())))
    starts = {r[CHUNK]: at for r, at in zip(sizes, places)}
    # Binary travels to the tasks as it is written.
    sorted_lines = dealt.sortWithinPartitions(CHUNK, *by).select(CHUNK, F.col("line").cast("binary").alias("line"))
    options = dict(path=path, head=head, starts=json.dumps(starts), size=str(places[-1]))
    sorted_lines.write.format("one_file").mode("append").options(**options).save()
    return places[-1]


def write_csv_file(
    cells: DataFrame,
    fields: Sequence[str],
    order: Sequence[Column],
    path: str,
    end: str = "\n",
    escape: Callable[[Column], Column] = csv_escape,
) -> int:
    """One CSV file with a header: ``fields`` of ``cells`` as text, null as nothing, quoted only where needed; returns its size."""
    cell = lambda f: escape(F.coalesce(F.col(f).cast("string"), F.lit("")))
    line = F.concat(F.concat_ws(",", *[cell(f) for f in fields]), F.lit(end))
    keyed = cells.select(line.alias("line"), *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    return write_lines(keyed, [F.col(f"_k{i}") for i in range(len(order))], path, ",".join(fields) + end)
