"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8, each with a scale of its own, and laid out in blocks. Every block of queries meets every block of
candidates once, in a grid of cells that an equality join fills. A product of int8 blocks approximates all inner products of a
tile, and the lengths of what quantisation left over bound its error. A candidate whose upper bound is below the k-th best so far
can't be among the nearest; the others are computed again in double precision and kept in heaps, which are merged at the end.
The result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from burstselect.llm.common import pin

BLOCK_ROWS = 4096
NEAREST = 20
#: About as many bytes of candidates as one cell of the grid holds in memory.
CELL_BYTES = 256 << 20
#: Sums of int8 products are exact in float32 up to this dimension.
FLOAT32_DIM = 1000

BLOCK = "block bigint, dim int, n int, ids binary, no_id binary, vectors binary, codes binary, scales binary, norms binary, rests binary"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes from -127 to 127, their scales, the lengths of the vectors and of what the codes leave over."""
    scales = np.abs(vectors).max(axis=1) / 127
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        codes = np.rint(np.nan_to_num(vectors / scales[:, None], posinf=127, neginf=-127)).clip(-127, 127).astype(np.int8)
    rest = vectors - codes * scales[:, None]
    return codes, scales, np.linalg.norm(vectors, axis=1), np.linalg.norm(rest, axis=1)


def to_blocks(vectors: DataFrame, id_col: str, vector: str, wanted: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of at most ``block_rows`` usable vectors of one length. ``wanted`` marks the queries (0 or 1 in ``is_query``)."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        task, made = TaskContext.get().partitionId(), 0

        def block(dim: int, rows: list) -> pa.RecordBatch:
            nonlocal made
            ids = np.array([i if i is not None else 0 for i, _ in rows], np.int64)
            v = np.array([v for _, v in rows], np.float64)
            codes, scales, norms, rests = quantise(v)
            blobs = [ids, np.array([i is None for i, _ in rows]), v, codes, scales, norms, rests]
            made += 1
            columns = [pa.array([(task << 32) | made], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32())]
            names = ["block", "dim", "n", "ids", "no_id", "vectors", "codes", "scales", "norms", "rests"]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names)

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                rows = waiting.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == block_rows:
                    yield block(len(v), waiting.pop(len(v)))
        for dim, rows in waiting.items():
            yield block(dim, rows)

    return rows.mapInArrow(over, BLOCK)


class Block:
    def __init__(self, row: dict, at: str = ""):
        get = lambda name, kind: np.frombuffer(row[at + name], kind)
        self.number, self.dim, n = row[at + "block"], row["dim"], row[at + "n"]
        self.ids, self.no_id = get("ids", np.int64), get("no_id", np.bool_)
        self.vectors = get("vectors", np.float64).reshape(n, self.dim)
        self.codes = get("codes", np.int8).reshape(n, self.dim)
        self.scales, self.norms, self.rests = get("scales", np.float64), get("norms", np.float64), get("rests", np.float64)

    def only(self, places: np.ndarray) -> Block:
        out = object.__new__(Block)
        out.number, out.dim = self.number, self.dim
        for name in ("ids", "no_id", "vectors", "codes", "scales", "norms", "rests"):
            setattr(out, name, getattr(self, name)[places])
        return out


def tile(q: Block, places: np.ndarray, c: Block, best: list[list], k: int) -> None:
    """Let the queries ``q`` (at ``places`` of their block) meet the candidates ``c``. ``best``: a heap of (score, -id) for each query."""
    kind = np.float32 if q.dim <= FLOAT32_DIM else np.float64
    near = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(np.float64) * q.scales[:, None] * c.scales[None, :]
    # |x.y - x'.y'| <= |x'| |y - y'| + |x - x'| |y|, and a little for rounding.
    error = (q.norms + q.rests)[:, None] * c.rests[None, :] + q.rests[:, None] * c.norms[None, :]
    error += 1e-9 * q.norms[:, None] * c.norms[None, :]
    if q.number == c.number:
        near[np.arange(len(places)), places] = -np.inf
    low, high = near - error, near + error
    if len(c.ids) > k:
        floor = np.partition(low, -k, axis=1)[:, -k]
    else:
        floor = np.full(len(q.ids), -np.inf)
    for i, heap in enumerate(best):
        least = max(floor[i], heap[0][0]) if len(heap) == k else floor[i]
        js = np.flatnonzero(high[i] >= least)
        if q.number == c.number:
            js = js[js != places[i]]
        if not len(js):
            continue
        # Summed component by component, so that equal vectors have equal scores wherever they stand.
        score, some = np.zeros(len(js)), c.vectors[js]
        for d in range(q.dim):
            score += some[:, d] * q.vectors[i, d]
        # A null id counts as the largest.
        keys = np.where(c.no_id[js], np.iinfo(np.int64).min, -c.ids[js])
        if len(js) > k:
            top = np.lexsort((-keys, -score))[:k]
            score, keys = score[top], keys[top]
        for item in zip(score.tolist(), keys.tolist(), strict=True):
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)


def nearest(
    vectors: DataFrame, every: int, id_col: str = "vec_id", vector: str = "embedding", k: int = NEAREST, block_rows: int = BLOCK_ROWS,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row whose id is divisible by ``every``, by inner product.

    All other rows are candidates, rows with the query's own id and vector included if they are other rows; ties go to the smaller id,
    a null id last. Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths
    don't meet. An empty table gives no rows.

    A cell keeps its candidates in memory while the queries pass, so there are as many cells as keep them at about ``cell_bytes``; every cell
    receives all queries.
    """
    spark = vectors.sparkSession
    blocks = pin(to_blocks(vectors, id_col, vector, block_rows=block_rows))
    # Eight bytes of a vector and one of its codes for each component, and some for each row.
    held_bytes = blocks.agg(F.sum(F.col("n").cast("long") * (F.col("dim") * 9 + 33))).first()[0] or 0
    cells = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(held_bytes / cell_bytes))

    # Queries travel with the parts of their block that tiles need; there is one of them for `every` rows.
    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                places = np.flatnonzero((b.ids % every == 0) & ~b.no_id)
                if not len(places):
                    continue
                b = b.only(places)
                blobs = [places.astype(np.int64), b.ids, b.no_id, b.vectors, b.codes, b.scales, b.norms, b.rests]
                columns = [pa.array([row["block"]], pa.int64()), pa.array([b.dim], pa.int32()), pa.array([len(places)], pa.int32())]
                names = ["q_block", "dim", "q_n", "q_places", "q_ids", "q_no_id", "q_vectors", "q_codes", "q_scales", "q_norms", "q_rests"]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in blobs)], names)

    asked = blocks.mapInArrow(
        queries,
        "q_block bigint, dim int, q_n int, q_places binary, q_ids binary, q_no_id binary, q_vectors binary, q_codes binary, "
        "q_scales binary, q_norms binary, q_rests binary",
    )
    # The grid: candidates are dealt over the cells, queries go to each cell; a pair of blocks meets in one cell.
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    held = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    met = asked.join(held, ["cell", "dim"]).select(*asked.drop("cell").columns, *held.drop("cell", "dim").columns)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, places, best = None, None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            rows = [(now, int(p), int(q.ids[i]), None if key == np.iinfo(np.int64).min else -key, s) for i, p in enumerate(places) for s, key in best[i]]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["q_block", "place", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["q_block"] != now:
                    if q is not None:
                        yield from done()
                    now, q = row["q_block"], Block(row, "q_")
                    places = np.frombuffer(row["q_places"], np.int64)
                    best = [[] for _ in places]
                tile(q, places, Block(row), best, k)
        if q is not None:
            yield from done()

    found = met.mapInArrow(tiles, "q_block bigint, place bigint, query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("q_block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
