"""Photo folders as Spark sources: the recursive scan, folder statistics and decoded pixels."""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from burstselect.functions.pixels import luma, resize
from burstselect.params import SelectionParams

# Suffixes the scan takes, and the image types the folder statistics count.
SCAN_SUFFIXES = {".jpg", ".jpeg"}
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "heic", "heif", "tiff", "tif", "cr2", "cr3", "nef", "arw", "raf", "dng", "orf", "rw2"]


class PhotoScan(DataSource):
    """Source ``photos``: one row per photo below ``path``; ``slices`` partitions for each folder near the top.

    The driver lists only the folders of the upper ``depth`` levels; everything below is walked by the tasks. Each slice of a folder
    lists its names, which is cheap, and looks only at the files whose names hash to it, so one large folder is many tasks.
    Unlike the built-in file sources this keeps names that start with ``_`` or ``.``, which cameras do write. As a stream it gives the photos
    that are new, renamed, moved or changed since the last micro-batch, see `photo_stream`.
    """

    @classmethod
    def name(cls) -> str:
        return "photos"

    def schema(self) -> str:
        return "rel string, path string, mtime double, size_bytes bigint"

    def reader(self, schema) -> DataSourceReader:
        return _PhotoReader(self.options["path"], int(self.options.get("depth", "2")), int(self.options.get("slices", "8")))

    def streamReader(self, schema) -> DataSourceStreamReader:
        scan = self.reader(schema)
        return _PhotoStreamReader(scan.root, scan.depth, scan.slices, float(self.options.get("settle", "1")))


class _Folder(InputPartition):
    def __init__(self, path: str, recurse: bool, number: int):
        super().__init__((path, number))
        self.path, self.recurse, self.number = path, recurse, number


class _PhotoReader(DataSourceReader):
    def __init__(self, root: str, depth: int, slices: int):
        self.root, self.depth, self.slices = root, depth, slices

    def partitions(self) -> Sequence[InputPartition]:
        folders, level = [], [self.root]
        for _ in range(self.depth):
            folders += [(folder, False) for folder in level]
            level = sorted(e.path for folder in level for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
        folders += [(folder, True) for folder in level]
        return [_Folder(folder, recurse, n) for folder, recurse in folders for n in range(self.slices)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for folder, _, files in os.walk(partition.path):
            for name in sorted(files):
                mine = zlib.crc32(os.fsencode(name)) % self.slices == partition.number
                if mine and os.path.splitext(name)[1].lower() in SCAN_SUFFIXES:
                    path = os.path.join(folder, name)
                    try:
                        stat = os.stat(path)
                    except FileNotFoundError:  # gone since its folder was listed
                        continue
                    yield Path(path).relative_to(self.root).as_posix(), path, stat.st_mtime, stat.st_size
            if not partition.recurse:
                break


class _Window(InputPartition):
    """A slice of a folder and a stretch of time, in nanoseconds: after ``since``, up to ``until``."""

    def __init__(self, folder: _Folder, since: int, until: int):
        super().__init__((folder.value, since, until))
        self.folder, self.since, self.until = folder, since, until


class _PhotoStreamReader(_PhotoReader, DataSourceStreamReader):
    """The offset is a moment. A file belongs to the micro-batch in which its inode, or that of a folder above it, was last changed."""

    def __init__(self, root: str, depth: int, slices: int, settle: float):
        super().__init__(root, depth, slices)
        self.settle = int(settle * 1e9)
        self.newest = 0

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        self.newest = max(self.newest, time.time_ns() - self.settle)
        return {"until": self.newest}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Window(folder, start["until"], end["until"]) for folder in super().partitions()]

    def read(self, partition: _Window) -> Iterator[tuple]:
        known: dict[str, bool] = {"": False}

        def fresh(path: str) -> bool:
            try:
                return partition.since < os.stat(path).st_ctime_ns <= partition.until
            except FileNotFoundError:
                return False

        def moved(folder: str) -> bool:
            if folder not in known:
                known[folder] = fresh(os.path.join(self.root, folder)) or moved(os.path.dirname(folder))
            return known[folder]

        for row in super().read(partition.folder):
            if moved(os.path.dirname(row[0])) or fresh(row[1]):
                yield row


def photo_scan(spark: SparkSession, root: str, depth: int = 2, slices: int = 8) -> DataFrame:
    """Photos below ``root``: rel, path, mtime, size_bytes. Order by ``rel`` where order matters."""
    spark.dataSource.register(PhotoScan)
    return spark.read.format("photos").options(path=root, depth=str(depth), slices=str(slices)).load()


def photo_stream(spark: SparkSession, root: str, depth: int = 2, slices: int = 8, settle: float = 1.0) -> DataFrame:
    """The photos below ``root`` as a stream: those there at the start, then those that are new, renamed, moved, changed or touched.

    The offset is one moment, so neither it nor the checkpoint grows with the folder, and a restarted stream goes on where it stopped. A change
    counts once it is ``settle`` seconds old, so that clocks may differ by that much. No change is missed, but a photo may come again: the
    time of a folder, which tells that it was moved, also changes when a file is added to it, and then its other photos come along.
    ``incremental_measure`` measures each (rel, mtime, size) once all the same. Each micro-batch walks the folder, in tasks.
    """
    spark.dataSource.register(PhotoScan)
    options = {"path": root, "depth": str(depth), "slices": str(slices), "settle": str(settle)}
    return spark.readStream.format("photos").options(**options).load()


def binary_scan(spark: SparkSession, root: str) -> DataFrame:
    """The same through Spark's own binary source: faster, reads any file system, but skips names starting _ or ."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[jJ][pP]{[gG],[eE][gG]}")
        .load(root)
    )
    return files.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size_bytes"))


def source_stats(files: DataFrame, name: str = "rel") -> DataFrame:
    """Number of images, their bytes and the number of distinct types, over a table of file names and sizes."""
    base = F.substring_index(F.col(name), "/", -1)
    ext = F.when(base.rlike(r"^.+\.[^.]+$"), F.lower(F.substring_index(base, ".", -1)))
    return (
        files.withColumn("_ext", ext)
        .where(F.col("_ext").isin(IMAGE_EXTENSIONS))
        .agg(
            F.count("*").alias("photos"),
            F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
            F.countDistinct("_ext").alias("types"),
        )
    )


# How each orientation tag maps stored pixels to upright ones, as (transpose, flip rows, flip columns).
ORIENTATION = {
    1: (False, False, False),
    2: (False, False, True),
    3: (False, True, True),
    4: (False, True, False),
    5: (True, False, False),
    6: (True, False, True),
    7: (True, True, True),
    8: (True, True, False),
}


def upright(img: np.ndarray, orientation: int) -> np.ndarray:
    transpose, rows, columns = ORIENTATION.get(orientation, ORIENTATION[1])
    img = np.swapaxes(img, 0, 1) if transpose else img
    return img[:: -1 if rows else 1, :: -1 if columns else 1]


def image_pixels(images: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    """Pixels from Spark's image source: full-size gray, and RGB with its long edge shrunk for detection.

    ``images`` has the ``image`` struct of ``spark.read.format("image")`` and optionally ``orientation`` (the tag as an
    integer, 1 if absent). An undecodable file keeps its row with null pixels. Photos come in by batches of a bounded number
    of bytes (``spark.sql.execution.arrow.maxBytesPerBatch``) and leave one by one.
    """
    long_edge = params.downscale_long_edge
    turn = F.coalesce("orientation", F.lit(1)) if "orientation" in images.columns else F.lit(1)
    flat = images.select(
        F.col("image.origin").alias("path"),
        *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels")],
        F.col("image.data").alias("data"),
        turn.alias("orientation"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "decode_ok", "height", "width", "gray", "rgb_height", "rgb_width", "rgb"]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.height <= 0 or r.data is None:
                    yield one(names, (r.path, False, None, None, None, None, None, None))
                    continue
                stored = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                stored = stored[..., :3][..., ::-1] if r.nChannels >= 3 else np.repeat(stored[..., :1], 3, axis=2)
                rgb = np.ascontiguousarray(upright(stored, r.orientation))
                h, w = rgb.shape[:2]
                scale = long_edge / max(h, w)
                small = resize(rgb, max(1, int(h * scale)), max(1, int(w * scale))) if scale < 1 else rgb
                yield one(names, (r.path, True, h, w, luma(rgb).tobytes(), small.shape[0], small.shape[1], small.tobytes()))

    def one(names: list[str], row: tuple) -> pd.DataFrame:
        frame = pd.DataFrame([row], columns=names)
        for c in ("height", "width", "rgb_height", "rgb_width"):
            frame[c] = frame[c].astype("Int32")
        return frame

    schema = "path string, decode_ok boolean, height int, width int, gray binary, rgb_height int, rgb_width int, rgb binary"
    return flat.mapInPandas(run, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below ``path`` with undecodable files kept."""
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
