"""Pixel kernels: numpy on one image at a time, mapped over an image table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstselect.params import SelectionParams

# 64 tonal bins and integer Rec. 601 luma weights over 1000.
HISTOGRAM_BINS = 64
LUMA_WEIGHTS = (299, 587, 114)


def exposure_fractions(gray: np.ndarray, params: SelectionParams) -> tuple[bool, float, float]:
    """(flagged, blown, crushed) over the whole frame; an empty image is never flagged."""
    if gray.size == 0:
        return False, 0.0, 0.0
    blown = np.count_nonzero(gray >= params.blown_value) / gray.size
    crushed = np.count_nonzero(gray <= params.crushed_value) / gray.size
    return blown > params.blown_frac or crushed > params.crushed_frac, blown, crushed


def crop(gray: np.ndarray, box) -> np.ndarray:
    """The part of the image under a normalised (x, y, w, h) box; the whole image for no box or an empty cut."""
    if box is None:
        return gray
    h, w = gray.shape
    x, y, bw, bh = box
    cut = gray[max(0, int(y * h)) : min(h, int((y + bh) * h)), max(0, int(x * w)) : min(w, int((x + bw) * w))]
    return cut if cut.size else gray


def laplacian_variance(gray: np.ndarray, box=None) -> float:
    """Population variance of the 4-neighbour Laplacian, edges mirrored without repeating the edge pixel."""
    g = crop(gray, box).astype(np.float64)
    if g.size == 0:
        return 0.0
    for axis in (0, 1):
        g = np.pad(g, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if g.shape[axis] > 1 else "edge")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4.0 * g[1:-1, 1:-1]
    return float(lap.var())


def laplacian_sums(window: np.ndarray, edges: tuple[bool, bool, bool, bool]) -> tuple[int, int, int]:
    """Count, sum and sum of squares of the Laplacian over a tile, whole numbers all of them.

    ``window`` is the tile with one more pixel on each side that is no edge of the image; at an edge (top, bottom, left, right) it mirrors.
    """
    g = window.astype(np.int64)
    for axis in (0, 1):
        grown = [(int(edges[0]), int(edges[1])) if axis == 0 else (0, 0), (int(edges[2]), int(edges[3])) if axis == 1 else (0, 0)]
        g = np.pad(g, grown, mode="reflect" if g.shape[axis] > 1 else "edge")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return lap.size, int(lap.sum()), int((lap * lap).sum())


def _cubic(t: np.ndarray) -> np.ndarray:
    """Keys' cubic convolution kernel with a = -0.5."""
    t = np.abs(t)
    near = (1.5 * t - 2.5) * t * t + 1.0
    far = ((-0.5 * t + 2.5) * t - 4.0) * t + 2.0
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


def _resample_rows(img: np.ndarray, size: int) -> np.ndarray:
    """Antialiased cubic resampling along the first axis, in the 22-bit fixed point of common 8-bit resamplers."""
    n = img.shape[0]
    if n == size:
        return img
    scale = n / size
    stretch = max(scale, 1.0)
    reach = 2.0 * stretch
    half = 1 << 21
    out = np.empty((size, *img.shape[1:]), dtype=np.uint8)
    for i in range(size):
        center = (i + 0.5) * scale
        lo, hi = max(0, int(center - reach + 0.5)), min(n, int(center + reach + 0.5))
        weight = _cubic((np.arange(lo, hi) - center + 0.5) / stretch)
        weight = weight / weight.sum()
        fixed = np.trunc(weight * (1 << 22) + np.copysign(0.5, weight)).astype(np.int64)
        total = np.tensordot(fixed, img[lo:hi].astype(np.int64), axes=1) + half
        out[i] = np.clip(total >> 22, 0, 255)
    return out


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize an 8-bit image, columns first and then rows."""
    wide = _resample_rows(np.swapaxes(img, 0, 1), width)
    return _resample_rows(np.swapaxes(wide, 0, 1), height)


def dhash_bits(gray: np.ndarray, size: int) -> np.ndarray:
    """size*size bits, row by row: set where a pixel of the shrunk image is brighter than its left neighbour."""
    small = resize(gray, size, size + 1).astype(np.int16)
    return (small[:, 1:] > small[:, :-1]).reshape(-1)


def hash_words(bits: np.ndarray) -> list[int]:
    """Bits as signed 64-bit words, first bit most significant, the first word short if need be."""
    padded = np.concatenate([np.zeros(-len(bits) % 64, bool), bits])
    return np.packbits(padded).view(">i8").tolist()


def dhash(gray: np.ndarray, size: int = 8) -> int:
    """Difference hash as the bit pattern of a signed 64-bit integer (size up to 8)."""
    return hash_words(dhash_bits(gray, size))[0]


def luma(rgb: np.ndarray) -> np.ndarray:
    """Gray of an RGB image in 16-bit fixed point: the ITU-R 601 weights of common 8-bit converters."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def histogram(rgb: np.ndarray, sample: int = 160) -> dict[str, np.ndarray]:
    """Counts of 64 tonal bins for red, green, blue and luma, on the image shrunk to at most ``sample`` pixels."""
    h, w = rgb.shape[:2]
    scale = min(1.0, sample / max(h, w))
    rgb = resize(rgb, max(1, int(h * scale + 0.5)), max(1, int(w * scale + 0.5))).astype(np.int64)
    channels = {name: rgb[..., i] for i, name in enumerate(("red", "green", "blue"))}
    channels["luma"] = sum(rgb[..., i] * weight for i, weight in enumerate(LUMA_WEIGHTS)) // 1000
    return {k: np.bincount((v * HISTOGRAM_BINS // 256).ravel(), minlength=HISTOGRAM_BINS) for k, v in channels.items()}


# ---- over tables -----------------------------------------------------------------------------------------------


def _image(row) -> np.ndarray | None:
    if row.gray is None:
        return None
    return np.frombuffer(row.gray, dtype=np.uint8).reshape(row.height, row.width)


def measure_pixels(images: DataFrame, key: str = "rel", params: SelectionParams = SelectionParams()) -> DataFrame:
    """Exposure and hash of each image of (key, height, width, gray); an undecodable image (null) measures as zero."""
    big = params.phash_size > 8
    key_type = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                img = _image(row)
                flag, blown, crushed = (False, 0.0, 0.0) if img is None else exposure_fractions(img, params)
                words = [0] * (1 + (params.phash_size**2 - 1) // 64)
                if img is not None:
                    words = hash_words(dhash_bits(img, params.phash_size))
                rows.append((getattr(row, key), img is not None, bool(flag), blown, crushed, words if big else words[0]))
            yield pd.DataFrame(rows, columns=[key, "decode_ok", "exposure_flag", "blown", "crushed", "phash"])

    hash_type = "array<bigint>" if big else "bigint"
    schema = f"{key} {key_type}, decode_ok boolean, exposure_flag boolean, blown double, crushed double, phash {hash_type}"
    return images.select(key, "height", "width", "gray").mapInPandas(run, schema)


def measure_sharpness(images: DataFrame, key: str = "rel") -> DataFrame:
    """Sharpness of each image of (key, height, width, gray[, region]) inside its region."""
    key_type = images.schema[key].dataType.simpleString()
    cols = [key, "height", "width", "gray"]
    regioned = "region" in images.columns
    part = [F.col(f"region.{a}").alias(f"r{a}") for a in "xywh"] if regioned else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                img = _image(row)
                box = (row.rx, row.ry, row.rw, row.rh) if regioned and not pd.isna(row.rx) else None
                rows.append((getattr(row, key), 0.0 if img is None else laplacian_variance(img, box)))
            yield pd.DataFrame(rows, columns=[key, "sharpness"])

    return images.select(*cols, *part).mapInPandas(run, f"{key} {key_type}, sharpness double")


def sharpness_by_tiles(
    images: DataFrame, key: str = "rel", load: Callable[[str, int, int, int, int], np.ndarray | None] | None = None, tile: int = 2048, per_task: int = 16
) -> DataFrame:
    """Sharpness of images (key, height, width[, region]) that may be larger than a task: it is the same for tiles of any size.

    Every tile is a row, read with a rim of one pixel; counts and sums of tiles are whole numbers and are added up by Spark, so nothing is rounded
    before the end. ``load(path, top, bottom, left, right)`` reads that part of the image at ``path``, and tiles are dealt to tasks, ``per_task`` of them
    to each. Without it the pixels come from ``gray``. An image without a size, or with a part that cannot be read, measures as zero.
    """
    key_type = images.schema[key].dataType.simpleString()
    source = "path" if load is not None else "gray"
    part = lambda a, b, size: F.least(F.greatest(((F.col(f"region.{a}") + (F.col(f"region.{b}") if b else 0)) * F.col(size)).cast("int"), F.lit(0)), F.col(size))
    cut = images.withColumns({"_t": F.lit(0), "_b": F.col("height"), "_l": F.lit(0), "_r": F.col("width")})
    if "region" in images.columns:
        own = {"_t": part("y", None, "height"), "_b": part("y", "h", "height"), "_l": part("x", None, "width"), "_r": part("x", "w", "width")}
        fits = F.col("region").isNotNull() & (own["_t"] < own["_b"]) & (own["_l"] < own["_r"])
        cut = cut.withColumns({n: F.when(fits, c).otherwise(F.col(n)) for n, c in own.items()})
    steps = lambda a, b: F.explode_outer(F.when(F.col(a) < F.col(b), F.sequence(F.col(a), F.col(b) - 1, F.lit(tile))))
    tiles = cut.select(key, source, "height", "width", "_t", "_b", "_l", "_r", steps("_t", "_b").alias("_y"))
    tiles = tiles.select("*", steps("_l", "_r").alias("_x"))
    if load is not None:
        across = lambda a, b: F.ceil((F.col(b) - F.col(a)) / tile)
        count = cut.agg(F.sum(across("_t", "_b") * across("_l", "_r"))).first()[0] or 0
        tiles = tiles.repartition(max(1, -(-count // per_task)), key, "_y", "_x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                name, where, height, width, top, bottom, left, right, y, x = r
                if where is None or pd.isna(y) or pd.isna(x):
                    rows.append((name, 0, 0, 0, False))
                    continue
                height, width, top, bottom, left, right, y, x = (int(v) for v in (height, width, top, bottom, left, right, y, x))
                low, far = min(y + tile, bottom), min(x + tile, right)
                edges = (y == top, low == bottom, x == left, far == right)
                span = (y - (not edges[0]), low + (not edges[1]), x - (not edges[2]), far + (not edges[3]))
                if load is not None:
                    window = load(where, *span)
                else:
                    window = np.frombuffer(where, np.uint8).reshape(height, width)[span[0] : span[1], span[2] : span[3]]
                rows.append((name, 0, 0, 0, False) if window is None else (name, *laplacian_sums(window, edges), True))
            yield pd.DataFrame(rows, columns=[key, "n", "s", "q", "read"])

    sums = tiles.mapInPandas(run, f"`{key}` {key_type}, n bigint, s bigint, q bigint, read boolean").groupBy(key)
    sums = sums.agg(*[F.sum(c).cast("decimal(19,0)").alias(c) for c in ("n", "s", "q")], F.bool_and("read").alias("read"))
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double") / (F.col("n").cast("double") * F.col("n").cast("double"))
    return sums.select(key, F.when(F.col("read"), spread).otherwise(F.lit(0.0)).alias("sharpness"))


def measure_files(
    frames: DataFrame, load: Callable[[str], np.ndarray | None], params: SelectionParams = SelectionParams()
) -> DataFrame:
    """Every pixel measurement of each file of (rel, path[, region]) in one pass.

    Only paths and regions travel between tasks; the task that measures a photo opens it, and no pixel is ever shuffled.
    ``load`` turns a path every executor can open into the upright full-size gray image, or None if it cannot be read.
    """
    big = params.phash_size > 8
    regioned = "region" in frames.columns
    part = [F.col(f"region.{a}").alias(f"r{a}") for a in "xywh"] if regioned else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                img = load(row.path)
                if img is None:
                    words = [0] * (1 + (params.phash_size**2 - 1) // 64)
                    rows.append((row.rel, False, False, 0.0, 0.0, words if big else 0, 0.0))
                    continue
                flag, blown, crushed = exposure_fractions(img, params)
                words = hash_words(dhash_bits(img, params.phash_size))
                box = (row.rx, row.ry, row.rw, row.rh) if regioned and not pd.isna(row.rx) else None
                rows.append((row.rel, True, bool(flag), blown, crushed, words if big else words[0], laplacian_variance(img, box)))
            names = ["rel", "decode_ok", "exposure_flag", "blown", "crushed", "phash", "sharpness"]
            yield pd.DataFrame(rows, columns=names)

    hash_type = "array<bigint>" if big else "bigint"
    schema = f"rel string, decode_ok boolean, exposure_flag boolean, blown double, crushed double, phash {hash_type}, sharpness double"
    return frames.select("rel", "path", *part).mapInPandas(run, schema)


def tone_histogram(images: DataFrame, key: str = "rel", sample: int = 160) -> DataFrame:
    """Rows (key, channel, bin, n) of each image of (key, height, width, rgb); empty bins are left out."""
    key_type = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                if row.rgb is None or row.height <= 0 or row.width <= 0:
                    continue
                rgb = np.frombuffer(row.rgb, dtype=np.uint8).reshape(row.height, row.width, 3)
                for channel, counts in histogram(rgb, sample).items():
                    rows += [(getattr(row, key), channel, int(b), int(counts[b])) for b in np.flatnonzero(counts)]
            yield pd.DataFrame(rows, columns=[key, "channel", "bin", "n"])

    return images.select(key, "height", "width", "rgb").mapInPandas(run, f"{key} {key_type}, channel string, bin int, n bigint")


def histogram_peaks(bins: DataFrame, key: str = "rel") -> DataFrame:
    """Vertical scale of the two charts: the tallest colour bin and the tallest luma bin, never below 1."""
    tallest = lambda cond: F.greatest(F.coalesce(F.max(F.when(cond, F.col("n"))), F.lit(1)), F.lit(1))
    return bins.groupBy(key).agg(
        tallest(F.col("channel") != "luma").alias("rgb_peak"), tallest(F.col("channel") == "luma").alias("luma_peak")
    )
