from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstselect.functions import columns as c
from burstselect.functions import pixels
from burstselect.params import CENTER_BOX, SelectionParams
from burstselect.sources import photos

PARAMS = SelectionParams()


def png(path, rgb):
    """Write an 8-bit RGB image as PNG."""
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_exposure():
    assert pixels.exposure_fractions(np.full((10, 10), 255, np.uint8), PARAMS) == (True, 1.0, 0.0)
    assert pixels.exposure_fractions(np.zeros((10, 10), np.uint8), PARAMS) == (True, 0.0, 1.0)
    assert pixels.exposure_fractions(np.full((10, 10), 128, np.uint8), PARAMS) == (False, 0.0, 0.0)
    assert pixels.exposure_fractions(np.zeros((0, 0), np.uint8), PARAMS) == (False, 0.0, 0.0)
    edge = np.full((10, 10), 128, np.uint8)
    edge[0] = 250  # exactly a tenth: not more than the limit
    assert pixels.exposure_fractions(edge, PARAMS) == (False, 0.1, 0.0)


def test_laplacian_variance():
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (9, 7), dtype=np.uint8)
    g = img.astype(float)
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    lap = [
        g[mirror(y - 1, 9), x] + g[mirror(y + 1, 9), x] + g[y, mirror(x - 1, 7)] + g[y, mirror(x + 1, 7)] - 4 * g[y, x]
        for y in range(9) for x in range(7)
    ]
    assert pixels.laplacian_variance(img) == pytest.approx(np.var(lap))
    assert pixels.laplacian_variance(np.full((64, 64), 128, np.uint8), CENTER_BOX) == 0.0
    assert pixels.laplacian_variance(img, (2.0, 2.0, 0.1, 0.1)) == pixels.laplacian_variance(img)  # empty cut: whole image
    assert pixels.laplacian_variance(img[:1, :1]) == 0.0


def test_resize():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (40, 30), dtype=np.uint8)
    assert (pixels.resize(img, 40, 30) == img).all()
    assert (pixels.resize(np.full((50, 70), 77, np.uint8), 8, 9) == 77).all()
    ramp = np.tile(np.arange(0, 250, 5, dtype=np.uint8), (50, 1))
    small = pixels.resize(ramp, 8, 9).astype(int)
    assert (np.diff(small, axis=1) > 0).all() and (small == small[0]).all()
    # Halving a two-pixel checker averages it out.
    checker = np.tile(np.array([[0, 200], [200, 0]], np.uint8), (8, 8))
    assert abs(pixels.resize(checker, 8, 8).astype(int)[2:-2, 2:-2] - 100).max() <= 1


def test_dhash():
    ramp = np.tile(np.arange(0, 250, 5, dtype=np.uint8), (50, 1))
    assert pixels.dhash(ramp) == -1 and pixels.dhash(ramp[:, ::-1]) == 0  # all 64 bits, none
    assert pixels.hash_words(np.array([1] + [0] * 63, bool)) == [-(2**63)]
    assert pixels.hash_words(np.array([0] * 63 + [1], bool)) == [1]
    assert len(pixels.hash_words(pixels.dhash_bits(ramp, 16))) == 4


def test_histogram():
    rgb = np.zeros((2, 2, 3), np.uint8)
    rgb[0, 0] = (255, 128, 3)
    h = pixels.histogram(rgb)
    assert h["red"][63] == 1 and h["red"][0] == 3 and h["green"][32] == 1 and h["blue"][0] == 4
    assert h["luma"][(255 * 299 + 128 * 587 + 3 * 114) // 1000 // 4] == 1


def test_tables_of_images(spark):
    rows = [("flat", 4, 4, bytes([128] * 16)), ("white", 2, 8, bytes([255] * 16)), ("broken", None, None, None)]
    images = spark.createDataFrame(rows, "rel string, height int, width int, gray binary")
    m = {r.rel: r for r in pixels.measure_pixels(images).collect()}
    assert not m["flat"].exposure_flag and m["white"].exposure_flag and m["white"].blown == 1.0
    assert not m["broken"].decode_ok and m["broken"].phash == 0 and not m["broken"].exposure_flag
    region = F.when(F.col("rel") == "white", c.center_box())
    s = {r.rel: r.sharpness for r in pixels.measure_sharpness(images.withColumn("region", region)).collect()}
    assert s == {"flat": 0.0, "white": 0.0, "broken": 0.0}
    long = pixels.measure_pixels(images, params=PARAMS.with_(phash_size=16))
    assert {len(r.phash) for r in long.collect()} == {4}


def test_image_source(spark, tmp_path):
    rgb = np.zeros((3, 5, 3), np.uint8)
    rgb[0, 0] = (255, 0, 0)
    rgb[2, 4] = (0, 0, 255)
    png(tmp_path / "a.png", rgb)
    (tmp_path / "bad.png").write_bytes(b"not an image")
    images = photos.read_images(spark, str(tmp_path))
    small = SelectionParams(downscale_long_edge=4)
    got = {r.path.rsplit("/", 1)[1]: r for r in photos.image_pixels(images, small).collect()}
    assert not got["bad.png"].decode_ok and got["bad.png"].gray is None
    a = got["a.png"]
    gray = np.frombuffer(a.gray, np.uint8).reshape(a.height, a.width)
    assert gray.shape == (3, 5) and gray[0, 0] == 76 and gray[2, 4] == 29 and gray[1, 1] == 0
    assert (a.rgb_height, a.rgb_width) == (2, 4) and len(a.rgb) == 2 * 4 * 3
    turned = photos.image_pixels(images.withColumn("orientation", F.lit(6))).where("decode_ok").first()
    gray = np.frombuffer(turned.gray, np.uint8).reshape(turned.height, turned.width)
    assert gray.shape == (5, 3) and gray[0, 2] == 76 and gray[4, 0] == 29


def test_orientations():
    img = np.arange(6).reshape(2, 3)
    up = {o: photos.upright(img, o) for o in range(1, 9)}
    assert (up[3] == np.rot90(img, 2)).all() and (up[6] == np.rot90(img, -1)).all() and (up[8] == np.rot90(img)).all()
    assert (up[2] == img[:, ::-1]).all() and (up[4] == img[::-1]).all() and (up[5] == img.T).all()
    assert (up[7] == np.rot90(img, 2).T).all() and (photos.upright(img, 0) == img).all()


def test_tiles_of_any_size_give_the_sharpness_of_the_whole_image(spark, tmp_path):
    rng = np.random.default_rng(8)
    shapes = [(1, 1), (1, 9), (7, 1), (2, 2), (13, 17), (40, 23)]
    images = [rng.integers(0, 256, s).astype(np.uint8) for s in shapes]
    region = [None, (0.0, 0.0, 1.0, 1.0), (0.2, 0.25, 0.5, 0.6), (0.9, 0.9, 0.9, 0.9), (0.3, 0.3, 0.0, 0.0)]
    rows, want = [], {}
    for i, img in enumerate(images):
        np.save(tmp_path / f"{i}.npy", img)
        for j, r in enumerate(region):
            rows.append((f"{i}-{j}", str(tmp_path / f"{i}.npy"), *img.shape, img.tobytes(), r))
            want[f"{i}-{j}"] = pixels.laplacian_variance(img, r)
    rows += [("none", None, None, None, None, None), ("gone", str(tmp_path / "gone.npy"), 5, 5, None, None)]
    want |= {"none": 0.0, "gone": 0.0}
    table = spark.createDataFrame(rows, "rel string, path string, height int, width int, gray binary, region struct<x:double,y:double,w:double,h:double>")

    def load(path, top, bottom, left, right):
        try:
            return np.load(path, mmap_mode="r")[top:bottom, left:right]
        except FileNotFoundError:
            return None

    for tile, reader in ((1, None), (3, load), (16, None), (1000, load)):
        got = {r.rel: r.sharpness for r in pixels.sharpness_by_tiles(table, load=reader, tile=tile).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) <= 1e-9 * max(1, v) for k, v in want.items()), tile
