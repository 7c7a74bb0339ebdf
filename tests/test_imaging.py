"""Images: files through decoding and resizing, and every step of the preparation with values worked out by hand."""

import struct
import zlib

import numpy as np
import pytest

from evidentia.operators import imaging

IMAGE = "image_id long, width int, height int, pixels binary"


def png(path, pixels):
    """Write an array (height, width, channels) of 1, 3 or 4 channels as a PNG file."""
    height, width, channels = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def image(spark, pixels, key=1):
    pixels = np.asarray(pixels, np.uint8)
    return spark.createDataFrame([(key, pixels.shape[1], pixels.shape[0], bytearray(pixels.tobytes()))], IMAGE)


def test_files_through_the_whole_chain(spark, tmp_path):
    rng = np.random.default_rng(1)
    given = {"rgb.png": rng.integers(0, 256, (6, 8, 3)), "rgba.png": rng.integers(0, 256, (4, 4, 4)), "grey.png": rng.integers(0, 256, (3, 5, 1))}
    for name, pixels in given.items():
        png(tmp_path / name, pixels.astype(np.uint8))
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = {r.path.rpartition("/")[2]: r for r in imaging.decoded(spark, str(tmp_path)).collect()}
    assert set(found) == set(given)
    for name, pixels in given.items():
        got = np.frombuffer(found[name].pixels, np.uint8).reshape(found[name].height, found[name].width, 4)
        full = np.full((*pixels.shape[:2], 4), 255)
        full[..., : max(3, pixels.shape[2])] = pixels
        assert (got == full).all(), name
    ready = imaging.prepare(imaging.resized(imaging.decoded(spark, str(tmp_path)), 4)).collect()
    assert len(ready) == 3 and all(len(r.grey) == len(r.flat) == len(r.binary) > 0 and "small" in r.warnings for r in ready)


def test_resizing_is_the_mean_of_areas(spark):
    pixels = np.zeros((4, 4, 4)) + np.array([[0, 10, 20, 30], [40, 50, 60, 70], [80, 90, 100, 110], [120, 130, 140, 150]])[..., None]
    (half,) = imaging.resized(image(spark, pixels), 2).collect()
    assert (half.width, half.height) == (2, 2)
    assert np.frombuffer(half.pixels, np.uint8).reshape(2, 2, 4)[..., 0].tolist() == [[25, 45], [105, 125]]
    (odd,) = imaging.resized(image(spark, np.zeros((1, 3, 4)) + np.array([[[0], [90], [180]]])), 2).collect()
    assert (odd.width, odd.height) == (2, 1)
    # a new pixel covers one and a half: (0 + 90 / 2) / 1.5 and (90 / 2 + 180) / 1.5
    assert np.frombuffer(odd.pixels, np.uint8).reshape(2, 4)[:, 0].tolist() == [30, 150]
    (large,) = imaging.resized(image(spark, np.full((2, 3, 4), 7)), 1000).collect()
    assert (large.width, large.height) == (6, 4) and set(large.pixels) == {7}
    assert imaging.resized(image(spark, np.zeros((0, 0, 4))), 10).collect() == []


def test_grey():
    colours = np.array([[[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [255, 255, 255, 255]]], np.uint8)
    assert imaging.grey(colours).tolist() == [[76, 150, 29, 255]]  # 226 of 255 are spanned: not stretched
    narrow = np.repeat(np.array([[100, 150, 200]], np.uint8)[..., None], 4, axis=2)
    assert imaging.grey(narrow).tolist() == [[0, 128, 255]]
    assert imaging.grey(np.full((2, 2, 4), 9, np.uint8)).tolist() == [[9, 9], [9, 9]]


def test_flatten_and_binarise():
    assert set(imaging.flatten(np.full((30, 40), 100, np.uint8)).ravel().tolist()) == {160}
    small = np.array([[10, 30], [50, 70]], np.uint8)
    assert imaging.flatten(small).tolist() == [[40, 120], [200, 255]]  # the window is the whole image, its mean 40
    assert imaging.binarise(np.array([[10, 10, 200, 200]], np.uint8)).tolist() == [[0, 0, 255, 255]]
    assert imaging.binarise(np.array([[10, 200, 10, 10]], np.uint8)).tolist() == [[255, 0, 255, 255]]
    assert imaging.binarise(np.array([[10, 200]], np.uint8), threshold=250).tolist() == [[255, 255]]


@pytest.mark.parametrize("radius", [1, 2, 7, 50])
def test_means_are_those_of_the_window(radius):
    pixels = np.random.default_rng(2).integers(0, 256, (9, 13))
    got = imaging._means(imaging._means(pixels, radius, 1), radius, 0)
    for y in range(9):
        for x in range(13):
            window = pixels[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
            assert abs(got[y, x] - window.mean()) < 1e-9


def test_quality():
    flat = imaging.quality(np.full((100, 100), 128, np.uint8))
    assert (flat["sharpness"], flat["contrast"], flat["megapixels"], flat["warnings"]) == (0.0, 0.0, 0.01, ["blurred", "flat", "small"]) and abs(flat["brightness"] - 128 / 255) < 1e-12
    board = np.indices((600, 600)).sum(axis=0) % 2 * 255
    sharp = imaging.quality(board.astype(np.uint8))
    assert (sharp["sharpness"], sharp["contrast"], sharp["warnings"]) == (1.0, 1.0, []) and sharp["brightness"] == 0.5
    assert imaging.quality(np.full((600, 600), 250, np.uint8))["warnings"] == ["blurred", "glare", "flat"]
    assert imaging.quality(np.full((600, 600), 20, np.uint8))["warnings"] == ["blurred", "dark", "flat"]


def test_crop_and_schedule(spark):
    pixels = np.zeros((4, 4, 4)) + np.arange(16).reshape(4, 4)[..., None]
    boxes = spark.createDataFrame([(1, 0.25, 0.25, 0.75, 0.75), (1, 0.0, 0.0, 0.04, 1.0)], "image_id long, x0 double, y0 double, x1 double, y1 double")
    (cut,) = imaging.crop(image(spark, pixels), boxes).collect()
    assert (cut.width, cut.height) == (2, 2)
    assert np.frombuffer(cut.pixels, np.uint8).reshape(2, 2, 4)[..., 0].tolist() == [[5, 6], [9, 10]]
    assert imaging.passes(100, 221) == imaging.SPINE_PASSES and imaging.passes(100, 220) == imaging.COVER_PASSES


def test_bytes_that_do_not_fit_give_nulls(spark):
    rows = spark.createDataFrame([(1, 2, 2, bytearray(3)), (2, 0, 0, None)], IMAGE)
    assert [(r.grey, r.warnings) for r in imaging.prepare(rows).orderBy("image_id").collect()] == [(None, None), (None, None)]


@pytest.mark.parametrize(("size", "radius"), [(8, 3), (8, 8), (16, 1)])
def test_tiles_are_flattened_like_whole_images(spark, size, radius):
    rng = np.random.default_rng(4)
    whole = {i: rng.integers(0, 256, shape).astype(np.uint8) for i, shape in enumerate([(1, 1), (8, 8), (9, 30), (33, 17), (5, 40)])}
    tiles = [
        (i, y // size, x // size, p.shape[1], p.shape[0], bytearray(p[y : y + size, x : x + size].tobytes()))
        for i, p in whole.items() for y in range(0, p.shape[0], size) for x in range(0, p.shape[1], size)
    ]
    found = imaging.flatten_tiles(spark.createDataFrame(tiles, "image_id long, row int, col int, width int, height int, pixels binary"), size, radius).collect()
    assert len(found) == len(tiles)
    for r in found:
        expected = imaging.flatten(whole[r.image_id], radius)[r.row * size :, r.col * size :][:size, :size]
        got = np.frombuffer(r.pixels, np.uint8).reshape(expected.shape)
        assert np.abs(got.astype(int) - expected).max() <= 1 and (got == expected).mean() > 0.95
    with pytest.raises(ValueError, match="neighbouring"):
        imaging.flatten_tiles(spark.createDataFrame(tiles, "image_id long, row int, col int, width int, height int, pixels binary"), 4, 5)
