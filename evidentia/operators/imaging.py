"""Pixels: rows (image_id, width, height, pixels) with RGBA or grey bytes, an image a row.

An image is worked on by numpy inside a task, batch by batch; histograms and thresholds are table operations too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLIP = 0.005
WIDE_ENOUGH = 200
RADIUS = 24


def grey(rgba: np.ndarray) -> np.ndarray:
    """Luma of RGBA pixels (height, width, 4), stretched to the full range unless it spans most of it already.

    The darkest and lightest half per cent are clipped.
    """
    luma = np.rint((rgba[..., 0] * 299.0 + rgba[..., 1] * 587.0 + rgba[..., 2] * 114.0) / 1000).astype(np.uint8)
    seen = np.cumsum(np.bincount(luma.ravel(), minlength=256))
    low, high = (int(np.argmax(seen >= luma.size * cut)) for cut in (CLIP, 1 - CLIP))
    if high - low > WIDE_ENOUGH or high <= low:
        return luma
    return np.clip(np.rint((luma.astype(float) - low) * 255 / (high - low)), 0, 255).astype(np.uint8)


def _means(image: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Moving averages over what of the window lies inside the image."""
    sums = np.cumsum(np.insert(image.astype(float), 0, 0, axis=axis), axis=axis)
    n = image.shape[axis]
    low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
    width = (high - low).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
    return (np.take(sums, high, axis=axis) - np.take(sums, low, axis=axis)) / width


def flatten(image: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Divided by its blurred self, so that shadows and glare even out."""
    local = _means(_means(image, radius, 1), radius, 0)
    return np.clip(np.rint(image * 160.0 / np.maximum(local, 1)), 0, 255).astype(np.uint8)


def flatten_tiles(tiles: DataFrame, size: int, radius: int = RADIUS) -> DataFrame:
    """``flatten`` for grey images that don't fit a row: tiles (image_id, row, col, width, height, pixels), ``size`` wide and high but at the image's
    right and lower edge, where width and height are the image's -> the same tiles, flattened.

    A tile sends each of its eight neighbours the margin of ``radius`` pixels (at most ``size``) that this one's windows reach into, so what a task holds
    is a tile and its margin.
    """
    if not 0 <= radius <= size:
        raise ValueError("a window may reach into neighbouring tiles only")
    shape = "image_id long, row int, col int, width int, height int, y int, x int, part_height int, part_width int, pixels binary"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for r in batch.itertuples():
                top, left = r.row * size, r.col * size
                grid = np.frombuffer(r.pixels, np.uint8).reshape(min(size, r.height - top), min(size, r.width - left))
                for row in range(max(r.row - 1, 0), min(r.row + 2, -(-r.height // size))):
                    for col in range(max(r.col - 1, 0), min(r.col + 2, -(-r.width // size))):
                        y, x = max(row * size - radius - top, 0), max(col * size - radius - left, 0)
                        part = grid[y : max((row + 1) * size + radius - top, 0), x : max((col + 1) * size + radius - left, 0)]
                        if part.size:
                            parts.append((r.image_id, row, col, r.width, r.height, top + y, left + x, *part.shape, part.tobytes()))
            yield pd.DataFrame(parts, columns=[c.split()[0] for c in shape.split(", ")])

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        image, row, col, width, height = (int(parts[c].iloc[0]) for c in ("image_id", "row", "col", "width", "height"))
        top, left = max(row * size - radius, 0), max(col * size - radius, 0)
        grid = np.zeros((min((row + 1) * size + radius, height) - top, min((col + 1) * size + radius, width) - left), np.uint8)
        for p in parts.itertuples():
            grid[p.y - top : p.y - top + p.part_height, p.x - left : p.x - left + p.part_width] = np.frombuffer(p.pixels, np.uint8).reshape(p.part_height, p.part_width)
        flat = flatten(grid, radius)[row * size - top :, col * size - left :][:size, :size]
        return pd.DataFrame([(image, row, col, width, height, flat.tobytes())], columns=["image_id", "row", "col", "width", "height", "pixels"])

    parts = tiles.select("image_id", "row", "col", "width", "height", "pixels").mapInPandas(spread, shape)
    return parts.groupBy("image_id", "row", "col").applyInPandas(joined, "image_id long, row int, col int, width int, height int, pixels binary")


def otsu(counts: np.ndarray) -> int:
    """The grey value that splits a histogram with the largest variance between the parts; the first of equals, the middle if none does."""
    n, total = counts.sum(), float((counts * np.arange(256)).sum())
    below, weight = np.cumsum(counts), np.cumsum(counts * np.arange(256.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = below * (n - below) * (weight / below - (total - weight) / (n - below)) ** 2
    variance = np.nan_to_num(np.where((below > 0) & (below < n), variance, 0))
    return int(variance.argmax()) if variance.max() > 0 else 127


def binarise(image: np.ndarray, threshold: int | None = None) -> np.ndarray:
    """Black on white: above the threshold white, turned round where less than half is above."""
    limit = otsu(np.bincount(image.ravel(), minlength=256)) if threshold is None else threshold
    above = image > limit
    if above.sum() < image.size / 2:
        above = ~above
    return np.where(above, 255, 0).astype(np.uint8)


def quality(image: np.ndarray) -> dict:
    """Sharpness, brightness, contrast (0 to 1), megapixels and warnings of a grey image."""
    x = image.astype(float)
    inner = 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    sharp = min(1.0, float(inner.std()) / 45) if inner.size else 0.0
    bright = float(x.mean()) / 255 if x.size else 0.0
    contrast = float(x.max() - x.min()) / 255 if x.size else 0.0
    size = x.size / 1e6
    rules = ((sharp < 0.15, "blurred"), (bright < 0.22, "dark"), (bright > 0.9, "glare"), (contrast < 0.35, "flat"), (size < 0.25, "small"))
    return {"sharpness": sharp, "brightness": bright, "contrast": contrast, "megapixels": size, "warnings": [name for hit, name in rules if hit]}


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, width, height, pixels) of the image files under ``path``, RGBA bytes from the top; the JVM decodes them, what it can't read is left out.

    The id is a hash of the path. Channels come as blue, green, red[, alpha], or grey alone.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("n"), "image.data")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pixels = []
            for r in batch.itertuples():
                given = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n)
                rgba = np.full((r.height, r.width, 4), 255, np.uint8)
                rgba[..., : 4 if r.n == 4 else 3] = given[..., [2, 1, 0, 3]] if r.n == 4 else given[..., ::-1]
                pixels.append(rgba.tobytes())
            yield batch[["image_id", "path", "width", "height"]].assign(pixels=pixels)

    return rows.mapInPandas(work, "image_id long, path string, width int, height int, pixels binary")


def _shares(old: int, new: int) -> np.ndarray:
    """By new pixel how much each old one counts in it, along one axis: the share of the new one's stretch that lies on it."""
    edges = np.arange(new + 1) * old / new
    low, high = np.maximum(edges[:-1, None], np.arange(old)), np.minimum(edges[1:, None], np.arange(1, old + 1))
    return np.maximum(high - low, 0) * new / old


def resized(images: DataFrame, longest: int) -> DataFrame:
    """Images (image_id, width, height, pixels) scaled to a longer side of ``longest``, but by 2 at most, each pixel the mean of the area it covers."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                scale = min(longest / max(r.width, r.height), 2.0)
                width, height = (max(1, int(n * scale + 0.5)) for n in (r.width, r.height))
                given = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 4).astype(float)
                across = np.einsum("ij,hjc->hic", _shares(r.width, width), given)
                rows.append((r.image_id, width, height, np.rint(np.einsum("ij,jwc->iwc", _shares(r.height, height), across)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "pixels"])

    return images.select("image_id", "width", "height", "pixels").where("width > 0 and height > 0").mapInPandas(work, "image_id long, width int, height int, pixels binary")


def prepare(images: DataFrame) -> DataFrame:
    """Raw RGBA images -> grey, flattened and binarised ones, with their quality. Images whose bytes don't fit their size give nulls."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                data = np.frombuffer(r.pixels or b"", np.uint8)
                if data.size != r.width * r.height * 4 or not data.size:
                    rows.append((r.image_id, None, None, None, None, None, None, None, None))
                    continue
                g = grey(data.reshape(r.height, r.width, 4))
                q = quality(g)
                rows.append((r.image_id, g.tobytes(), flatten(g).tobytes(), binarise(g).tobytes(), *q.values()))
            yield pd.DataFrame(rows, columns=["image_id", "grey", "flat", "binary", "sharpness", "brightness", "contrast", "megapixels", "warnings"])

    shape = "image_id long, grey binary, flat binary, binary binary, sharpness double, brightness double, contrast double, megapixels double, warnings array<string>"
    return images.select("image_id", "width", "height", "pixels").mapInPandas(work, shape)


def crop(images: DataFrame, boxes: DataFrame, least: float = 0.05) -> DataFrame:
    """Images cut to boxes (image_id, x0, y0, x1, y1 as shares); boxes narrower than ``least`` are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                a, b, c, d = (round(v * n) for v, n in ((r.x0, r.width), (r.x1, r.width), (r.y0, r.height), (r.y1, r.height)))
                cut = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 4)[c:d, a:b]
                rows.append((r.image_id, b - a, d - c, cut.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "pixels"])

    wide = boxes.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    return images.join(wide, "image_id").mapInPandas(work, "image_id long, width int, height int, pixels binary")


def histogram_threshold(values: DataFrame, by: str, value: str = "v") -> DataFrame:
    """Rows of (by, value 0 to 255) -> (by, threshold, low, high) by grouped counts and windows: the split above and the clipping points."""
    counts = values.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    order, whole = Window.partitionBy(by).orderBy("v"), Window.partitionBy(by)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumns({"below": F.sum("n").over(upto), "weight": F.sum(F.col("n") * F.col("v")).over(upto), "all": F.sum("n").over(whole), "total": F.sum(F.col("n") * F.col("v")).over(whole)})
    rest = F.col("all") - F.col("below")
    apart = F.col("weight") / F.col("below") - F.when(rest > 0, (F.col("total") - F.col("weight")) / rest)
    variance = F.when(rest > 0, F.col("below").cast("double") * rest * apart * apart).otherwise(0.0)
    c = c.withColumn("variance", variance)
    return c.groupBy(by).agg(
        F.when(F.max("variance") > 0, F.min_by("v", F.struct(-F.col("variance"), F.col("v")))).otherwise(127).alias("threshold"),
        F.min(F.when(F.col("below") >= F.col("all") * CLIP, F.col("v"))).alias("low"),
        F.min(F.when(F.col("below") >= F.col("all") * (1 - CLIP), F.col("v"))).alias("high"),
    )


# What is read, and with which layout in mind, in this order.
COVER_PASSES = [
    ("raw", "auto"), ("small grey", "auto"), ("small grey", "sparse with orientation"), ("grey", "sparse"), ("flat", "auto"), ("raw", "block"), ("raw", "sparse"),
    ("binary", "auto"), ("grey", "block"),
]
SPINE_PASSES = [("raw", "sparse"), ("small grey", "sparse"), ("grey", "sparse"), ("binary", "block")]


def passes(width: int, height: int) -> list[tuple[str, str]]:
    """The reading schedule (variant, layout): a spine, much higher than wide, has one of its own."""
    return SPINE_PASSES if height > 2.2 * width else COVER_PASSES
