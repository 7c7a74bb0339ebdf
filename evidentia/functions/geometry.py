"""Boxes (struct<x0, y0, x1, y1>) and heights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of two; null for an empty array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def line_height(words: Column, box: Column) -> Column:
    """Upper median of the heights of the words that aren't blank, else the height of the box."""
    heights = F.transform(F.filter(words, lambda w: F.trim(w["text"]) != ""), lambda w: w["bbox"]["y1"] - w["bbox"]["y0"])
    return F.coalesce(upper_median(heights), box["y1"] - box["y0"])


def merge_boxes(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1")
    )


def overlap_fraction(a: Column, b: Column) -> Column:
    """Shared area of two boxes by the area of the smaller, areas counting 1 at least."""
    width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])

    def area(box: Column) -> Column:
        return F.greatest(F.lit(1.0), (box["x1"] - box["x0"]) * (box["y1"] - box["y0"]))

    return F.when((width <= 0) | (height <= 0), 0.0).otherwise(width * height / F.least(area(a), area(b)))


def scale_for(width: Column, height: Column, target: Column, most: float = 2.0) -> Column:
    """The factor that brings the longer edge to ``target``, ``most`` at most; 1 for an empty image."""
    edge = F.greatest(width, height)
    return F.when(edge == 0, 1.0).otherwise(F.least(target / edge, F.lit(most)))
