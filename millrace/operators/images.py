"""Geometry of images that are arrays of rows of numbers, by looking each target pixel up in its source.

A target pixel's place in the source follows from an inverse map; its value is
mixed of the four pixels around that place. All is one array expression a row:
no Python, no shuffle. Beyond the border pixels count as ``fill``, or, for
resizing, as the nearest one. An image without pixels, and a missing one, gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pixel(image: Column, y: Column, x: Column, fill: float | None) -> Column:
    """One pixel; beyond the border ``fill``, or the nearest where that is None."""
    if fill is None:
        y = F.greatest(F.lit(0), F.least(y, F.size(image) - 1))
        x = F.greatest(F.lit(0), F.least(x, F.size(image[0]) - 1))
        return F.get(F.get(image, y), x)
    inside = (y >= 0) & (y < F.size(image)) & (x >= 0) & (x < F.size(image[0]))
    return F.when(inside, F.get(F.get(image, F.greatest(y, F.lit(0))), F.greatest(x, F.lit(0)))).otherwise(F.lit(float(fill)))


def _mixed(image: Column, y: Column, x: Column, fill: float | None) -> Column:
    top, left = F.floor(y).cast("int"), F.floor(x).cast("int")
    down, right = y - F.floor(y), x - F.floor(x)
    at = lambda dy, dx: _pixel(image, top + dy, left + dx, fill)
    return (at(0, 0) * (1 - right) + at(0, 1) * right) * (1 - down) + (at(1, 0) * (1 - right) + at(1, 1) * right) * down


def _once(image: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of an image that is computed once: an expression that makes one would otherwise run again at every pixel looked up."""
    return F.get(F.transform(F.array(image), made), F.lit(0))


def warped(image: Column, source: Callable[[Column, Column], tuple[Column, Column]], height: int, width: int, fill: float | None = 0.0) -> Column:
    """An image of ``height`` by ``width``; ``source(i, j)`` is the (y, x) that target pixel (i, j) is looked up at."""
    if height < 1 or width < 1:
        raise ValueError("an image has a pixel at least")
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    made = lambda image: F.transform(upto(height), lambda i: F.transform(upto(width), lambda j: _mixed(image, *source(i, j), fill)))
    return _once(image, lambda held: F.when((F.size(held) > 0) & (F.size(F.get(held, F.lit(0))) > 0), made(held)))


def resized(image: Column, height: int, width: int) -> Column:
    """The image at another size: pixel centres fall on each other at the corners of both."""
    if height < 1 or width < 1:
        raise ValueError("an image has a pixel at least")
    return _once(image, lambda held: _resized(held, height, width))


def _resized(image: Column, height: int, width: int) -> Column:
    # A target row's two source rows are found once and not for every pixel.
    tall, wide = _neighbours(F.size(image), height), _neighbours(F.size(F.get(image, F.lit(0))), width)
    rows = F.transform(tall, lambda r: F.struct(F.get(image, r["near"]).alias("top"), F.get(image, r["next"]).alias("bottom"), r["share"].alias("share")))
    across = lambda row, c: F.get(row, c["near"]) * (1 - c["share"]) + F.get(row, c["next"]) * c["share"]
    made = F.transform(rows, lambda r: F.transform(wide, lambda c: across(r["top"], c) * (1 - r["share"]) + across(r["bottom"], c) * r["share"]))
    return F.when((F.size(image) > 0) & (F.size(F.get(image, F.lit(0))) > 0), made)


def _neighbours(n: Column, to: int) -> Column:
    """For each of ``to`` places along ``n`` pixels: the pixel at or before it, the next, and how far it is towards that; the border's beyond the border."""
    inside = lambda at: F.greatest(F.lit(0), F.least(at, n - 1))
    place = lambda k: (k + 0.5) * (n / F.lit(float(to))) - 0.5
    found = lambda y: F.struct(inside(F.floor(y).cast("int")).alias("near"), inside(F.floor(y).cast("int") + 1).alias("next"), (y - F.floor(y)).alias("share"))
    return F.transform(F.array(*map(F.lit, range(to))), lambda k: found(place(k)))


def affine(image: Column, matrix: tuple[float, float, float, float], shift: tuple[float, float], height: int, width: int, fill: float = 0.0) -> Column:
    """The image under (y, x) -> M (y, x) + shift about its centre; ``matrix`` (row by row) can be inverted."""
    a, b, c, d = matrix
    det = a * d - b * c
    if not det:
        raise ValueError("the matrix can't be inverted")
    cy, cx = (height - 1) / 2, (width - 1) / 2

    def source(i, j):
        y, x = i - (cy + shift[0]), j - (cx + shift[1])
        return y * (d / det) + x * (-b / det) + cy, y * (-c / det) + x * (a / det) + cx

    return warped(image, source, height, width, fill)


def rotated(image: Column, degrees: float, height: int, width: int, fill: float = 0.0) -> Column:
    """Turned about the centre, counter-clockwise."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return affine(image, (c, -s, s, c), (0.0, 0.0), height, width, fill)


def scaled(image: Column, factor: float, height: int, width: int, fill: float = 0.0) -> Column:
    return affine(image, (factor, 0.0, 0.0, factor), (0.0, 0.0), height, width, fill)


def translated(image: Column, down: float, right: float, height: int, width: int, fill: float = 0.0) -> Column:
    return affine(image, (1.0, 0.0, 0.0, 1.0), (down, right), height, width, fill)


def cropped(image: Column, top: int, left: int, height: int, width: int) -> Column:
    """What lies inside of a window; it is smaller where the window goes beyond the image."""
    return F.transform(F.slice(image, top + 1, height), lambda row: F.slice(row, left + 1, width))


def normalised(image: Column, mean: float, std: float) -> Column:
    return F.transform(image, lambda row: F.transform(row, lambda v: (v - mean) / std))


def from_flat(values: Column, width: int) -> Column:
    """Rows of ``width`` from one array of all pixels."""
    n = F.floor(F.size(values) / width).cast("int")
    rows = F.transform(F.sequence(F.lit(1), n), lambda r: F.transform(F.slice(values, (r - 1) * width + 1, width), lambda v: v.cast("double")))
    return F.when(n > 0, rows)
