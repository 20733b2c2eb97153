"""Periodic orthorhombic boxes: column expressions for wrapping and distances.

A box is centred on the origin. Coordinates are scalar columns, one per axis.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    lengths: tuple[float, ...]

    def __post_init__(self):
        if not 1 <= len(self.lengths) <= 3 or min(self.lengths) <= 0:
            raise ValueError("a box has one to three positive edge lengths")

    @property
    def dimension(self) -> int:
        return len(self.lengths)

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: self.dimension]

    @property
    def volume(self) -> float:
        return prod(self.lengths)

    @property
    def edges(self) -> list[list[float]]:
        return [[n if i == j else 0.0 for j in range(self.dimension)] for i, n in enumerate(self.lengths)]


def wrap_shift(r: Column, length: float) -> Column:
    """How often a single wrap subtracts ``length``: 1, 0 or -1; a coordinate
    exactly at the border stays."""
    return F.when(r > length / 2, 1.0).when(r < -length / 2, -1.0).otherwise(0.0)


def image_shift(r: Column, length: float) -> Column:
    """How often wrapping until inside subtracts ``length``."""
    return F.ceil(F.abs(r) / length - 0.5).cast("double") * F.signum(r)


def minimum_image(dr: Column, length: float) -> Column:
    return dr - length * wrap_shift(dr, length)


def square(c: Column) -> Column:
    return c * c


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def reduce_periodic(particles: DataFrame, box: Box, until_inside: bool = False) -> DataFrame:
    """Wrap positions into the box and count the crossings in ix, iy, iz (made
    if missing). One wrap per axis, or as many as it takes."""
    out = {}
    for axis, n in zip(box.axes, box.lengths):
        shift = (image_shift if until_inside else wrap_shift)(F.col(axis), n)
        image = F.col("i" + axis) if "i" + axis in particles.columns else F.lit(0)
        out[axis] = F.col(axis) - n * shift
        out["i" + axis] = (image + shift).cast("int")
    return particles.withColumns(out)


def extend_periodic(particles: DataFrame, box: Box) -> DataFrame:
    """Unwrapped positions: r + image * length."""
    return particles.withColumns({axis: F.col(axis) + F.col("i" + axis) * n for axis, n in zip(box.axes, box.lengths)})
