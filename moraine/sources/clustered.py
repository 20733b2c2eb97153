"""Particle tables laid out along the Hilbert curve, and regions read from them.

A clustered table is partitioned by the curve's coarse cells (``block``, the first bits of the
code) and sorted by the code within files. A region's bounding cuboid becomes blocks, which
prune folders before any file is opened, and intervals of codes, which prune row groups; the region itself is then
tested on what is left. Rows near each other are written together, so a small region opens few files
however large the table.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.box import Box
from moraine.functions.hilbert import covered, curve_codes, curve_depth, curve_intervals, with_hilbert_code
from moraine.operators.groups import Cuboid, Geometry, Sphere, region


def write_clustered(particles: DataFrame, box: Box, path: str, cell: float, level: int = 2) -> None:
    """Write the rows with their code (``hilbert``, cells not larger than ``cell``) in folders of
    ``2 ** level`` blocks per axis. Rows are ranged by the code, so a block with many rows is many files."""
    depth = curve_depth(box, cell)
    level = min(level, depth)
    rows = with_hilbert_code(particles, box, depth).withColumn("block", F.shiftright("hilbert", box.dimension * (depth - level)))
    rows.repartitionByRange("block", "hilbert").sortWithinPartitions("block", "hilbert").write.mode("overwrite").partitionBy("block").parquet(path)


def bounds(geometry: Geometry) -> list[tuple[float, float]]:
    """The lowest and highest coordinate of a region along each axis."""
    if isinstance(geometry, Cuboid):
        return [(a, a + n) for a, n in zip(geometry.lowest, geometry.lengths)]
    if isinstance(geometry, Sphere):
        return [(c - geometry.radius, c + geometry.radius) for c in geometry.centre]
    size = math.sqrt(sum(a * a for a in geometry.axis))
    reach = [abs(a / size) * geometry.length / 2 + math.sqrt(max(1 - (a / size) ** 2, 0.0)) * geometry.radius for a in geometry.axis]
    return [(c - r, c + r) for c, r in zip(geometry.centre, reach)]


def read_region(spark: SparkSession, path: str, box: Box, geometry: Geometry, cell: float, level: int = 2, species: int | None = None) -> DataFrame:
    """The rows of a clustered table inside a region; ``cell`` and ``level`` as it was written."""
    depth = curve_depth(box, cell)
    level, around = min(level, depth), [(a - 1e-9 * n, b + 1e-9 * n) for (a, b), n in zip(bounds(geometry), box.lengths)]  # above rounding
    axes = [covered(a, b, n, 1 << level) for (a, b), n in zip(around, box.lengths)]
    rows = spark.read.parquet(path).where(F.col("block").isin([curve_codes(c, level) for c in product(*axes)]))
    near = reduce(lambda a, b: a | b, [F.col("hilbert").between(a, b) for a, b in curve_intervals(box, around, depth)])
    return region(rows.where(near), box, geometry, species=species).drop("block", "hilbert")
