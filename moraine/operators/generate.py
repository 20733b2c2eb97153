"""Generated tables: lattices, random velocities, shuffles, lag grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.box import Box
from moraine.functions.draws import normal, permuted
from moraine.operators.sorting import numbered

#: Sites of a unit cell, in quarters of its edge, by lattice and dimension: face-centred (fcc), simple (sc).
SITES = {
    "fcc": {2: [(1, 1), (3, 3)], 3: [(1, 1, 1), (3, 3, 1), (3, 1, 3), (1, 3, 3)]},
    "sc": {1: [(2,)], 2: [(2, 2)], 3: [(2, 2, 2)]},
}


def iota(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def lattice_cells(n: int, lengths: Sequence[float], per_cell: int) -> tuple[list[int], float]:
    """The numbers of unit cells per axis and the largest lattice constant with
    at least ``n`` sites: the one that the volume per cell allows at most, or the
    next smaller one at which a whole number of cells fills an edge."""
    most = (math.prod(lengths) / math.ceil(n / per_cell)) ** (1 / len(lengths))
    fitting = {x / k for x in lengths for k in range(1, int(x / most) + 3)}
    for a in sorted({most} | {a for a in fitting if a < most}, reverse=True):
        cells = [int(x / a + 1e-9) for x in lengths]
        if per_cell * math.prod(cells) >= n:
            return cells, a
    raise AssertionError("one cell more along every axis is always enough")


def fcc_lattice(spark: SparkSession, n: int, box: Box, slab: Sequence[float] | None = None) -> DataFrame:
    """``n`` particles on a face-centred lattice."""
    return lattice(spark, n, box, slab, "fcc")


def lattice(spark: SparkSession, n: int, box: Box, slab: Sequence[float] | None = None, kind: str = "fcc") -> DataFrame:
    """(id, x..): ``n`` particles on a lattice (``SITES``) in the box, or in a
    centred slab given by fractions of its edges. Surplus sites become vacancies
    at regular distances."""
    slab = tuple(slab or (1.0,) * box.dimension)
    if len(slab) != box.dimension or not all(0 < s <= 1 for s in slab):
        raise ValueError("slab fractions are in (0, 1], one per axis")
    if box.dimension not in SITES.get(kind, {}):
        raise ValueError(f"there is no {kind} lattice of {box.dimension} dimensions")
    lengths = [x * s for x, s in zip(box.lengths, slab)]
    sites = SITES[kind][box.dimension]
    cells, a = lattice_cells(n, lengths, len(sites))
    surplus = len(sites) * math.prod(cells) - n
    skip = math.ceil(len(sites) * math.prod(cells) / surplus) if surplus else 0
    # the k-th particle has k // (skip - 1) vacancies before it
    site = F.col("id") + (F.floor(F.col("id") / (skip - 1)) if skip > 1 else F.lit(0))
    rows = spark.range(n).withColumn("_site", site)
    rest, out = F.floor(F.col("_site") / len(sites)), []
    place = F.pmod(F.col("_site"), F.lit(len(sites)))
    for k, (axis, count, length) in enumerate(zip(box.axes, cells, lengths)):
        corner = F.pmod(rest, F.lit(count))
        rest = F.floor(rest / count)
        quarter = F.element_at(F.array(*[F.lit(s[k] / 4) for s in sites]), (place + 1).cast("int"))
        out.append(((corner + quarter) * a - length / 2).alias(axis))
    return rows.select("id", *out)


def boltzmann_velocities(particles: DataFrame, box: Box, temperature: float, seed: int = 0) -> DataFrame:
    """Normal velocities with variance T / m, without drift of the centre of
    mass. A particle's draw depends on the seed, its id and the axis alone."""
    names = ["v" + a for a in box.axes]
    drawn = particles.withColumns({n: normal(seed, "id", F.lit(k)) * F.sqrt(temperature / F.col("mass")) for k, n in enumerate(names)})
    drift = drawn.agg(F.sum("mass").alias("_m"), *[F.sum(F.col("mass") * F.col(n)).alias("_p" + n) for n in names])
    moved = drawn.crossJoin(F.broadcast(drift))  # one row
    return moved.withColumns({n: F.col(n) - F.col("_p" + n) / F.col("_m") for n in names}).drop("_m", *["_p" + n for n in names])


def shuffled(rows: DataFrame, seed: int, order: Sequence[str], name: str = "place") -> DataFrame:
    """Add each row's place in a random order of all rows, which depends on the seed and
    on the row's number in the order of the columns ``order`` alone. Nothing is sorted by a random
    key; ``repartitionByRange`` on the place lays the rows out by it."""
    ranked = numbered(rows, order, "_rank")
    return ranked.withColumn(name, permuted("_rank", ranked.count(), seed)).drop("_rank")


def semilog_grid(start: float, stop: float, decimation: int) -> list[float]:
    """start, start + h, ...: the step is ``start`` and doubles after every
    ``decimation`` points (0: never); ``stop`` is excluded."""
    if start <= 0 or decimation < 0:
        raise ValueError("the start must be positive, the decimation not negative")
    out: list[float] = []
    while True:
        double, point = divmod(len(out), decimation) if decimation else (0, len(out))
        x = start * (1 + decimation * (2**double - 1) + point * 2**double)
        if x >= stop:
            return out
        out.append(x)
