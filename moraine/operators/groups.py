"""Row selections of particle tables and what is done with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.functions.box import Box, extend_periodic, reduce_periodic, square, total


NO_BUCKET = -(1 << 62)  # of rows without an order


@dataclass(frozen=True)
class Cuboid:
    lowest: tuple[float, ...]
    lengths: tuple[float, ...]

    def contains(self, r: Sequence[Column]) -> Column:
        out = F.lit(True)
        for c, low, n in zip(r, self.lowest, self.lengths):
            out = out & (c - low >= 0) & (c - low <= n)
        return out


@dataclass(frozen=True)
class Sphere:
    centre: tuple[float, ...]
    radius: float

    def contains(self, r: Sequence[Column]) -> Column:
        return total([square(c - m) for c, m in zip(r, self.centre)]) <= self.radius**2


@dataclass(frozen=True)
class Cylinder:
    """Closed; ``axis`` need not be normalised."""

    centre: tuple[float, ...]
    axis: tuple[float, ...]
    radius: float
    length: float

    def contains(self, r: Sequence[Column]) -> Column:
        size = sum(a * a for a in self.axis) ** 0.5
        d = [c - m for c, m in zip(r, self.centre)]
        along = square(total([x * (a / size) for x, a in zip(d, self.axis)]))
        return (total([square(x) for x in d]) - along <= self.radius**2) & (along <= (self.length / 2) ** 2)


Geometry = Cuboid | Sphere | Cylinder


def region_mask(box: Box, geometry: Geometry, selection: str = "included", species: int | None = None) -> Column:
    """The predicate of a region; exclusion turns the geometry only."""
    if selection not in ("included", "excluded"):
        raise ValueError("selection is 'included' or 'excluded'")
    mask = geometry.contains([F.col(a) for a in box.axes])
    mask = mask if selection == "included" else ~mask
    return mask if species is None else mask & (F.col("species") == species)


def all_particles(particles: DataFrame) -> DataFrame:
    return particles


def region(particles: DataFrame, box: Box, geometry: Geometry, selection: str = "included", species: int | None = None) -> DataFrame:
    return particles.where(region_mask(box, geometry, selection, species))


def id_range(particles: DataFrame, first: int, last: int, count: int) -> DataFrame:
    """Particles ``first`` to ``last``, counted from 1 and inclusive; stored ids
    count from 0."""
    if first < 1 or last < first:
        raise ValueError("the range of ids is empty or inverse")
    if last > count:
        raise ValueError("the range of ids goes beyond the particles")
    return particles.where(F.col("id").between(first - 1, last - 1))


def sampled_steps(series: DataFrame, start: int = 0, every: int = 1) -> DataFrame:
    if every < 1:
        raise ValueError("the sampling interval must be positive")
    return series.where((F.col("step") >= start) & ((F.col("step") - start) % every == 0))


def sample_positions(group: DataFrame, box: Box) -> DataFrame:
    """Unwrapped positions of a group, keyed by id."""
    keys = [c for c in ("step", "time") if c in group.columns]
    return extend_periodic(group, box).select(*keys, "id", *box.axes)


def sample_columns(group: DataFrame, *names: str) -> DataFrame:
    keys = [c for c in ("step", "time") if c in group.columns]
    return group.select(*keys, "id", *names)


def set_columns(particles: DataFrame, sample: DataFrame, names: Sequence[str], box: Box | None = None) -> DataFrame:
    """Write a sample's columns back by id; other particles keep theirs. With a
    box the columns are positions: they are wrapped and the images start anew."""
    kinds = dict(particles.dtypes)
    for n in names:
        if kinds.get(n) != dict(sample.dtypes).get(n):
            raise TypeError(f"column {n!r} differs in type")
    if box is not None:
        wrapped = reduce_periodic(sample.drop(*["i" + a for a in box.axes]), box, until_inside=True)
        names = [*names, *["i" + a for a in box.axes]]
        sample = wrapped
    new = sample.select("id", F.lit(True).alias("_set"), *[F.col(n).alias("_new_" + n) for n in names])
    out = particles.join(new, "id", "left")
    for n in names:
        old = F.col(n) if n in particles.columns else F.lit(0)
        out = out.withColumn(n, F.when(F.col("_set"), F.col("_new_" + n)).otherwise(old))
    return out.drop("_set", *["_new_" + n for n in names])


def to_particle(group: DataFrame, box: Box, count: int | None = None) -> DataFrame:
    """A group as a table of its own, with ids 0, 1, ... in the old order. The
    ids come from one number per range of old ids, so no task holds all rows."""
    columns = [*box.axes, *["i" + a for a in box.axes], "species", *["v" + a for a in box.axes], "mass"]
    if count is not None and group.count() != count:
        raise ValueError("the group has another size than the target")
    return dense_index(group, "id", "new_id").select(F.col("new_id").alias("id"), *[c for c in columns if c in group.columns])


def dense_index(rows: DataFrame, order: str, name: str, width: int = 65_536) -> DataFrame:
    """Add 0, 1, ... in the order of a whole-number column (rows without a value
    come first): a running number in each range of values, above the count of all
    ranges before."""
    bucketed = rows.withColumn("_bucket", F.coalesce(F.floor(F.col(order) / width), F.lit(NO_BUCKET)))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(order)) - 1
    return bucketed.withColumn("_own", own).join(before, "_bucket").withColumn(name, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_bucket", "_own", "_before")


def shift_velocity(particles: DataFrame, shift: Sequence[float], axes: Sequence[str], where: Column | None = None) -> DataFrame:
    return shift_rescale_velocity(particles, shift, 1.0, axes, where)


def rescale_velocity(particles: DataFrame, factor: float, axes: Sequence[str], where: Column | None = None) -> DataFrame:
    return shift_rescale_velocity(particles, [0.0] * len(axes), factor, axes, where)


def shift_rescale_velocity(particles: DataFrame, shift: Sequence[float], factor: float, axes: Sequence[str], where: Column | None = None) -> DataFrame:
    """v becomes (v + shift) * factor, for the group ``where`` holds."""
    new = {"v" + a: (F.col("v" + a) + s) * factor for a, s in zip(axes, shift)}
    return particles.withColumns(new if where is None else {n: F.when(where, c).otherwise(F.col(n)) for n, c in new.items()})
