"""Time-correlation functions over a multi-level grid of lags.

Samples are cut into ranges of steps with a halo of the next samples, so that every
pair of a level lies in one range; pairs are made and added up where the range is: one
shuffle of the samples and one of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.functions.box import square, total
from moraine.operators.sorting import exclusive_scan
from moraine.operators.statistics import error_of_mean


RANGE = 4_096  # samples of a level in a range


@dataclass(frozen=True)
class BlockingScheme:
    """Levels of ``size`` lags; steps count in units of the time step."""

    timestep: float
    max_lag: float
    every: int = 1
    size: int = 10
    shift: int | None = None
    separation: int | None = None

    def __post_init__(self):
        shift = isqrt(self.size) if self.shift is None else self.shift
        if self.size < 2:
            raise ValueError("a block has at least two lags")
        if not 0 < shift < self.size:
            raise ValueError("the shift must be positive and below the block size")
        if self.every < 1 or self.timestep <= 0:
            raise ValueError("the resolution must be positive")
        if not self.levels():
            raise ValueError("the largest lag leaves no level")

    def levels(self) -> list[tuple[int, int]]:
        """(interval, origins' distance in intervals) of each level, in steps."""
        shift = isqrt(self.size) if self.shift is None else self.shift
        separation = self.size if self.separation is None else self.separation
        steps, most, intervals = self.every, round(self.max_lag / self.timestep), []
        while steps <= most:
            intervals.append(steps)
            if shift > 1 and steps * shift <= most:
                intervals.append(steps * shift)
            steps *= self.size
        return [(i, max(ceil(separation / i), 1)) for i in intervals]

    def lags(self, spark: SparkSession) -> DataFrame:
        """(level, interval, skip, lag_idx, lag, lag_time)."""
        rows = [(k, i, s) for k, (i, s) in enumerate(self.levels())]
        table = spark.createDataFrame(rows, "level int, interval long, skip long")
        table = table.withColumn("lag_idx", F.explode(F.sequence(F.lit(0), F.lit(self.size - 1))))
        return table.withColumn("lag", F.col("interval") * F.col("lag_idx")).withColumn("lag_time", F.col("lag") * F.lit(float(self.timestep)))


def lagged_pairs(samples: DataFrame, scheme: BlockingScheme, keys: Sequence[str], start: int = 0, other: DataFrame | None = None) -> DataFrame:
    """All pairs of samples that the scheme correlates: columns of the origin as
    ``_1``, of the later sample (of ``other``, if given) as ``_2``, level,
    lag_idx, lag_time and the later one's step. A sample is a row with ``step`` and ``keys``, of which there is
    one for a key and step; rows without a key or step have no pairs.

    A level takes the samples on its raster of steps, in ranges of ``RANGE`` of them; the first ``size - 1``
    samples of a range are also sent to the range before, as later ones only. Within a range each lag is a
    window frame of one step. So samples are shuffled once per level that they lie on (levels get sparser), never
    origins times lags, and a long series is many ranges."""
    values = [c for c in samples.columns if c not in (*keys, "step")]
    both = samples.select(*keys, "step", F.struct(*values).alias("_a"), F.struct(*values).alias("_b"))
    if other is not None:
        later = [c for c in other.columns if c not in (*keys, "step")]
        b = other.select(*keys, "step", F.struct(*later).alias("_b"))
        both = both.drop("_b").unionByName(b, allowMissingColumns=True)
    else:
        later = values
    # the levels are few and known here: a sample goes to those on whose raster of steps it lies
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(i).cast("long").alias("interval"), F.lit(s).cast("long").alias("skip")) for k, (i, s) in enumerate(scheme.levels())])
    own = F.filter(levels, lambda v: (F.col("step") - start) % v["interval"] == 0)
    rows = both.dropna(subset=[*keys, "step"]).where(F.col("step") >= start).withColumn("_level", F.explode(own))
    rows = rows.withColumn("_u", ((F.col("step") - start) / F.col("_level.interval")).cast("long"))
    width = max(RANGE, scheme.size)
    home = F.floor(F.col("_u") / width)
    halo = (F.col("_u") % width < scheme.size - 1) & (home > 0)
    rows = rows.withColumn("_range", F.explode(F.when(halo, F.array(home, home - 1)).otherwise(F.array(home))))
    origin = (F.col("_range") == home) & (F.col("_u") % F.col("_level.skip") == 0)
    rows = rows.withColumn("_a", F.when(origin, F.col("_a")))
    w = Window.partitionBy(*keys, "_level", "_range").orderBy("_u")
    after = F.array(*[F.first("_b", True).over(w.rangeBetween(k, k)) for k in range(scheme.size)])
    rows = rows.withColumn("_after", after).where(F.col("_a").isNotNull())
    rows = rows.select(*keys, "step", "_level", "_a", F.posexplode("_after").alias("lag_idx", "_b")).where(F.col("_b").isNotNull())
    lag = F.col("_level.interval") * F.col("lag_idx")
    return rows.select(*keys, F.col("_level.level").alias("level"), "lag_idx", (lag * F.lit(float(scheme.timestep))).alias("lag_time"), (F.col("step") + lag).alias("step"),
                       *[F.col("_a")[v].alias(v + "_1") for v in values], *[F.col("_b")[v].alias(v + "_2") for v in later])


def correlate(samples: DataFrame, scheme: BlockingScheme, function: Callable[..., Column], keys: Sequence[str] = (), by: Sequence[str] = (),
              start: int = 0, other: DataFrame | None = None) -> DataFrame:
    """(by, level, lag_idx, lag_time, value, error, count) of a user's function of
    two columns structs (origin, later). A function that gives an array makes one
    row per element, with its ``index``."""
    pairs = lagged_pairs(samples, scheme, keys, start, other)

    def side(k: str) -> Column:
        own = [c for c in pairs.columns if c.endswith("_" + k)]
        return F.struct(*[F.col(c).alias(c[:-2]) for c in own])

    rows = pairs.select(*by, "level", "lag_idx", "lag_time", function(side("1"), side("2")).alias("_v"))
    group = [*by, "level", "lag_idx", "lag_time"]
    if dict(rows.dtypes)["_v"].startswith("array"):
        rows, group = rows.select(*group, F.posexplode("_v").alias("index", "_v")), [*group, "index"]
    return rows.groupBy(*group).agg(F.avg("_v").alias("value"), error_of_mean("_v").alias("error"), F.count("_v").alias("count"))


def _dot(a: Column, b: Column, names: Sequence[str]) -> Column:
    return total([a[n] * b[n] for n in names])


def _moved(a: Column, b: Column, axes: Sequence[str]) -> Column:
    return total([square(b[x] - a[x]) for x in axes])


def mean_square_displacement(positions: DataFrame, scheme: BlockingScheme, axes: Sequence[str] = ("x", "y", "z"), **options) -> DataFrame:
    """Of unwrapped positions (step, id, x..)."""
    return correlate(positions.select("step", "id", *axes), scheme, lambda a, b: _moved(a, b, axes), ["id"], **options)


def mean_quartic_displacement(positions: DataFrame, scheme: BlockingScheme, axes: Sequence[str] = ("x", "y", "z"), **options) -> DataFrame:
    return correlate(positions.select("step", "id", *axes), scheme, lambda a, b: square(_moved(a, b, axes)), ["id"], **options)


def velocity_autocorrelation(velocities: DataFrame, scheme: BlockingScheme, axes: Sequence[str] = ("vx", "vy", "vz"), **options) -> DataFrame:
    return correlate(velocities.select("step", "id", *axes), scheme, lambda a, b: _dot(a, b, axes), ["id"], **options)


def intermediate_scattering(modes: DataFrame, wavevectors: DataFrame, scheme: BlockingScheme, norm: float, other: DataFrame | None = None, **options) -> DataFrame:
    """Per shell: the mean of Re[rho(t1) rho*(t2)] / norm over its wavevectors
    and the origins."""
    shells = wavevectors.select("q_id", "shell", "wavenumber")
    keep = ["step", "q_id", "shell", "wavenumber", "re", "im"]
    first = modes.join(shells, "q_id").select(keep)
    second = None if other is None else other.join(shells, "q_id").select(keep)
    return correlate(first, scheme, lambda a, b: _dot(a, b, ["re", "im"]) / norm, ["q_id", "shell", "wavenumber"], ["shell", "wavenumber"], other=second, **options)


def stress_autocorrelation(stress: DataFrame, scheme: BlockingScheme, particles: int, names: Sequence[str] = ("xy", "xz", "yz"), **options) -> DataFrame:
    """Of the off-diagonal stress series (step, xy..)."""
    return correlate(stress.select("step", *names), scheme, lambda a, b: _dot(a, b, names) / particles, **options)


def helfand_moment(stress: DataFrame, scheme: BlockingScheme, particles: int, names: Sequence[str] = ("xy", "xz", "yz"), interval: int = 1, **options) -> DataFrame:
    """Mean squared growth of the running sums of the off-diagonal stress."""
    sums = stress.where(F.col("step") % interval == 0).select("step", *names)
    for n in names:
        sums = exclusive_scan(sums, n, "step").withColumn(n, F.col(n) + F.col("scan")).drop("scan")
    width = interval * scheme.timestep
    return correlate(sums, scheme, lambda a, b: total([square((b[n] - a[n]) * width) for n in names]) / particles, **options)


def diffusion_constant(msd: DataFrame, dimension: int, min_time: float = 0.0) -> DataFrame:
    """D of the line MSD = 2 d D t through the origin, by least squares with the
    inverse squared errors as weights, and its error."""
    w = 1 / square(F.col("error"))
    rows = msd.where((F.col("lag_time") > min_time) & (F.col("lag_time") > 0) & (F.col("error") > 0))
    tt = F.sum(w * square(F.col("lag_time")))
    return rows.agg(F.try_divide(F.sum(w * F.col("lag_time") * F.col("value")), 2 * dimension * tt).alias("diffusion"), (F.sqrt(F.try_divide(F.lit(1.0), tt)) / (2 * dimension)).alias("error"))


def by_time(result: DataFrame) -> DataFrame:
    """All levels as one series; lags that two levels share stay twice."""
    return result.orderBy("lag_time", "level")


def green_kubo(correlation: DataFrame, prefactor: float) -> DataFrame:
    """(lag_time, integral): the running trapezoid integral over all lags, a
    small series, equal lags averaged first."""
    merged = correlation.groupBy("lag_time").agg(F.avg("value").alias("value"))
    w = Window.orderBy("lag_time")
    part = (F.col("lag_time") - F.lag("lag_time").over(w)) * (F.col("value") + F.lag("value").over(w)) / 2
    steps = merged.withColumn("_part", F.coalesce(part, F.lit(0.0)))
    return steps.select("lag_time", (prefactor * F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("integral"))


def helfand_slope(moment: DataFrame, prefactor: float, min_time: float = 0.0) -> DataFrame:
    """prefactor times half the slope of the moment over time."""
    rows = moment.where((F.col("lag_time") > min_time) & (F.col("lag_time") > 0))
    return rows.agg((prefactor * F.try_divide(F.sum(F.col("lag_time") * F.col("value")), 2 * F.sum(square(F.col("lag_time"))))).alias("value"))
