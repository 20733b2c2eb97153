"""Mergeable statistics with standard errors, running, blocked and derived."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.operators.groups import NO_BUCKET


def error_of_mean(x: Column | str) -> Column:
    """sqrt(population variance / (n - 1)); null for fewer than two values."""
    n = F.count(x)
    return F.when(n > 1, F.stddev_pop(x) / F.sqrt(n - F.lit(1.0)))


def moments(x: Column | str, prefix: str = "") -> list[Column]:
    """Aggregates count, sum, mean, variance, sigma and error of a value."""
    return [
        F.count(x).alias(prefix + "count"), F.sum(x).alias(prefix + "sum"), F.avg(x).alias(prefix + "mean"),
        F.var_pop(x).alias(prefix + "variance"), F.stddev_pop(x).alias(prefix + "sigma"), error_of_mean(x).alias(prefix + "error"),
    ]


def accumulate(rows: DataFrame, value: Column | str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*moments(value))


def accumulate_vector(rows: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Element-wise statistics of several columns, in one pass."""
    return rows.groupBy(*by).agg(*[c for v in values for c in moments(v, v + "_")])


def merge(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge partial statistics (count, mean, variance): the exact result of
    accumulating all their values, parts without values ignored."""
    parts = parts.where("count > 0")
    n = F.sum("count")
    # about a shift near the means, so that large means do not cancel
    shift = parts.groupBy(*by).agg(F.avg("mean").alias("_shift"))
    shifted = parts.join(shift, list(by)) if by else parts.crossJoin(F.broadcast(shift))  # a single row
    d = F.col("mean") - F.col("_shift")
    own = F.sum(F.col("count") * d) / n
    second = F.sum(F.col("count") * (F.col("variance") + d * d)) / n
    out = shifted.groupBy(*by).agg(n.alias("count"), (F.first("_shift") + own).alias("mean"), F.greatest(second - own * own, F.lit(0.0)).alias("variance"))
    error = F.when(F.col("count") > 1, F.sqrt(F.col("variance") / (F.col("count") - 1)))
    return out.withColumns({"sum": F.col("mean") * F.col("count"), "sigma": F.sqrt("variance"), "error": error})


def running(series: DataFrame, value: str, keys: Sequence[str], width: int = 65_536) -> DataFrame:
    """Statistics of all samples up to each step, without reset, per key: those
    of ranges of ``width`` steps, merged with what all ranges before add up to, so
    that a long series is never one task's. Values are taken about the key's mean, so
    that large means don't cancel. Rows without a step come first; steps of a
    key are distinct."""
    own = [*keys, "_bucket"]
    rows = series.withColumn("_bucket", F.coalesce(F.floor(F.col("step") / width), F.lit(NO_BUCKET)))
    ranges = rows.groupBy(*own).agg(F.count(value).alias("_c"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    whole = Window.partitionBy(*keys)
    shift = F.sum(F.col("_c") * F.col("_m")).over(whole) / F.sum("_c").over(whole)
    ranges = ranges.withColumn("_shift", F.coalesce(shift, F.lit(0.0))).withColumn("_d", F.col("_m") - F.col("_shift"))
    ranges = ranges.select(
        *own, "_shift", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_n0"), F.coalesce(F.sum(F.col("_c") * F.col("_d")).over(upto), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum(F.col("_c") * (F.col("_v") + F.col("_d") * F.col("_d"))).over(upto), F.lit(0.0)).alias("_q0"),
    )
    w = Window.partitionBy(*own).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n1": F.count(value).over(w), "_m1": F.avg(value).over(w), "_v1": F.var_pop(value).over(w)}).join(ranges, own)
    n, d = F.col("_n0") + F.col("_n1"), F.coalesce(F.col("_m1") - F.col("_shift"), F.lit(0.0))
    first = F.col("_n0") == 0  # nothing to merge: the range's own values
    mean = F.when(first, F.col("_m1")).otherwise(F.col("_shift") + (F.col("_s0") + F.col("_n1") * d) / n)
    about = mean - F.col("_shift")
    merged = (F.col("_q0") + F.col("_n1") * (F.coalesce("_v1", F.lit(0.0)) + d * d)) / n - about * about
    variance = F.when(first, F.col("_v1")).otherwise(F.greatest(merged, F.lit(0.0)))
    error = F.when(n > 1, F.sqrt(variance / (n - F.lit(1.0))))
    return rows.select(*series.columns, n.alias("count"), mean.alias("mean"), variance.alias("variance"), error.alias("error"))


def windowed(series: DataFrame, value: str, every: int, by: Sequence[str] = (), start: int = 0) -> DataFrame:
    """Statistics reset after every ``every`` steps: tumbling windows, named by
    their first step."""
    if every < 1:
        raise ValueError("every must be positive")
    first = (F.floor((F.col("step") - start) / every) * every + start).cast("bigint")
    return series.where(F.col("step") >= start).withColumn("window", first).groupBy(*by, "window").agg(*moments(value))


def block_average(series: DataFrame, value: str, blocks: int, by: Sequence[str] = ()) -> DataFrame:
    """The mean over equal blocks of consecutive samples and its error from the
    spread of block means; samples beyond the last whole block are dropped. Needs
    dense steps from the first on."""
    if blocks < 2:
        raise ValueError("block averages need at least two blocks")
    spans = series.groupBy(*by).agg(F.min("step").alias("_first"), F.floor((F.max("step") - F.min("step") + 1) / blocks).alias("_length"))
    rows = series.join(spans, list(by)) if by else series.crossJoin(F.broadcast(spans))  # a single row
    rows = rows.where(F.col("_length") > 0).withColumn("_block", F.floor((F.col("step") - F.col("_first")) / F.col("_length"))).where(F.col("_block") < blocks)
    means = rows.groupBy(*by, "_block").agg(F.avg(value).alias("_mean"))
    return means.groupBy(*by).agg(F.count("*").alias("count"), F.avg("_mean").alias("mean"), error_of_mean("_mean").alias("error"))


def heat_capacity_nve(temperature: Column | str, particles: int) -> Column:
    """Per particle, from the fluctuations of the temperature."""
    t = F.avg(temperature)
    return 1 / (2 / 3 - particles * F.var_pop(temperature) / (t * t))


def heat_capacity_nvt(potential: Column | str, kinetic: Column | str, temperature: float, particles: int) -> Column:
    return particles * (F.var_pop(potential) + F.var_pop(kinetic)) / temperature**2


def long_range_corrections(density: float | Column, cutoff: float | Column, dimension: int = 3) -> tuple:
    """Energy per particle and pressure of a Lennard-Jones fluid beyond the
    cutoff, for a uniform tail, in reduced units; of numbers or columns."""
    c6 = cutoff**-6
    if dimension == 3:
        return 8 / 9 * math.pi * density * (c6 - 3) * cutoff**-3, 32 / 9 * math.pi * density**2 * (c6 - 1.5) * cutoff**-3
    return 2 / 5 * math.pi * density * (c6 - 2.5) * cutoff**-4, 12 / 5 * math.pi * density**2 * (c6 - 1.25) * cutoff**-4
