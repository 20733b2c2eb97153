"""Sums over all pairs of a step, without a cutoff, of springs: no pair is made.

The minimum image of a difference of two coordinates depends on one axis alone: it is the difference, a length less for
what lies more than half a length below, a length more for what lies more than half above. So the sums of it and of its
square over all other rows follow from counts and sums of the coordinates up to two borders. Coordinates are cut
into sorted ranges, borders are looked up in the range in which they fall, and what lies in the ranges before is added.
The work is that of a few shuffles of the rows, and a range holds about ``SPAN`` rows at most, equal coordinates being one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import inf, nan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from moraine.functions.box import Box, total
from moraine.sources.scratch import written

SPAN = 32_768  # rows between two bounds of ranges, about
MOST_BROADCAST = 500_000
VALUE, BELOW, ABOVE, START = range(4)
KINDS = ("finite", "high", "low", "none")  # coordinates: finite, inf, -inf, nan


def _leading(ascending: Column, passes: Callable[[Column], Column], most: int) -> Column:
    """How many elements of an ascending array pass a test that all before some place pass and none after it; by halves."""

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["low"] + s["high"], 1)
        upper, lower = F.struct((mid + 1).alias("low"), s["high"].alias("high")), F.struct(s["low"].alias("low"), mid.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(passes(F.get(ascending, mid)), upper).otherwise(lower)

    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high")), halved)["low"]


def _places(ascending: np.ndarray, x: np.ndarray, passes: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The same for each ``x``, of the differences from it: they are compared as they are rounded."""
    low, high = np.zeros(len(x), int), np.full(len(x), len(ascending))
    while (left := low < high).any():
        mid = (low + high) // 2
        ok = passes(x - ascending[np.minimum(mid, len(ascending) - 1)])
        low, high = np.where(left & ok, mid + 1, low), np.where(left & ~ok, mid, high)
    return low


def _axes(long: DataFrame, keys: list[str], halves: Column, cuts: int) -> DataFrame:
    """A row for each step and axis: how many coordinates of each kind there are, also of rows without a null one, a finite
    coordinate in their middle and the bounds of ranges, at most one for ``SPAN / 3`` rows."""
    part = F.percentile_approx(F.when(F.col("kind") == KINDS[0], F.col("v")), [0.5, *[k / cuts for k in range(1, cuts)]], max(10_000, 8 * cuts))
    counts = [F.count_if((F.col("kind") == k) & w).alias(n + k) for n, w in (("n_", F.lit(True)), ("m_", F.col("whole"))) for k in KINDS]
    found = long.groupBy(*keys, "axis").agg(F.count("*").alias("rows"), *counts, part.alias("at"))
    cut, half = F.slice("at", 2, cuts), halves[F.col("axis")]
    bounds = F.array_sort(F.array_distinct(F.concat(cut, F.transform(cut, lambda b: b - half), F.transform(cut, lambda b: b + half))))
    found = written(found.withColumns({"mid": F.get("at", F.lit(0)), "bounds": F.coalesce(bounds, F.array().cast("array<double>"))}).drop("at"))
    return F.broadcast(found) if found.count() <= MOST_BROADCAST else found


def _sums(long: DataFrame, keys: list[str], box: Box) -> tuple[DataFrame, DataFrame]:
    """For each finite coordinate ``v`` of an axis the sum ``d`` of the minimum images of its differences from all finite ones
    of its step, and the sum ``dd`` of their squares over rows without a null coordinate; and the table of :func:`_axes`."""
    lengths, halves = list(box.lengths), F.array(*[F.lit(n / 2) for n in box.lengths])
    own = [*keys, "axis"]
    most = long.groupBy(*own).count().agg(F.max("count")).first()[0] or 0
    cuts = -(-most // SPAN) or 1
    axes = _axes(long, keys, halves, cuts)
    values = long.where(F.col("kind") == KINDS[0]).groupBy(*own, "v").agg(F.count("*").alias("n"), F.count_if("whole").alias("m"))
    values, half = values.join(axes.select(*own, "mid", "bounds"), own), halves[F.col("axis")]
    tests = {VALUE: lambda b: b <= F.col("v"), BELOW: lambda b: F.col("v") - b > half, ABOVE: lambda b: F.col("v") - b >= -half}
    places = F.array(*[F.struct(F.lit(k).alias("what"), _leading(F.col("bounds"), t, 3 * cuts).alias("range")) for k, t in tests.items()])
    met = written(values.select(*own, "v", "mid", F.col("n").cast("double").alias("n"), F.col("m").cast("double").alias("m"), F.explode(places).alias("_p")).select(*own, "_p.*", "v", "mid", "n", "m"))
    # what the ranges before add up to, one row for a range, and what all do
    w, here = F.col("v") - F.col("mid"), F.col("what") == VALUE
    terms = {"n": F.col("n"), "s": F.col("n") * w, "m": F.col("m"), "t": F.col("m") * w, "q": F.col("m") * w * w}
    ranges = met.groupBy(*own, "range").agg(F.first("mid").alias("mid"), *[F.sum(F.when(here, c).otherwise(0.0)).alias(n) for n, c in terms.items()])
    before, every = Window.partitionBy(*own).orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*own)
    known = [F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c + "_before") for c in ("n", "m", "t")] + [F.sum(c).over(every).alias(c + "_all") for c in terms]
    starts = ranges.select(*own, "range", F.lit(START).alias("what"), F.struct("mid", *known).alias("start"))
    kinds = [*[long.schema[k] for k in keys], T.StructField("axis", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("v", "d", "dd")]]
    schema = T.StructType(kinds)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        what, v, n, m = (rows[c].to_numpy() for c in ("what", "v", "n", "m"))
        start, key = rows["start"][int(np.argmax(what == START))].as_py(), [rows[k][0] for k in own]
        length = lengths[key[-1].as_py()]
        order = np.flatnonzero(what == VALUE)
        order = order[np.argsort(v[order])]
        v_up = v[order]
        upto = [np.concatenate([[0.0], np.cumsum(c)]) + start[s + "_before"] for s, c in (("n", n[order]), ("m", m[order]), ("t", m[order] * (v_up - start["mid"])))]
        for k, passes in ((BELOW, lambda d: d > length / 2), (ABOVE, lambda d: d >= -length / 2)):
            x = v[what == k]
            if not len(x):
                continue
            n_k, m_k, t_k = (c[_places(v_up, x, passes)] for c in upto)
            w = x - start["mid"]
            d, dd = -length * n_k, -2 * length * (w * m_k - t_k) + (length**2 if k == BELOW else -(length**2)) * m_k
            if k == BELOW:  # with all rows as if they were above
                far = w + length
                d += start["n_all"] * far - start["s_all"]
                dd += start["m_all"] * far * far - 2 * far * start["t_all"] + start["q_all"]
            yield pa.RecordBatch.from_arrays([*[pa.repeat(c, len(x)) for c in key], *[pa.array(c) for c in (x, d, dd)]], names=schema.names)

    found = met.drop("mid").unionByName(starts, allowMissingColumns=True).groupBy(*own, "range").applyInArrow(summed, schema)
    return found.groupBy(*own, "v").agg(F.sum("d").alias("d"), F.sum("dd").alias("dd")), axes


def spring_forces(particles: DataFrame, box: Box, stiffness: float) -> DataFrame:
    """(id, fx.., en_pot) of springs between all pairs of different ids of a step, as ``pair_forces`` has them from all
    pairs: null coordinates have no part in a force, rows with one none in an energy, and others that are not finite count as in any sum."""
    keys = ["step"] if "step" in particles.columns else []
    each = [*keys, "id", "axis"]
    rows = written(particles.dropna(subset=[*keys, "id"]).select(*keys, "id", *box.axes))
    v, whole = F.col("v"), F.lit(True)
    for a in box.axes:
        whole = whole & F.col(a).isNotNull()
    kind = F.when(v.isNull(), None).when(F.isnan(v), KINDS[3]).when(v == inf, KINDS[1]).when(v == -inf, KINDS[2]).otherwise(KINDS[0])
    long = rows.select(*keys, "id", whole.alias("whole"), F.posexplode(F.array(*[F.col(a).cast("double") for a in box.axes])).alias("axis", "v")).withColumn("kind", kind)
    sums, axes = _sums(long, keys, box)
    met = long.join(sums, [*keys, "axis", "v"], "left")
    several = written(rows.groupBy(*keys, "id").count().where("count > 1").select(*keys, "id"))
    if not several.isEmpty():  # rows of one id have no part in each other's energy
        own = long.join(several, [*keys, "id"])
        own = _sums(own, [*keys, "id"], box)[0].select(*each, "v", F.col("dd").alias("_own"))
        met = met.join(own, [*each, "v"], "left").withColumn("dd", F.col("dd") - F.coalesce("_own", F.lit(0.0)))
    counts = [F.count_if((F.col("kind") == k) & w).alias("own_" + n + k) for n, w in (("n_", F.lit(True)), ("m_", F.col("whole"))) for k in KINDS]
    met = met.repartition(*keys, "id").groupBy(*each).agg(F.count("*").alias("own_rows"), *counts, F.sum("d").alias("d"), F.sum(F.when(F.col("whole"), F.col("dd"))).alias("dd"))
    met = met.join(axes.drop("mid", "bounds"), [*keys, "axis"]).where(F.col("own_rows") < F.col("rows"))

    def summed(name: str, n: str, finite: str, signed: bool) -> Column:
        """The sum over pairs of the row's coordinates with those of other ids."""
        ours = {k: F.col(f"own_{n}{k}") for k in KINDS}
        others = {k: F.col(n + k) - ours[k] for k in KINDS}
        one, two = total(list(ours.values())), total(list(others.values()))
        pairs = {(a, b): (ours[a] > 0) & (others[b] > 0) for a in KINDS[:3] for b in KINDS[:3]}
        up = pairs["high", "finite"] | pairs["high", "low"] | pairs["finite", "low"]
        down = pairs["finite", "high"] | pairs["low", "high"] | pairs["low", "finite"]
        never = pairs["high", "high"] | pairs["low", "low"] | ((ours["none"] > 0) & (two > 0)) | ((others["none"] > 0) & (one > 0))
        parts = [(up, inf), (down, -inf if signed else inf), (never, nan)]
        return F.when((one > 0) & (two > 0), total([F.coalesce(finite, F.lit(0.0)), *[F.when(c, x).otherwise(0.0) for c, x in parts]])).alias(name)

    met = met.select(*each, summed("d", "n_", "d", True), summed("dd", "m_", "dd", False))
    force = [(-stiffness * F.sum(F.when(F.col("axis") == k, F.col("d")))).alias("f" + a) for k, a in enumerate(box.axes)]
    return met.groupBy(*keys, "id").agg(*force, (stiffness / 4 * F.sum("dd")).alias("en_pot"))
