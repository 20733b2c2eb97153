"""Wavevectors, density modes, structure factors and density profiles.

Wavevector tables are small (shells of a reciprocal grid); they are made on
Spark, checked in size, and broadcast to the particles, whose contributions are
summed in the tasks before any shuffle. Modes use exp(-i q.r).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from moraine.functions.box import Box, total
from moraine.functions.vectors import coprime, multi_range
from moraine.operators.statistics import error_of_mean

MAX_WAVEVECTORS = 1_000_000
ROWS, HELD = 512, 2_000_000  # particles at a time; sums of a task


def _checked_filter(filter_: Sequence[int] | None, box: Box) -> tuple[int, ...]:
    out = tuple(filter_ or (1,) * box.dimension)
    if len(out) != box.dimension or any(f not in (0, 1) for f in out):
        raise ValueError("filter values must be 0 or 1, one per axis")
    return out


def sparse_wavevectors(spark: SparkSession, box: Box, wavenumbers: Sequence[float], tolerance: float, max_count: int,
                       filter_: Sequence[int] | None = None) -> DataFrame:
    """(shell, wavenumber, q_id, qx..): for each wavenumber at most ``max_count``
    vectors along coprime non-negative Miller indices, small index sums first;
    wavenumbers without any are left out."""
    allowed = _checked_filter(filter_, box)
    unit = [2 * math.pi / n for n in box.lengths]
    top = [math.floor(max(wavenumbers) * (1 + tolerance) / u) * f for u, f in zip(unit, allowed)]
    rows = multi_range(spark, [0] * box.dimension, [t + 1 for t in top])
    index = [F.col(f"i{k}") for k in range(box.dimension)]
    rows = rows.where((total(index) > 0) & coprime(*index))
    norm = F.sqrt(total([(i * u) * (i * u) for i, u in zip(index, unit)]))
    waves = spark.createDataFrame([(k, float(q)) for k, q in enumerate(wavenumbers)], "place int, wavenumber double")
    rows = rows.withColumn("norm", norm).crossJoin(F.broadcast(waves))  # the given wavenumbers, a handful
    n = F.floor(F.col("wavenumber") / F.col("norm") + 0.5)
    rows = rows.withColumn("n", n).where((F.col("n") > 0) & (F.abs(F.col("n") * F.col("norm") - F.col("wavenumber")) <= F.col("wavenumber") * tolerance))
    # order by the sums of all, of all but the last, ... of the first index
    sums = [total(index[: k + 1]) for k in reversed(range(box.dimension))]
    rank = F.row_number().over(Window.partitionBy("place").orderBy(*sums))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= max_count)
    vectors = [(F.col("n") * i * u).alias("q" + a) for i, u, a in zip(index, unit, box.axes)]
    return _numbered(rows.select("place", "wavenumber", "rank", *vectors), box)


def dense_wavevectors(spark: SparkSession, box: Box, bounds: Sequence[float], filter_: Sequence[int] | None = None) -> DataFrame:
    """All reciprocal points of both signs below the largest bound, in half-open
    shells [previous, bound); bounds of empty shells are left out."""
    allowed = _checked_filter(filter_, box)
    unit, q_max = [2 * math.pi / n for n in box.lengths], max(bounds)
    top = [math.floor(q_max / u) * f for u, f in zip(unit, allowed)]
    if math.prod(2 * t + 1 for t in top) > MAX_WAVEVECTORS:
        raise ValueError("the grid of wavevectors is too large")
    rows = multi_range(spark, [-t for t in top], [t + 1 for t in top])
    vectors = [(F.col(f"i{k}") * u).alias("q" + a) for k, (u, a) in enumerate(zip(unit, box.axes))]
    rows = rows.select(*vectors).withColumn("qq", total([F.col("q" + a) * F.col("q" + a) for a in box.axes])).where(F.col("qq") < q_max * q_max)
    ordered = sorted(bounds)
    place = F.lit(0)
    for b in ordered[:-1]:
        place = place + F.when(F.col("qq") >= b * b, 1).otherwise(0)
    rows = rows.withColumn("place", place).withColumn("wavenumber", F.element_at(F.array(*[F.lit(float(b)) for b in ordered]), F.col("place") + 1))
    rank = F.row_number().over(Window.partitionBy("place").orderBy(*["q" + a for a in reversed(box.axes)]))
    return _numbered(rows.withColumn("rank", rank), box)


def _numbered(rows: DataFrame, box: Box) -> DataFrame:
    """Number shells and vectors; there are few, so one task may order them."""
    shell = F.dense_rank().over(Window.orderBy("place")) - 1
    q_id = F.row_number().over(Window.orderBy("place", "rank")) - 1
    return rows.select(shell.alias("shell"), "wavenumber", q_id.cast("bigint").alias("q_id"), *["q" + a for a in box.axes])


def powers(r: np.ndarray, length: float, top: int) -> np.ndarray:
    """exp(-2 pi i k r / length) for k = 0..top, one row for each k: each the one before times the first."""
    out = np.empty((top + 1, len(r)), complex)
    out[0] = 1
    if top:
        out[1] = np.exp(-2j * np.pi / length * r)
    for k in range(2, top + 1):  # doubling keeps errors small
        out[k] = out[k // 2] * out[k - k // 2]
    return out


def mode_sums(r: list[np.ndarray], lengths: Sequence[float], index: np.ndarray, block: int = 256) -> np.ndarray:
    """Sums over particles of exp(-i q.r) for wavevectors of whole ``index`` per axis: phases are products of the axes'
    powers, and all wavevectors that differ in the last axis alone are one product of matrices."""
    phases = [powers(x, n, int(np.abs(index[:, k]).max(initial=0))) for k, (x, n) in enumerate(zip(r, lengths))]

    def phase(k: int, i: np.ndarray) -> np.ndarray:
        return np.where((i < 0)[:, None], phases[k][np.abs(i)].conj(), phases[k][np.abs(i)])

    last = np.unique(index[:, -1])
    heads, which = np.unique(index[:, :-1], axis=0, return_inverse=True)
    which, place = which.reshape(-1), np.searchsorted(last, index[:, -1])
    ends, out = phase(len(r) - 1, last).T, np.empty(len(index), complex)
    order = np.argsort(which, kind="stable")
    for at in range(0, len(heads), block):
        part = np.ones((len(heads[at : at + block]), len(r[0])), complex)
        for k in range(len(r) - 1):
            part *= phase(k, heads[at : at + block, k])
        own = order[np.searchsorted(which[order], at) : np.searchsorted(which[order], at + block)]
        out[own] = (part @ ends)[which[own] - at, place[own]]
    return out


def density_modes(particles: DataFrame, wavevectors: DataFrame, box: Box, by: Sequence[str] = ()) -> DataFrame:
    """(step, by, q_id, re, im): sums over particles of exp(-i q.r), for wavevectors of the box's reciprocal lattice.

    No row is made for a particle and a wavevector: tasks take ``ROWS`` particles at a time, get all phases from
    powers along the axes and matrix products, and keep one array of sums per step; arrays are sent on as a
    task holds ``HELD`` numbers, and at its end. So what is shuffled is one row per task, step and wavevector."""
    keys = [*(["step"] if "step" in particles.columns else []), *by]
    if wavevectors.limit(MAX_WAVEVECTORS + 1).count() > MAX_WAVEVECTORS:
        raise ValueError("too many wavevectors")
    known = wavevectors.select("q_id", *["q" + a for a in box.axes]).toPandas()  # of checked size
    unit = [2 * math.pi / n for n in box.lengths]
    raw = np.stack([known["q" + a].to_numpy(float) / u for a, u in zip(box.axes, unit)], 1).reshape(len(known), box.dimension)
    index = np.rint(raw).astype(np.int64)
    if len(raw) and np.abs(raw - index).max() > 1e-6:
        raise ValueError("wavevectors must be multiples of 2 pi / length along each axis")
    model = particles.sparkSession.sparkContext.broadcast((known["q_id"].to_numpy(np.int64), index))
    lengths, n = box.lengths, len(keys)
    rows = particles.select(*keys, *[F.col(a).cast("double").alias(a) for a in box.axes]).dropna(subset=list(box.axes))
    schema = StructType([*rows.schema.fields[:n], StructField("q_id", LongType()), StructField("re", DoubleType()), StructField("im", DoubleType())])

    def run(batches):
        q_id, index = model.value
        sums: dict[tuple, np.ndarray] = {}
        types = []

        def emit():
            for key, s in sums.items():
                own = [pa.array([v] * len(s), t) for v, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(q_id), pa.array(s.real.copy()), pa.array(s.imag.copy())], schema.names)
            sums.clear()

        for batch in batches:
            types = [batch.column(k).type for k in range(n)]
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys_ = list(zip(*[part.column(k).to_pylist() for k in range(n)])) if n else [()] * part.num_rows
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(keys_):
                    groups.setdefault(key, []).append(i)
                r = [part.column(n + k).to_numpy(zero_copy_only=False) for k in range(len(lengths))]
                for key, own in groups.items():
                    s = mode_sums([x[own] for x in r], lengths, index)
                    sums[key] = sums[key] + s if key in sums else s
                    if len(sums) * len(q_id) > HELD:
                        yield from emit()
        yield from emit()

    return rows.mapInArrow(run, schema).groupBy(*keys, "q_id").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def structure_factor(modes: DataFrame, wavevectors: DataFrame, norm: float, other: DataFrame | None = None) -> DataFrame:
    """(step, shell, wavenumber, value, error, count): the mean of
    Re[rho1 rho2*] / norm over the shell; the error of a single vector is 0."""
    keys = [c for c in ("step",) if c in modes.columns]
    second = (modes if other is None else other).select(*keys, "q_id", F.col("re").alias("re2"), F.col("im").alias("im2"))
    value = (F.col("re") * F.col("re2") + F.col("im") * F.col("im2")) / norm
    rows = modes.join(second, [*keys, "q_id"]).join(wavevectors.select("q_id", "shell", "wavenumber"), "q_id").withColumn("_v", value)
    return rows.groupBy(*keys, "shell", "wavenumber").agg(F.avg("_v").alias("value"), F.coalesce(error_of_mean("_v"), F.lit(0.0)).alias("error"), F.count("*").alias("count"))


def density_profile(modes: DataFrame, wavevectors: DataFrame, box: Box, axis: str, points: int, sigma: float = 0.0, bulk: float = 0.2) -> DataFrame:
    """(position, density): the inverse transform of the modes along one axis,
    averaged over steps, smoothed by a Gaussian and divided by the mean over the
    central part ``bulk`` of the box. Wavevectors: dense, other axes filtered."""
    length = box.lengths[box.axes.index(axis)]
    mean = modes.groupBy("q_id").agg(F.avg("re").alias("re"), F.avg("im").alias("im")).join(wavevectors.select("q_id", F.col("q" + axis).alias("q")), "q_id")
    grid = modes.sparkSession.range(points).select(((F.col("id") + 0.5) * (length / points) - length / 2).alias("position"))
    phase = F.col("q") * F.col("position")
    wave = F.exp(-sigma * sigma * F.col("q") * F.col("q") / 2) * (F.col("re") * F.cos(phase) - F.col("im") * F.sin(phase))
    rows = mean.crossJoin(F.broadcast(grid)).groupBy("position").agg((F.sum(wave) / box.volume).alias("raw"))  # points x wavevectors of one axis
    level = rows.where(F.abs(F.col("position")) <= bulk * length / 2).agg(F.avg("raw").alias("level"))
    return rows.crossJoin(F.broadcast(level)).select("position", F.try_divide("raw", "level").alias("density"))
