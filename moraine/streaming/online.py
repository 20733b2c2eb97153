"""Online statistics and correlations of step series, as structured streams.

The correlator is a keyed state machine: for every series each level keeps its
open origins and what they have to meet, so the state is bounded by the block
size, never by the stream. Steps of a series must come in increasing order;
late ones are an error, as in a store. Every pair is told of as its later sample arrives, so what
partly filled blocks hold at the end of a stream is in the results already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moraine.operators.correlation import BlockingScheme
from moraine.operators.statistics import merge, moments
from moraine.sources.scratch import delete, names, publish

Hook = Callable[[DataFrame, int], None]


def with_hooks(*hooks: Hook) -> Hook:
    """A foreachBatch function that calls several hooks on a cached batch."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for h in hooks:
                h(batch, number)
        finally:
            batch.unpersist()

    return run


def windowed_stream(stream: DataFrame, value: str, every: int, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of tumbling windows of ``every`` steps; use complete or update
    mode, or a watermark on an event-time column for append mode."""
    window = (F.floor(F.col("step") / every) * every).cast("bigint").alias("window")
    return stream.groupBy(*by, window).agg(*moments(value))


def write_windows(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Start a query that writes every micro-batch's changed windows to a folder
    of its own under ``path``, by the executors; a batch that is run again
    replaces its folder. :func:`latest_windows` reads what holds, :func:`compact_windows` keeps the folders few."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).start()


def _window_batches(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The last batch that :func:`compact_windows` has folded in (-1: none), and the batches after it."""
    found = names(spark, path)
    upto = max([int(n[5:]) for n in found if n.startswith("upto=")], default=-1)
    return upto, sorted(k for n in found if n.startswith("batch=") and (k := int(n[6:])) > upto)


def _last_states(spark: SparkSession, folders: list[str], schema: str, keys: Sequence[str]) -> DataFrame:
    batch = F.regexp_extract("_metadata.file_path", r"/(?:batch|upto)=(\d+)/[^/]*$", 1).cast("bigint")
    rows = spark.read.schema(schema).parquet(*folders).withColumn("_batch", batch)
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


def latest_windows(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ("window",)) -> DataFrame:
    """The last state of each window that :func:`write_windows` has written."""
    upto, batches = _window_batches(spark, path)
    folders = [*([f"{path}/upto={upto}"] if upto >= 0 else []), *(f"{path}/batch={k}" for k in batches)]
    return _last_states(spark, folders, schema, keys) if folders else spark.createDataFrame([], schema)


def compact_windows(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ("window",)) -> None:
    """Fold all batches but the last one, which the stream may write again, into one folder that is published as a whole, and
    delete them. What :func:`latest_windows` reads is the same before, after and in between; one compaction runs at a time."""
    upto, batches = _window_batches(spark, path)
    if len(batches) < 2:
        return
    last = batches[-2]
    folders = [*([f"{path}/upto={upto}"] if upto >= 0 else []), *(f"{path}/batch={k}" for k in batches[:-1])]
    new = f"{path}/_new-{last}"
    _last_states(spark, folders, schema, keys).write.mode("overwrite").parquet(new)
    if publish(spark, new, f"{path}/upto={last}"):
        for f in folders:
            delete(spark, f)


class OnlineCorrelator:
    """Open origins of one series and what a stretch of it adds to (level, lag).
    Whole stretches are worked on as arrays."""

    def __init__(self, scheme: BlockingScheme):
        self.levels, self.size = scheme.levels(), scheme.size
        self.open: list[tuple[np.ndarray, list[np.ndarray]] | None] = [None for _ in self.levels]
        self.last: int | None = None

    def opened(self) -> Iterable[tuple[int, int, list[float]]]:
        """(level, step, values) of all open origins."""
        for k, held in enumerate(self.open):
            if held is not None:
                for i, step in enumerate(held[0].tolist()):
                    yield k, step, [float(v[i]) for v in held[1]]

    def resume(self, last: int, origins: Sequence[tuple[int, int, Sequence[float]]]) -> None:
        """Go on behind the step ``last`` with the open origins of :meth:`opened`."""
        self.last = last
        for k in range(len(self.levels)):
            own = sorted((step, values) for level, step, values in origins if level == k)
            if own:
                self.open[k] = np.array([s for s, _ in own], np.int64), [np.array(v, float) for v in zip(*(v for _, v in own))]

    def add(self, steps: np.ndarray, samples: Sequence[np.ndarray], function: Callable[[tuple, tuple], np.ndarray]) -> Iterable[tuple[int, int, np.ndarray]]:
        """(level, lag, values) of all pairs whose later sample is one of these;
        ``function`` gets tuples of arrays, one for each value of a sample."""
        if len(steps) and (self.last is not None and steps[0] <= self.last or (np.diff(steps) <= 0).any()):
            raise ValueError(f"steps from {steps[0]} on do not grow, or come after step {self.last}")
        if not len(steps):
            return
        self.last = int(steps[-1])
        for k, (interval, skip) in enumerate(self.levels):
            on = steps % interval == 0
            later, values = steps[on], [s[on] for s in samples]
            new = later % (interval * skip) == 0
            origins, first = later[new], [v[new] for v in values]
            if self.open[k] is not None:
                origins, first = np.concatenate([self.open[k][0], origins]), [np.concatenate([a, b]) for a, b in zip(self.open[k][1], first)]
            for lag in range(self.size if len(later) else 0):
                wanted = origins + interval * lag
                at = np.minimum(np.searchsorted(later, wanted), len(later) - 1)
                hit = np.flatnonzero(later[at] == wanted)
                if len(hit):
                    yield k, lag, function(tuple(v[hit] for v in first), tuple(v[at[hit]] for v in values))
            stays = self.last - origins < interval * self.size
            self.open[k] = origins[stays], [v[stays] for v in first]


_OUT = "level int, lag_idx int, count long, mean double, variance double"


_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeriesState(StatefulProcessor):
    """The state of a series: its last step and the open origins of all levels, as typed rows. A series that is idle for
    ``idle_ms`` is closed by a timer: its origins are dropped, and further steps of it are an error."""

    def __init__(self, scheme: BlockingScheme, values: Sequence[str], function: Callable[[tuple, tuple], np.ndarray], key: str, idle_ms: int | None):
        self.scheme, self.values, self.function, self.key, self.idle_ms = scheme, list(values), function, key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "step long, closed boolean")
        self.origins = handle.getListState("origins", "level int, step long, v array<double>")

    def handleInputRows(self, key, rows, timerValues):
        own = OnlineCorrelator(self.scheme)
        if self.last.exists():
            step, closed = self.last.get()
            if closed:
                raise ValueError(f"series {key[0]} was closed after step {step}")
            own.resume(step, [(r[0], r[1], list(r[2])) for r in self.origins.get()])
        parts = [[p[c].to_numpy() for c in ("step", *self.values)] for p in rows]
        steps, *samples = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(steps, kind="stable")
        out = [(key[0], level, lag, len(v), float(np.mean(v)), float(np.var(v))) for level, lag, v in own.add(steps[order], [s[order] for s in samples], self.function)]
        self.last.update((own.last, False))
        self.origins.put(list(own.opened()))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[self.key, "level", "lag_idx", "count", "mean", "variance"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.origins.clear()
        self.last.update((self.last.get()[0], True))
        yield pd.DataFrame({self.key: [], "level": [], "lag_idx": [], "count": [], "mean": [], "variance": []})

    def close(self) -> None:
        pass


def correlate_stream(stream: DataFrame, scheme: BlockingScheme, values: Sequence[str], function: Callable[[tuple, tuple], np.ndarray], key: str = "id", idle_ms: int | None = None) -> DataFrame:
    """(key, level, lag_idx, count, mean, variance): what each micro-batch adds
    to the correlation, to be merged by :func:`finished`. Steps start at 0. A task
    holds what one micro-batch has of a key: limit it by ``maxFilesPerTrigger``
    where series are long. State is typed, in the RocksDB state store, which the session must name; one that names none gets it."""
    spark, kind = stream.sparkSession, dict(stream.dtypes)[key]
    if "RocksDB" not in spark.conf.get(_STORE):
        spark.conf.set(_STORE, _ROCKS)
    grouped = stream.select(key, "step", *[F.col(v).cast("double").alias(v) for v in values]).groupBy(key)
    state = SeriesState(scheme, values, function, key, idle_ms)
    return grouped.transformWithStateInPandas(statefulProcessor=state, outputStructType=f"{key} {kind}, {_OUT}", outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")


def finished(parts: DataFrame, scheme: BlockingScheme) -> DataFrame:
    """(level, lag_idx, lag_time, value, error, count) from the moments of all
    micro-batches and series."""
    out = merge(parts, ["level", "lag_idx"]).select("level", "lag_idx", F.col("mean").alias("value"), "error", "count")
    return out.join(F.broadcast(scheme.lags(parts.sparkSession).select("level", "lag_idx", "lag_time")), ["level", "lag_idx"])  # levels times lags


def runtime_left(done: int, all_steps: int, seconds: float) -> str:
    """The remaining time of a run at its rate so far, for people."""
    left = seconds / max(done, 1) * max(all_steps - done, 0)
    for unit, size in (("d", 86400), ("h", 3600), ("min", 60)):
        if left >= size:
            return f"{left / size:.1f} {unit}"
    return f"{left:.0f} s"
