"""Trajectory stores: a folder of Parquet tables addressed by element and step.

An element is a path such as ``particles/all/position``. Time-dependent elements
are tables with ``step`` and ``time`` to which steps are appended in increasing
order; static ones are replaced when they are written. A small table ``about``
holds the format version, the creator and the author.

A time-dependent element is a folder of batches, one for each append, in which
rows are range-partitioned and sorted by step, so that a step's rows lie in few
row groups, and a small table ``index`` of its steps (step, time, batch), in versions. An
append writes its rows once, checks the order on the steps of the new batch
and then publishes the next version of the index by a rename that fails if somebody else has
published it: of two writers that append to the same state one gets an error, and a batch that failed is
never read. Reads of steps look them up in the index and open their batches alone, with the steps pushed
down to the scan. :meth:`Reader.follow` streams what is appended.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moraine.functions.box import Box
from moraine.operators.groups import dense_index, sampled_steps, set_columns
from moraine.sources.scratch import delete, names, publish, written

VERSION = (1, 0)
TIME_TOLERANCE = 100 * sys.float_info.epsilon
ABOUT = "major int, minor int, creator string, creator_version string, author string, email string"


class StoreError(ValueError):
    """A folder that is no store, or a step that can't be read or written."""


def check(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a store of a readable version."""
    try:
        about = spark.read.parquet(f"{path}/about")
        return about.columns == StructType.fromDDL(ABOUT).names and about.first()["major"] == VERSION[0]
    except (AnalysisException, TypeError):
        return False


_INDEX = "step long, time double, batch string"


def _index(spark: SparkSession, element: str) -> DataFrame:
    return spark.read.schema(_INDEX).option("recursiveFileLookup", "true").parquet(f"{element}/index")


class Writer:
    """Makes a store; an old one is only replaced with ``overwrite``, and then
    wholly: nothing of it stays readable."""

    def __init__(self, spark: SparkSession, path: str, author: str = "", email: str = "", creator: str = "moraine", overwrite: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        if overwrite and check(spark, self.path):
            delete(spark, self.path)
        about = spark.createDataFrame([(*VERSION, creator, "1", author, email)], ABOUT).coalesce(1)
        about.write.mode("errorifexists").parquet(f"{self.path}/about")
        self._last: dict[str, tuple[int, float] | None] = {}
        self._version: dict[str, int] = {}

    @classmethod
    def resume(cls, spark: SparkSession, path: str) -> Writer:
        """A writer to a store that exists."""
        if not check(spark, path):
            raise StoreError(f"{path} is not a store of version {VERSION[0]}")
        out = cls.__new__(cls)
        out.spark, out.path, out._last, out._version = spark, path.rstrip("/"), {}, {}
        return out

    def _previous(self, element: str) -> tuple[int, float] | None:
        if element not in self._last:
            versions = names(self.spark, f"{self.path}/{element}/index")
            got = _index(self.spark, f"{self.path}/{element}").agg(F.max(F.struct("step", "time")).alias("m")).first()["m"] if versions else None
            self._version[element] = len(versions)
            self._last[element] = got and (got["step"], got["time"])
        return self._last[element]

    def append(self, element: str, rows: DataFrame) -> None:
        """Add steps; they must lie after all stored ones and their times must
        not fall back. Rows without a step are an error, and so is an append after one by another writer
        that this one hasn't seen; it sees it at the next try."""
        batch = uuid4().hex
        path = f"{self.path}/{element}/batch-{batch}"
        rows.repartitionByRange("step").sortWithinPartitions("step").write.parquet(path)
        steps = self.spark.read.parquet(path).groupBy("step").agg(F.min("time").alias("time"), F.max("time").alias("high"), F.count("*").alias("n"))
        steps = written(steps)
        try:
            last = self._follows(element, steps)
            if last is None:
                delete(self.spark, path)
                return
            index = steps.select(F.col("step").cast("bigint").alias("step"), F.col("time").cast("double").alias("time"), F.lit(batch).alias("batch"))
            new = f"{self.path}/{element}/_new-{batch}"
            index.coalesce(1).write.parquet(new)  # one row a step
            if not publish(self.spark, new, f"{self.path}/{element}/index/v{self._version[element]:012d}"):
                delete(self.spark, new)
                del self._last[element]
                raise StoreError(f"{element}: another writer has appended")
        except StoreError:
            delete(self.spark, path)
            raise
        self._last[element] = last
        self._version[element] += 1

    def _follows(self, element: str, steps: DataFrame) -> tuple[int, float] | None:
        """The last step and its time, None if there are no steps; an error if they can't follow the stored ones."""
        span = steps.agg(F.min(F.struct("step", "time")).alias("first"), F.max(F.struct("step", "high")).alias("last"), F.max(F.col("high") - F.col("time")).alias("spread"), F.count_if(F.col("step").isNull()).alias("none")).first()
        if span["none"]:
            raise StoreError(f"{element}: rows without a step")
        if span["first"] is None:
            return None
        before = self._previous(element)
        if span["spread"] is not None and span["spread"] > 0:
            raise StoreError(f"{element}: a step has several times")
        if before and (span["first"]["step"] <= before[0] or span["first"]["time"] < before[1]):
            raise StoreError(f"{element}: step {span['first']['step']} does not follow step {before[0]}")
        # within the new steps times must not fall back either
        ranked = dense_index(steps.select("step", "time"), "step", "place")
        following = ranked.select((F.col("place") - 1).alias("place"), F.col("time").alias("next"))
        if not ranked.join(following, "place").where("next < time").isEmpty():
            raise StoreError(f"{element}: time decreases")
        return span["last"]["step"], span["last"]["high"]

    def append_averaged(self, element: str, rows: DataFrame) -> None:
        """Steps with value, error and count."""
        self.append(element, rows.select("step", "time", "value", "error", "count"))

    def replace(self, element: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{element}")

    def box(self, box: Box) -> None:
        self.replace("box", self.spark.createDataFrame([(i, float(n), "periodic") for i, n in enumerate(box.lengths)], "axis int, length double, boundary string").coalesce(1))

    def particles(self, group: str, rows: DataFrame, fields: Sequence[str], every: int | None = None) -> None:
        """Phase-space fields of stored steps: every ``every`` steps, or only the
        first and the last one."""
        if every:
            rows = sampled_steps(rows, 0, every)
        else:
            ends = rows.agg(F.min("step"), F.max("step")).first()
            rows = rows.where(F.col("step").isin([e for e in ends if e is not None]))
        self.append(f"particles/{group}", rows.select("step", "time", "id", *fields))


class Reader:
    def __init__(self, spark: SparkSession, path: str):
        if not check(spark, path):
            raise StoreError(f"{path} is not a store of version {VERSION[0]}")
        self.spark, self.path = spark, path.rstrip("/")
        self.about = spark.read.parquet(f"{self.path}/about").first().asDict()

    def steps(self, name: str) -> DataFrame:
        """(step, time, batch) of a time-dependent element."""
        try:
            return _index(self.spark, f"{self.path}/{name}")
        except AnalysisException as e:
            raise StoreError(f"{name} has no steps in the store") from e

    def element(self, name: str) -> DataFrame:
        """A whole element, time-dependent or static."""
        try:
            batches = [r[0] for r in self.steps(name).select("batch").distinct().sort("batch").collect()]  # one an append
        except StoreError:
            batches = None
        try:
            return self.spark.read.parquet(*([f"{self.path}/{name}"] if batches is None else [f"{self.path}/{name}/batch-{b}" for b in batches]))
        except AnalysisException as e:
            raise StoreError(f"{name} is not in the store") from e

    def _at(self, name: str, chosen: DataFrame, what: str) -> DataFrame:
        """The rows of the one step that ``chosen`` has."""
        found = chosen.select("step", "batch").limit(2).collect()
        if not found:
            raise StoreError(f"nonexistent {what}")
        if len(found) > 1:
            raise StoreError(f"ambiguous {what}")
        return self.spark.read.parquet(f"{self.path}/{name}/batch-{found[0]['batch']}").where(F.col("step") == found[0]["step"])

    def _last(self, steps: DataFrame, name: str, column: str):
        last = steps.agg(F.max(column)).first()[0]
        if last is None:
            raise StoreError(f"{name} has no steps")
        return last

    def read_at_step(self, name: str, offset: int) -> DataFrame:
        """One step's rows; negative offsets count from the last step, -1."""
        steps = self.steps(name)
        step = offset if offset >= 0 else offset + self._last(steps, name, "step") + 1
        return self._at(name, steps.where(F.col("step") == step), "step")

    def read_at_time(self, name: str, offset: float) -> DataFrame:
        """As :meth:`read_at_step`; the sign bit decides, so -0.0 is the last."""
        steps = self.steps(name)
        last = self._last(steps, name, "time")
        time = offset if math.copysign(1, offset) > 0 else offset + last
        return self._at(name, steps.where(F.abs(F.col("time") - time) <= TIME_TOLERANCE * max(abs(time), abs(last))), "time")

    def read_steps(self, name: str, first: int, last: int, every: int = 1) -> DataFrame:
        """The rows of all stored steps from ``first`` to ``last``, or of every so many of them counted from ``first``: only batches
        that hold any are opened."""
        chosen = self.steps(name).where(F.col("step").between(first, last) & ((F.col("step") - first) % every == 0))
        batches = [r[0] for r in chosen.select("batch").distinct().sort("batch").collect()]  # one an append
        if not batches:
            return self.element(name).limit(0)
        rows = self.spark.read.parquet(*[f"{self.path}/{name}/batch-{b}" for b in batches])
        return rows.where(F.col("step").between(first, last) & ((F.col("step") - first) % every == 0))

    def follow(self, name: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
        """Start a stream of what is appended to an element, from its first step on: ``handle`` gets the rows of each
        version of the index as it is published, and the number of the micro-batch. After a restart from the checkpoint it goes on
        behind the last version that was handled."""
        index = self.spark.readStream.schema(_INDEX).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{self.path}/{name}/index")

        def run(rows: DataFrame, number: int) -> None:
            batches = [r[0] for r in rows.select("batch").distinct().collect()]  # of one append
            if batches:
                handle(self.spark.read.parquet(*[f"{self.path}/{name}/batch-{b}" for b in batches]), number)

        return index.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()

    def box(self) -> Box:
        rows = self.element("box").orderBy("axis").collect()
        if any(r["boundary"] != "periodic" for r in rows):
            raise StoreError("only periodic boxes can be read")
        return Box(tuple(r["length"] for r in rows))

    def particles(self, group: str, fields: Sequence[str] = ()) -> DataFrame:
        """Chosen fields only: others are not read."""
        rows = self.element(f"particles/{group}")
        return rows.select("step", "time", "id", *fields) if fields else rows

    def restore(self, particles: DataFrame, group: str, fields: Sequence[str], offset: int = -1, box: Box | None = None) -> DataFrame:
        """Write a stored step's fields into a table of particles."""
        return set_columns(particles, self.read_at_step(f"particles/{group}", offset).select("id", *fields), fields, box)


def static_species(rows: DataFrame) -> DataFrame:
    """(id, species) of the first step, for tools that want fixed species."""
    first = rows.agg(F.min("step").alias("step"))
    return rows.join(F.broadcast(first), "step").select("id", "species")  # one row


def as_particles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Box]:
    """The vectors of ``embeddings`` as particles in a unit box."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = [F.col("embedding")[k].cast("double") for k in range(6)]
    names = ("x", "y", "z", "vx", "vy", "vz")
    rows = e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("species"), (1.0 + F.col("label")).cast("double").alias("mass"),
                    *[c.alias(n) for c, n in zip(v, names)], *[F.lit(0).alias(n) for n in ("ix", "iy", "iz")])
    return rows, Box((1.0, 1.0, 1.0))


def as_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one dense series: step, time, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("step"), F.col("event_id").cast("double").alias("time"), "value", "event_type")


def as_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a trajectory: each user is a particle whose value is its
    velocity, and the running sum of values its position."""
    from moraine.operators.sorting import keyed_scan

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    rows = keyed_scan(e, "value", ["user_id"], ["ts", "event_id"], "step", "x")
    return rows.select(F.col("user_id").alias("id"), "step", F.col("value").alias("vx"), "x")
