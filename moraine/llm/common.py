"""Helpers shared by the text and vector operators.

Column names that begin with ``_m_`` are internal; inputs may carry any other
extra columns, which operators either ignore or pass through unchanged.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long, and Spark's default of 10,000 rows a batch would need much
    memory at both ends; a session that sets a number of its own keeps it."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs on a single machine (tests) a
    temporary one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='moraine-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: dict[str, str] = {}


def remove(path: str) -> None:
    """Delete a folder of written tables."""
    jvm = SparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/moraine-{app}"
        atexit.register(remove, _scratch[app])
    return _scratch[app]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_alone: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage
    that survives the loss of any executor. The table is there as long as the
    driver runs, or :func:`alone` does."""
    out, path = _written(df)
    if _alone:
        _alone[-1].append(path)
    return out


def alone(make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``make`` gives, written, and its folder; all tables that :func:`cut` wrote for it are deleted."""
    _alone.append([])
    try:
        return _written(make())
    finally:
        for path in _alone.pop():
            remove(path)


class Tables:
    """The written tables of one operator: all that :meth:`cut` writes is deleted
    at the end of the ``with`` block, so that only what the operator's result
    still reads (written by the function :func:`cut`) takes room after it."""

    def __enter__(self) -> Tables:
        self.paths: dict[int, str] = {}
        self.frames: dict[int, DataFrame] = {}  # kept, so that no other one gets their ids
        return self

    def cut(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths[id(out)], self.frames[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if (path := self.paths.pop(id(t), None)) is not None:
                remove(path)

    def __exit__(self, *_) -> None:
        for path in self.paths.values():
            remove(path)


#: Keys with more than one part in ``HOT_SHARE`` of all rows are hot: there are fewer than ``HOT_SHARE`` of them, whatever the data.
HOT_SHARE = 4096


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row for each key
    and in ``count`` how many of ``rows`` have it. Rows of hot keys, which would
    all meet in one task, are joined by a broadcast of less than ``HOT_SHARE``
    rows; all others by a shuffle. Both tables should be written ones."""
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    few = F.broadcast(per_key.where(hot).drop(count))
    rest = rows.join(F.broadcast(per_key.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(per_key.where(~hot).drop(count), key))


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table with the hint to broadcast it if it has at most ``most``
    rows; without the hint otherwise."""
    return F.broadcast(df) if df.count() <= most else df


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % m


def held_out(doc_id: str | Column, m: int, r: int) -> Column:
    """True where :func:`crc_mod` equals ``r``; a null id is never held out."""
    return F.coalesce(crc_mod(doc_id, m) == r, F.lit(False))


def hash_unit(*cols: Column) -> Column:
    """A repeatable uniform number in [0, 1) from the columns' 64-bit hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null gives the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def by_bytes(batch: pa.RecordBatch, column: int, rows: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for single longer values, ``most`` bytes in a column."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        stop = min(at + rows, max(at + 1, upto))
        yield batch.slice(at, stop - at)
        at = stop


def record(batch_schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, t in zip(columns, batch_schema.types)], schema=batch_schema)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
