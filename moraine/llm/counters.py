"""Counts of hashed values over a whole table in an array of fixed size.

Each task counts into an array of its own and sends its compressed blocks. They
are added up in two levels, first those of ``FAN`` tasks at a time, so that no
task reads the blocks of all others; the sums are gathered on the driver:
``COUNTERS`` numbers, whatever the input. Values that share a counter add up, so
a count is never too small.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS, BLOCKS, FAN = 1 << 22, 64, 64


def place(values: np.ndarray) -> np.ndarray:
    """The counter of each 64-bit value."""
    return ((values >> np.uint64(20)) % np.uint64(COUNTERS)).astype(np.int64)


def packed(values: np.ndarray):
    """(block, compressed data) of the blocks that are not zero."""
    for i, part in enumerate(np.split(values, BLOCKS)):
        if part.any():
            yield i, zlib.compress(part.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    """A block's numbers: of 4 bytes from a task, of 8 bytes once added up."""
    raw = zlib.decompress(data)
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * COUNTERS // BLOCKS else "<i8").astype(np.int64)


def block_rows(values: np.ndarray):
    made, part = list(packed(values)), TaskContext.get().partitionId() // FAN
    if made:
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in made], pa.int32()), pa.array([part] * len(made), pa.int32()), pa.array([x for _, x in made], pa.binary())], ["block", "part", "data"])


def counted(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """How often each counter's values occur in ``rows``; ``values`` gives the
    64-bit hashes of a batch, array by array."""

    def run(batches):
        total = np.zeros(COUNTERS, np.uint32)
        held, size = [], 0

        def add_up():
            at, n = np.unique(place(np.concatenate(held)), return_counts=True)
            total[at] += n.astype(np.uint32)

        for batch in batches:
            for own in values(batch):
                held.append(own)
                size += len(own)
                if size > 1 << 20:
                    add_up()
                    held, size = [], 0
        if held:
            add_up()
        yield from block_rows(total)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                x = unpacked(data)
                held[block] = held[block] + x if block in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["block", "part", "data"])

    ddl = "block int, part int, data binary"
    sums = rows.mapInArrow(run, ddl).repartition("block", "part").mapInArrow(add, ddl).repartition("block").mapInArrow(add, ddl)
    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for r in sums.collect():  # one row a block
        out[r["block"]] += unpacked(bytes(r["data"]))
    return out.reshape(-1)
