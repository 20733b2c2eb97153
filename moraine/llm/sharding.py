"""Balanced shards from global prefix sums of bytes.

Documents are ordered by the md5 of their text, so that equal texts are
neighbours and the order says nothing about the source. One pass over the slim
rows (no texts), range-partitioned and sorted, gives every row its prefix sum
within its partition; each partition reports one row of totals, the driver adds
these up, and the global prefix sum of a row is its partition's base plus its
own. Shards are cut from the order at targets that make all of them equal.

Equal texts stay together: they count as one interval of the prefix sums, and lie in one shard.

An interval can't be cut, so a shard may miss its target by half an interval at either end.
That is little for small texts, not for large ones. So the law is applied
from coarse to fine: texts (with all their copies) of like size, within a factor of two, have
prefix sums of their own, which are cut, by the intervals' middles, at the targets that even out what
the shards have from the coarser ones (:func:`rooms`); the last and finest prefix sums, over all
texts below ``1 / LARGE`` of a shard, even out what is left. Every text is placed by prefix sums, and each shard is a contiguous stretch of
every class. There are fewer than ``shards * LARGE`` coarse texts, whatever the data.
Only copies that together exceed a shard's target can't stay
whole: each of them is placed like a text of its own. A text larger than a shard's target takes the place of
what else the shard would get.

Edge cases: a null text has no bytes, crc 0 and forms a group of its own with
the empty text; null and repeated ids and repeated rows keep separate places; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Tables, cut, table

SHARDS, OVERHEAD, LARGE = 40, 16, 40
_ROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("group", pa.int32()), ("start", pa.int64()), ("place", pa.int64())])
_DDL = "part int, doc_id long, size long, text_crc32 long, group int, start long, place long"
TOTALS = -2  # of a row that holds its partition's totals; other rows: -1 or the number of a large group


def rooms(loads: np.ndarray, amount: float) -> np.ndarray:
    """How much of ``amount`` each shard takes so that the smallest ``loads`` rise to one level."""
    rising = np.sort(loads)
    levels = (amount + np.cumsum(rising)) / np.arange(1, len(loads) + 1)  # if the k smallest ones take all
    level = levels[np.flatnonzero(levels >= rising)[-1]]
    return np.maximum(level - loads, 0)


def cut_at(sizes: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """The shard of each size, by the middle of its interval in the prefix sums."""
    ends = np.cumsum(rooms(loads, sizes.sum()))
    return np.searchsorted(ends[:-1], np.cumsum(sizes) - sizes / 2, side="right")


def coarse_shards(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each of some large sizes, in the order given; bytes of each shard), class by class from the
    largest: sizes of a class differ by less than a factor of two."""
    out, loads = np.zeros(len(sizes), np.int64), np.zeros(shards)
    kind = np.floor(np.log2(np.maximum(sizes, 1)))
    for k in np.unique(kind)[::-1]:
        own = np.flatnonzero(kind == k)
        out[own] = cut_at(sizes[own].astype(float), loads)
        loads += np.bincount(out[own], sizes[own], shards)
    return out, loads


def prefix_sums(rows: DataFrame) -> DataFrame:
    """For sorted rows (key, doc_id, size, text_crc32, group): start, the bytes
    before the first row of the same key in its partition, and place, the number
    of rows before it; rows of large groups have places of their own and no
    bytes. The last row of a partition holds its totals."""

    def run(batches):
        part, bytes_, places, key, start, seen = TaskContext.get().partitionId(), 0, 0, None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys, size, group = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(4).to_numpy()
            plain = group < 0
            counted = np.where(plain, size, 0)
            before = bytes_ + np.cumsum(counted) - counted
            new = np.r_[keys[0] != key, keys[1:] != keys[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            starts = np.where(first < 0, start, before[np.maximum(first, 0)])
            rank = np.where(plain, places + np.cumsum(plain) - plain, seen + np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(starts), pa.array(rank)], schema=_ROW)
            bytes_, places, seen, key, start = bytes_ + int(counted.sum()), places + int(plain.sum()), seen + n, keys[-1], int(starts[-1])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, None, bytes_, seen, TOTALS, 0, places), _ROW.types)], schema=_ROW)

    return rows.mapInArrow(run, _DDL)


def shard_documents(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    with Tables() as t:
        slim = t.cut(docs.select(F.md5(text).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")))
        total = slim.agg(F.sum("size")).first()[0] or 0
        target = total / shards
        # fewer than shards * LARGE rows
        large = slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where(F.col("bytes") * LARGE > target).collect()
        large = sorted(large, key=lambda r: r["key"])
        cut_up = [r for r in large if r["bytes"] > target and r["rows"] > 1]
        fine = {r["key"] for r in cut_up if r["bytes"] * LARGE <= target * r["rows"]}
        own = [r for r in large if r["key"] not in fine]
        split = {r["key"] for r in cut_up} - fine  # whose copies are large themselves
        times = np.array([r["rows"] if r["key"] in split else 1 for r in own], np.int64)
        items = np.repeat(np.array([r["bytes"] for r in own], np.int64) // np.maximum(times, 1), times)
        of, given = coarse_shards(items, shards)
        shards_of = [x.tolist() for x in np.split(of, np.cumsum(times)[:-1])] if own else []
        groups = spark.createDataFrame([(r["key"], i) for i, r in enumerate(own)] + [(k, -1) for k in sorted(fine)], "key string, group int")
        # rows of a hot text are spread over the ranges; all others of a text lie in one range
        tie = F.when(F.col("group").isNull(), F.lit(0)).otherwise(F.xxhash64("doc_id", F.monotonically_increasing_id()))
        hot = F.col("group") == -1
        mine = slim.join(F.broadcast(groups), "key", "left").withColumn("tie", tie)
        # each row of a text that is cut up counts for itself
        mine = mine.select(F.when(hot, F.concat("key", F.lit(" "), F.hex("tie"))).otherwise(F.col("key")).alias("key"), "doc_id", "size", "text_crc32", F.coalesce("group", F.lit(-1)).alias("group"), "tie")
        ranged = mine.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "doc_id").drop("tie")
        summed = cut(prefix_sums(ranged))

    totals = summed.where(F.col("group") == TOTALS).select("part", F.col("size").alias("bytes"), F.col("text_crc32").alias("seen"), F.col("place").alias("places")).sort("part").collect()  # one row a partition
    bases, at = [], (0, 0, 0)
    for r in totals:
        bases.append((r["part"], *at))
        at = (at[0] + r["bytes"], at[1] + r["places"], at[2] + r["seen"])
    ends = np.cumsum(rooms(given, at[0]))  # prefix sums at which the next shard begins
    reached = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends[:-1]]), lambda e: e <= F.col("global"))) if shards > 1 else F.lit(0)
    bases = spark.createDataFrame(bases, "part int, bytes_before long, places_before long, seen_before long")
    placed = summed.where(F.col("group") != TOTALS).join(F.broadcast(bases), "part")
    place = (F.col("place") + F.when(F.col("group") < 0, F.col("places_before")).otherwise(F.col("seen_before"))).alias("place")
    placed = placed.select("doc_id", "size", "text_crc32", "group", (F.col("start") + F.col("bytes_before")).alias("global"), place)
    # the copies of a large text in their order take its shards in theirs: fewer than shards * LARGE texts
    begins = {r[0]: r[1] for r in placed.where("group >= 0").groupBy("group").agg(F.min("place")).collect()}
    shards_ = spark.createDataFrame([(i, sorted(x), begins[i]) for i, x in enumerate(shards_of)], "group int, given array<int>, begin long")
    given_ = F.col("given")[F.when(F.size("given") > 1, F.col("place") - F.col("begin")).otherwise(F.lit(0)).cast("int")]
    placed = placed.join(F.broadcast(shards_), "group", "left").select("doc_id", "size", "text_crc32", "group", F.coalesce(given_, reached).cast("int").alias("shard"), "place")
    # a stretch: the plain rows of a shard, or its copies of a large text; fewer than shards * (LARGE + 1)
    stretches = placed.groupBy("shard", "group").agg(F.min("place").alias("first"), F.count("*").alias("rows")).sort("shard", "group").collect()
    firsts, filled = [], [0] * shards
    for r in stretches:
        firsts.append((r["shard"], r["group"], filled[r["shard"]] - r["first"]))
        filled[r["shard"]] += r["rows"]
    firsts = spark.createDataFrame(firsts, "shard int, group int, shift long")
    return placed.join(F.broadcast(firsts), ["shard", "group"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"))


def op4_prefix_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
