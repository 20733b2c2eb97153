"""Orders, permutations, scans, clustering and table helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.functions.box import Box
from moraine.functions.hilbert import curve_depth, with_hilbert_code
from moraine.operators.groups import NO_BUCKET, dense_index
from moraine.sources.scratch import written


def sort_by_key(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Stable order by ``key``: equal keys keep the order of ``tie``."""
    return rows.orderBy(key, tie)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add 0, 1, ... in the order of any columns. Rows are range-partitioned by
    them and written once; a row's number is its place in its range above the
    counts of the ranges before, of which there is one row each."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # that id holds the partition above 33 bits of the place in it
    ranged = written(ranged.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_own")).drop("_id"))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def permute(rows: DataFrame, permutation: DataFrame, index: str = "index") -> DataFrame:
    """Row ``source`` moves to ``index``: (index, source) joins rows by place."""
    return permutation.select(index, "source").join(rows.withColumnRenamed(index, "source"), "source").drop("source")


def exclusive_scan(rows: DataFrame, value: str, order: str, width: int = 65_536) -> DataFrame:
    """Add ``scan``, the sum of all earlier values in the order of a whole-number
    column: scans of ranges, above the totals of the ranges before. Rows without an
    order come first. Rows of equal order come in any order among themselves, so
    their scans may change places from run to run."""
    bucket = F.coalesce(F.floor(F.col(order) / width), F.lit(NO_BUCKET))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    return rows.withColumn("_own", own).join(before, "_bucket").withColumn("scan", F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket")


def keyed_scan(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], number: str = "number", scan: str = "scan") -> DataFrame:
    """Add each row's number among those of its key, from 0, and the sum of values up to and with it, in the
    order of any columns. Rows are range-partitioned by keys and order, so that a key with many rows is many
    ranges, and written once; a range's numbers and sums go above those of the key's ranges before, of which
    there is one row each."""
    by = [*keys, *order]
    ranged = written(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    totals = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.col(k).alias("_k" + k) for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    told = ranged.withColumns({number: F.row_number().over(within), scan: F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    same = [F.col(k).eqNullSafe(F.col("_k" + k)) for k in keys]
    on = F.col("t._part") == F.col("b._part")
    for c in same:
        on = on & c
    told = told.alias("t").join(totals.alias("b"), on)
    return told.select(*[F.col(f"t.{c}") for c in rows.columns], (F.col(number) + F.col("_n") - 1).cast("bigint").alias(number), (F.col(scan) + F.col("_s")).alias(scan))


def compact(rows: DataFrame, predicate: Column, order: str) -> DataFrame:
    """Rows that satisfy the predicate, with their new places in the old order."""
    return dense_index(rows.where(predicate), order, "place")


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each key; a limit is the feature."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def hilbert_clustered(particles: DataFrame, box: Box, cell: float, partitions: int | None = None) -> DataFrame:
    """Rows laid out along a Hilbert curve: near particles share partitions."""
    rows = with_hilbert_code(particles, box, curve_depth(box, cell))
    ranged = rows.repartitionByRange(partitions, "hilbert") if partitions else rows.repartitionByRange("hilbert")
    return ranged.sortWithinPartitions("hilbert", "id")


def sorted_values(a: Column) -> Column:
    return F.sort_array(a)


def repeat_element(x: Column, n: int) -> Column:
    return F.array_repeat(x, n)


def reversed_values(a: Column) -> Column:
    return F.reverse(a)


def keys(m: Column) -> Column:
    return F.map_keys(m)


def concatenated(*arrays: Column) -> Column:
    return F.concat(*arrays)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def interpolate(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template from columns."""
    out, rest = [], template
    while rest:
        head, open_, tail = rest.partition("{")
        out.append(F.lit(head))
        if not open_:
            break
        name, _, rest = tail.partition("}")
        out.append(values[name].cast("string"))
    return F.concat(*out)
