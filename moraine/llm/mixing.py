"""Mixing sources to target weights with exact quotas.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating. They
share ``share`` times all words; a target stops at ``limit`` times its source's
size and the excess is shared again by weight.

Draw: a source's documents fall into hash blocks (equal in expectation, at most
``max_blocks`` a source), so a block is both small and a random set. Each pass
over a source is an epoch with a permutation of its blocks; one epoch after the
other, the blocks are numbered in permuted order. A source's quota is the number
of blocks whose words reach its target; the block at the border is split in two
in hash order of its documents, and only the first part counts as that block.

Splitting tree: the vector of exact block quotas of all sources is split between
the left and the right half of the output shards by one multivariate
hypergeometric draw, and so on down to single shards. A shard takes the next
disjoint stretch of each source's permuted blocks, as long as its quota says;
what no shard's stretch reaches isn't taken. The documents of a shard are
shuffled locally, by a hash of epoch and document.

Scale: the texts are read once for slim rows (size and hashes) and once for the
mixed rows. Sizes are aggregated by (source, block) before anything else; the
driver sees one row per source (computing targets needs all of them; at most
``MAX_SOURCES``, else an error); windows run over a source's blocks (at most
``max_blocks`` an epoch) and over the slim rows of border blocks only (a
source's share of ``1 / max_blocks`` or ``block_words``). The number of shards
follows the words. All draws come from hashes and a seed, so reruns agree.

Edge cases: a null text has no words; documents without words are taken like
others, with size 0; a source of size 0 has target 0 and isn't taken; an empty
table gives no rows; rows without an id or with repeated ids are told apart by
their texts; rows equal in id and text share one fate (a block's border can't
lie between them); other columns are kept out of the way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moraine.llm.common import Tables, cut, small, table

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, MAX_BLOCKS, SEED = 20_000, 4096, 11
SHARDS, SHARD_WORDS = 16, 20_000_000  # at least so many shards; more if they would have more words
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words split by ASCII white space, without building them: the number of
    characters that follow a separator or the start."""
    one = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(one, " \t\n\x0b\f\r", "")), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """The target of each source; ``sizes``: (source, size), in any order."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, out = dict(order), share * sum(n for _, n in order), {}
    free = [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > limit * size[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = limit * size[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); columns sum to
    ``quotas`` exactly. Each inner node splits its quotas by one multivariate
    hypergeometric draw, whose generator is seeded by the node."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
        split(lo, mid, left)
        split(mid, hi, q - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _keyed(docs: DataFrame, seed: int, max_blocks: int) -> list[Column]:
    """The source, the fine block and the place in its block of each document."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    own = F.xxhash64(F.lit(seed), "doc_id", "text")
    return [source.alias("_m_source"), F.pmod(own, F.lit(max_blocks)).cast("int").alias("_m_fine"), F.xxhash64(F.lit(seed + 3), own).alias("_m_hash")]


def slim_rows(docs: DataFrame, seed: int = SEED, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """doc_id, size and what decides a document's fate; the only pass over texts
    that counts words."""
    return docs.select("doc_id", *_keyed(docs, seed, max_blocks), word_count(F.col("text")).alias("_m_size"))


def draws(slim: DataFrame, tables: Tables, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block_words: int = BLOCK_WORDS,
          max_blocks: int = MAX_BLOCKS, shards: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sources (_m_source, _m_source_size, _m_target, _m_blocks) and what is
    dealt of each block (_m_source, _m_block): _m_whole, the (epoch, shard) of its
    draws, and _m_part, those in which it is a border block and only documents up
    to the hash _m_last are taken. ``slim``: a written table of :func:`slim_rows`."""
    spark = slim.sparkSession
    fine = tables.cut(slim.groupBy("_m_source", "_m_fine").agg(F.sum("_m_size").alias("words")))
    totals = fine.groupBy("_m_source").agg(F.sum("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources can't have targets computed on the driver")
    totals = {r[0]: r[1] for r in totals}
    names = {k: None if k == "n" else k[1:] for k in totals}
    goal = targets([(names[k], n) for k, n in totals.items()], weights, share, limit)
    plan = [(k, int(n), float(goal[names[k]]), int(max(1, min(max_blocks, -(-n // block_words)))), int(goal[names[k]] // n) if n else 0) for k, n in totals.items()]
    sources = spark.createDataFrame(plan, "_m_source string, _m_source_size long, _m_target double, _m_blocks int, epochs int")

    # fine blocks by a hash of fixed width; a source's blocks are runs of them
    by_block = with_blocks(fine, sources, max_blocks).groupBy("_m_source", "_m_block").agg(F.sum("words").alias("words"), *[F.first(c).alias(c) for c in ("_m_source_size", "_m_target", "epochs")])
    # the blocks of each epoch in permuted order
    ordered = by_block.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    run = Window.partitionBy("_m_source", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "epoch", "_m_block"), "_m_block")
    ordered = ordered.withColumn("before", F.sum("words").over(run) - F.col("words")).withColumn("rank", F.row_number().over(run) - 1).withColumn("in_epoch", F.count("*").over(Window.partitionBy("_m_source", "epoch")))
    left = F.col("_m_target") - F.col("epoch") * F.col("_m_source_size") - F.col("before")
    ordered = tables.cut(ordered.select("_m_source", "_m_block", "epoch", "words", (F.col("epoch") * F.col("in_epoch") + F.col("rank")).alias("position"), left.alias("left")))

    # quotas: the blocks whose words reach the target; the tree deals them to the shards
    quota = {r[0]: r[1] for r in ordered.where("left > 0").groupBy("_m_source").agg(F.count("*")).collect()}
    order = sorted(quota)
    if shards is None:
        shards = max(SHARDS, int(sum(goal.values()) // SHARD_WORDS) + 1)
    tree = splitting_tree(np.array([quota[s] for s in order], np.int64), shards, seed) if order else np.zeros((shards, 0), np.int64)
    ends = [(s, [int(x) for x in np.cumsum(tree[:, i])]) for i, s in enumerate(order)]
    ends = F.broadcast(spark.createDataFrame(ends, "_m_source string, ends array<long>"))
    # a shard's stretch of the permuted blocks: positions from the end of the shard before to its own
    shard = F.size(F.filter("ends", lambda e: e <= F.col("position")))
    dealt = ordered.join(ends, "_m_source").withColumn("shard", shard).where(F.col("shard") < F.size("ends"))
    drawn = dealt.select("_m_source", "_m_block", F.struct("epoch", "shard").alias("draw"), "words", "left")
    border = F.col("left") < F.col("words")
    by_draws = tables.cut(drawn.groupBy("_m_source", "_m_block").agg(
        F.sort_array(F.collect_list(F.when(~border, F.col("draw")))).alias("_m_whole"), F.sort_array(F.collect_list(F.when(border, F.col("draw")))).alias("_m_part"), F.min(F.when(border, F.col("left"))).alias("left")))
    # where a border block is split (one a source at most): behind the document whose middle is the last before the quota
    split = with_blocks(slim, sources, max_blocks).join(small(tables.cut(by_draws.where("size(_m_part) > 0").select("_m_source", "_m_block", "left"))), ["_m_source", "_m_block"])
    up = Window.partitionBy("_m_source", "_m_block").orderBy("_m_hash").rangeBetween(Window.unboundedPreceding, 0)
    last = split.withColumn("upto", F.sum("_m_size").over(up)).where(F.col("upto") - F.col("_m_size") / 2 <= F.col("left")).groupBy("_m_source", "_m_block").agg(F.max("_m_hash").alias("_m_last"))
    return sources.drop("epochs"), cut(by_draws.join(last, ["_m_source", "_m_block"], "left").drop("left"))


def with_blocks(rows: DataFrame, sources: DataFrame, max_blocks: int) -> DataFrame:
    """Rows with _m_fine get their block and what is known of their source."""
    joined = rows.join(F.broadcast(sources), "_m_source")  # MAX_SOURCES rows at most
    return joined.withColumn("_m_block", F.floor(F.col("_m_fine") * F.col("_m_blocks") / max_blocks).cast("int"))


def with_draws(rows: DataFrame, plan: tuple[DataFrame, DataFrame], seed: int, max_blocks: int) -> DataFrame:
    """Add _m_draws, one struct (epoch, shard, place) for each time that a row is taken."""
    sources, blocks = plan
    return with_blocks(rows, sources, max_blocks).join(small(blocks), ["_m_source", "_m_block"], "left").withColumn("_m_draws", _drawn(seed))


def _drawn(seed: int) -> Column:
    has = F.coalesce(F.col("_m_hash") <= F.col("_m_last"), F.lit(False))
    none = F.array().cast("array<struct<epoch:int,shard:int>>")
    own = F.concat(F.coalesce("_m_whole", none), F.when(has, F.coalesce("_m_part", none)).otherwise(none))
    return F.transform(own, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 4), d["epoch"], F.col("_m_hash")).alias("place")))


def mix(docs: DataFrame, seed: int = SEED, max_blocks: int = MAX_BLOCKS, **options) -> DataFrame:
    """doc_id, _m_size, _m_source_size, _m_target and _m_draws of each document:
    one struct (epoch, shard, place) for each time that a shard takes it; sorting
    a shard's draws by place shuffles it."""
    slim = cut(slim_rows(docs, seed, max_blocks))
    with Tables() as tables:
        plan = draws(slim, tables, seed=seed, max_blocks=max_blocks, **options)
    return with_draws(slim, plan, seed, max_blocks).select("doc_id", "_m_size", "_m_source_size", "_m_target", "_m_draws")


def mixed_rows(docs: DataFrame, seed: int = SEED, max_blocks: int = MAX_BLOCKS, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns unchanged,
    laid out shard after shard and shuffled within each."""
    with Tables() as tables:
        plan = draws(tables.cut(slim_rows(docs, seed, max_blocks)), tables, seed=seed, max_blocks=max_blocks, **options)
    # the row travels as one value, so that its names clash with nothing here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_m_row")
    mine = with_draws(docs.select(row, *_keyed(docs, seed, max_blocks)), plan, seed, max_blocks).select("_m_row", F.explode("_m_draws").alias("_m_draw"))
    order = ["_m_draw.shard", "_m_draw.place"]
    return mine.repartitionByRange(*order).sortWithinPartitions(*order).select("_m_row.*")


def op5_hypergeometric_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id", F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"),
        (F.col("_m_size") * F.size("_m_draws")).alias("taken"), F.to_json("_m_draws").alias("draws"),
    )
