"""N-gram Jaccard join by a token-group matrix.

A document's tokens are 48-bit hashes of its distinct word shingles, kept
sorted. The join finds the connected components of all pairs with Jaccard
similarity of at least ``percent`` / 100:

1. Documents with equal token sets become one *set*.
2. Similar sets are partitioned into groups: sets that agree on the smallest
   tokens of a few residue classes meet in one task and are linked exactly, in
   three independent rounds; what is connected by then is a group.
3. Token-group matrix: a set can only reach the threshold with another one if
   they share a token among the first ones (by a global order, rare tokens
   first) of both, as many as the threshold leaves to differ. A token's row
   lists the groups that have it there. Two groups of a row are candidates if
   their sizes allow a link and if enough of both sets follows the token: what
   comes before the first shared token is not shared.
4. For a candidate the sets of the smaller group are queries. Their overlap with
   the token union of the larger group bounds their overlap with each member;
   only groups that qualify are opened, and links are decided by the tokens.
5. Components over the found links join the groups.

The order of tokens comes from counts of all tokens in a fixed table of hashed
counters, so that what many documents share is never used to find candidates
unless a set has little else. It only affects speed, not results.

Tokens are never written but for the first ones: slim rows (digests and sizes) are, and the tokens
of sets that a step wants are made again from the texts that a bit map of wanted
documents marks. Intermediate tables are deleted as soon as nothing reads them.

Bounds: broadcasts are the table of counters, bit maps of wanted sets (fixed
sizes) and rows of hot keys (fewer than 4,096); groups are opened in chunks of
about ``CHUNK`` tokens of members against as many of queries; a token's row that
lists more than ``ROW`` groups, by a count that is never too small (:func:`hot_tokens`), is dealt into blocks of at most about that
many, and each pair of blocks is a row of its own; tasks of the matrix hold about
``PART`` entries. A bit map's false positives only cost time.

Edge cases: null and empty texts and texts of white space have no tokens and
link with nothing; with fewer words than ``words`` the whole sequence is the one
token; repeated rows are documents of their own; null ids are no component ids
(a component has the smallest id that is not null); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Tables, by_bytes, cut, encoded, join_hot, ranges, table
from moraine.llm.components import components
from moraine.llm.counters import counted, place
from moraine.llm.words import distinct, mix, shingle_hashes, word_hashes

WORDS, PERCENT = 4, 85
STAGE_WORDS, STAGE_PERCENT = 5, 80
ROUNDS, MINIMA = 3, 3
MAP_BITS = 1 << 24
NO_ID = -(2**63)  # stands for a null id meanwhile
CHUNK = 500_000  # tokens of a chunk
ROW, PART = 20_000, 1_000_000  # groups of a token's block; entries of the matrix in a task
WINDOW, MOST_HOT = 1 << 22, 1_000_000  # entries that a task counts at a time; hot tokens
_SETS = "doc_id long, text_key binary, n long, key binary, sides array<long>"


def packed_tokens(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked_tokens(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def token_lists(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    runs, counts = shingle_hashes(*word_hashes(texts), words)
    return distinct(runs >> np.uint64(16), counts)


def _slices(batch: pa.RecordBatch, rows: int = 128):
    text = next(i for i, t in enumerate(batch.schema.types) if pa.types.is_string(t) or pa.types.is_large_string(t))
    yield from by_bytes(batch, text, rows)


def token_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, text_key (md5), n (distinct tokens), key
    (of the token set), sides (what decides the group of each round)."""

    def run(batches):
        classes = ROUNDS * MINIMA
        for batch in batches:
            for part in _slices(batch):
                rows, texts = [], encoded(part.column(1))
                for text, own in zip(texts, token_lists(texts, words)):
                    least = np.full(classes, -1, np.int64).view(np.uint64)
                    least[(own[::-1] % np.uint64(classes)).astype(np.int64)] = own[::-1]
                    sides = [int(mix(least[r * MINIMA : (r + 1) * MINIMA]).sum().view(np.int64)) for r in range(ROUNDS)]
                    rows.append((hashlib.md5(text).digest(), len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), sides))
                text_key, n, key, sides = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(text_key, pa.binary()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sides, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n", "key", "sides"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SETS)


def token_rarity(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """uint8 per counter: eight steps for each doubling of the count of the
    tokens that fall there."""

    def values(batch):
        for part in _slices(batch):
            yield from token_lists(encoded(part.column(0)), words)

    return np.minimum(8 * np.log2(counted(docs.select("text"), values) + 1.0), 255).astype(np.uint8)


def marks(rows: DataFrame, *keys: str) -> DataFrame:
    """A bit map of fixed size in which the bits of all keys are set: rows
    (_m_word, _m_bits), ``MAP_BITS`` / 64 at most."""
    bit = F.expr("shiftleft(1L, cast(_m_hash % 64 as int))")
    hashed = rows.select(F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS)).alias("_m_hash"))
    return hashed.groupBy(F.floor(F.col("_m_hash") / 64).alias("_m_word")).agg(F.bit_or(bit).alias("_m_bits"))


def with_mark(rows: DataFrame, bits: DataFrame, *keys: str) -> DataFrame:
    """Add ``_m_marked``: false for keys that are certainly not in the map."""
    known = rows.withColumn("_m_hash", F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS))).withColumn("_m_word", F.floor(F.col("_m_hash") / 64))
    bit = F.expr("shiftleft(1L, cast(_m_hash % 64 as int))")
    marked = F.coalesce(F.col("_m_bits").bitwiseAND(bit) != 0, F.lit(False))
    return known.join(F.broadcast(bits), "_m_word", "left").withColumn("_m_marked", marked).drop("_m_hash", "_m_word", "_m_bits")


def text_rows(docs: DataFrame) -> DataFrame:
    """text_key (md5), doc_id and text of each document."""
    return docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def tokens_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """text_key and tokens of the documents of ``wanted`` (text_key, doc_id), and
    of a few others that the bit map takes for them; one row per text. Only
    these are tokenized and shuffled, each text at most once by a task."""

    def run(batches):
        done = set()
        for batch in batches:
            for part in _slices(batch):
                keys = part.column(0).to_pylist()
                own = [i for i, k in enumerate(keys) if k not in done and not done.add(k)]
                if own:
                    texts = encoded(part.column(1).take(pa.array(own)))
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.binary()), pa.array([packed_tokens(x) for x in token_lists(texts, words)], pa.binary())], ["text_key", "tokens"])

    marked = with_mark(text_rows(docs), wanted, "text_key", "doc_id").where("_m_marked").select("text_key", "text")
    return marked.mapInArrow(run, "text_key binary, tokens binary").groupBy("text_key").agg(F.first("tokens").alias("tokens"))


class Index:
    """Posting lists of the tokens of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        flat = flat[order]
        self.first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        self.union = flat[self.first]
        self.last = np.r_[self.first[1:], len(flat)]

    def places(self, query: np.ndarray) -> np.ndarray:
        """Which tokens of the union the query has."""
        if not len(self.union):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        return at[self.union[at] == query]

    def overlaps(self, places: np.ndarray) -> np.ndarray:
        a, n = self.first[places], (self.last - self.first)[places]
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Members whose similarity with the query is at least the threshold;
        the group is opened only if its union overlaps enough."""
        places = self.places(query)
        # any member in reach has at least percent/100 of the query's tokens
        if not len(query) or 100 * len(places) < percent * len(query):
            return np.zeros(0, np.int64)
        both = self.overlaps(places)
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.sizes + len(query) - both)))


def chunk_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first of its component within ``sets``. Only links to
    sets that are not reached yet are looked for."""
    root = np.full(len(sets), -1, np.int64)
    left = np.arange(len(sets))
    index = Index(sets)
    for seed in range(len(sets)):
        if root[seed] >= 0:
            continue
        root[seed], todo = seed, [seed]
        while todo:
            if (root[left] < 0).sum() < 0.5 * len(left):
                left = left[root[left] < 0]
                index = Index([sets[i] for i in left])
            if not len(left):
                break
            hit = left[index.linked(sets[todo.pop()], percent)]
            hit = hit[root[hit] < 0]
            root[hit] = seed
            todo += hit.tolist()
    return root


def grouped(ids: DataFrame, docs: DataFrame, words: int, percent: int, t: Tables) -> DataFrame:
    """Links (a, b) of the sets of ``ids`` that meet in the groups of any round,
    to the first one of each component there."""
    own = ids.select("sid", "text_key", "doc_id", F.posexplode("sides").alias("round", "side"), "n")
    sizes = own.groupBy("round", "side").agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1").drop("m")
    chunk = F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / CHUNK)).cast("int")
    wanted = t.cut(own.join(sizes, ["round", "side"]).select("sid", "text_key", "doc_id", "round", "side", chunk.alias("chunk")))
    tokens = tokens_of(docs, t.cut(marks(wanted, "text_key", "doc_id")), words)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("sid", ignore_index=True)
        root = chunk_components([unpacked_tokens(x) for x in pdf["tokens"]], percent)
        sid, moved = pdf["sid"].to_numpy(), root != np.arange(len(pdf))
        return pd.DataFrame({"a": sid[moved], "b": sid[root[moved]]})

    met = wanted.drop("doc_id").join(tokens, "text_key").drop("text_key")
    return t.cut(met.groupBy("round", "side", "chunk").applyInPandas(run, "a long, b long"))


def first_tokens(tokens: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens by (rarity, value): two sets within the threshold share
    one of them."""
    n = len(tokens)
    need = -(-percent * n // 100)  # the overlap that any partner must have
    order = np.argsort(rarity[place(tokens)], kind="stable")
    return tokens[order[: n - need + 1]]


def _distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else []
    return x[new], y[new]


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, all second bytes, ...: high bytes are alike, and so the
    shuffle's compression finds them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind: str, width: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((len(data) // width, size), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(kind).reshape(-1)


def row_pairs(token: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, percent: int):
    """Candidate pairs of the groups that share a token. Rows are (token, group)
    with the smallest and largest size of its sets that have the token first
    and the most tokens that any of them has from there on; yields arrays of
    distinct pairs."""
    order = np.lexsort((low, token))
    token, g, low, high, left = token[order], g[order], low[order], high[order], left[order]
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    end = np.repeat(np.r_[start[1:], len(token)], np.diff(np.r_[start, len(token)]))
    # by growing least size, partners follow while theirs is in reach of the largest
    code = np.cumsum(np.r_[False, token[1:] != token[:-1]]) * (1 << 33)
    limit = np.searchsorted(code + low, code + np.minimum(100 * high // percent, (1 << 33) - 1), side="right")
    n = np.minimum(limit, end) - np.arange(len(token)) - 1
    # the smaller of two sets shares percent/(100+percent) of both: at least twice that of itself
    n[(high == low) & (left * (100 + percent) < 2 * percent * low)] = 0
    some = np.flatnonzero(n > 0)
    for block in np.array_split(some, int(n[some].sum() >> 22) + 1) if len(some) else []:
        i = np.repeat(block, n[block])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[block]) - n[block], n[block])
        fits = (g[i] != g[j]) & (np.minimum(left[i], left[j]) * (100 + percent) >= percent * (low[i] + low[j]))
        i, j = g[i[fits]], g[j[fits]]
        yield _distinct_pairs(np.minimum(i, j), np.maximum(i, j))


def hot_tokens(first: DataFrame, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted tokens whose rows list more than ``ROW`` groups, and in how many blocks their groups are to be dealt.
    ``first``: (first, g), the first tokens of a set of group g; ``entries``: about how many there are.

    Tasks count (token, group) pairs in windows of about ``WINDOW`` and tell of tokens that are listed at least ``least``
    times there. What a window doesn't tell is less than ``least``, so a sum over all windows is too small by less than ``slack``, half a row at most, which is added.
    No more than ``2 * entries / row`` tokens can be hot; a row is as long as keeps these below ``MOST_HOT``."""
    row = max(ROW, 2 * entries // MOST_HOT)
    windows = first.select(F.spark_partition_id()).distinct().count() + entries // WINDOW
    least = max(1, row // 2 // max(windows, 1))
    slack = (least - 1) * windows

    def run(batches):
        held, size = [], 0

        def told():
            token, g = (np.concatenate(x) for x in zip(*held))
            token, _ = _distinct_pairs(token, g)
            token, n = np.unique(token, return_counts=True)
            some = n >= least
            token, n = token[some].view(np.int64), n[some]
            for at in range(0, len(token), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(token[at : at + 50_000]), pa.array(n[at : at + 50_000].astype(np.int64))], ["token", "n"])

        for b in batches:
            for data, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                token = unpacked_tokens(data)
                held.append((token, np.full(len(token), g, np.int64)))
                size += len(token)
                if size >= WINDOW:
                    yield from told()
                    held, size = [], 0
        if held:
            yield from told()

    counts = first.select("first", "g").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") + slack > row).toArrow()  # at most MOST_HOT rows
    token = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], np.ceil((found["n"].to_numpy()[order] + slack) / row).astype(np.int64)


def in_blocks(token: np.ndarray, g: np.ndarray, hot: np.ndarray, hot_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, token) of the rows in which each entry (token, group) is listed.
    Of a token that is not ``hot`` that is
    its own row. Else the groups are dealt into blocks by hash, and each pair of
    blocks is a row, so that any two groups meet in one row at least."""
    blocks = np.ones(len(token), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
        known = hot[at] == token
        blocks[known] = hot_blocks[at[known]]
    if (blocks == 1).all():
        return np.arange(len(token)), token
    entry = np.repeat(np.arange(len(token)), np.maximum(blocks - 1, 1))
    own = (mix(g.view(np.uint64)).astype(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)[entry]
    other = ranges(np.maximum(blocks - 1, 1))
    other += other >= own
    split = blocks[entry] > 1
    pair = (np.minimum(own, other) << 24) + np.maximum(own, other)
    return entry, np.where(split, mix(token[entry] + mix(pair.view(np.uint64))) >> np.uint64(16), token[entry])


def candidates(docs: DataFrame, groups: DataFrame, rarity: np.ndarray, words: int, percent: int, t: Tables) -> DataFrame:
    """Pairs (g1 < g2) of groups that share a first token, with sizes and places
    that allow a link; ``groups``: (text_key, n, g)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rarity)
    wide = [("text_key", pa.binary()), ("first", pa.binary())]

    def firsts(batches):
        done = set()
        for batch in batches:
            for part in _slices(batch):
                keys = part.column(0).to_pylist()
                own = [i for i, k in enumerate(keys) if k not in done and not done.add(k)]
                if own:
                    lists = token_lists(encoded(part.column(2).take(pa.array(own))), words)
                    rows = [packed_tokens(first_tokens(x, shared.value, percent)) for x in lists]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.binary()), pa.array(rows, pa.binary())], schema=pa.schema(wide))

    first = text_rows(docs).mapInArrow(firsts, "text_key binary, first binary").join(groups.where("n > 0").select("text_key", "n", "g"), "text_key").select("n", "first", "g")
    first = t.cut(first)  # about a seventh of all tokens
    entries = groups.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries) // PART + 1)
    hot = hot_tokens(first, int(entries))

    def packed(batches):
        held, size = [], 0

        def emit():
            token, g, n, left = (np.concatenate(x) for x in zip(*held))
            entry, token = in_blocks(token, g, *hot)
            g, n, left = g[entry], n[entry], left[entry]
            order = np.lexsort((n, g, token))
            token, g, n, left = token[order], g[order], n[order], left[order]
            new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (g[1:] != g[:-1])])
            token, g, low, high, left = token[new], g[new], n[new], n[np.r_[new[1:], len(n)] - 1], np.maximum.reduceat(left, new)
            part = (mix(token) % np.uint64(4 * parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.r_[part[order][1:] != part[order][:-1], True]) + 1
            rows, at = [], 0
            for e in ends.tolist():
                o = order[at:e]
                rows.append((int(part[o[0]]), packed_planes(token[o]), _planes(g[o]), *(_planes(x[o].astype("<i4")) for x in (low, high - low, left))))
                at = e
            p, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], ["part", "token", "g", "low", "more", "left"])

        def packed_planes(token):
            return _planes(token.astype("<u8"))[: 6 * len(token)]

        for b in batches:
            for n, data, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                token = unpacked_tokens(data)
                held.append((token, np.full(len(token), g, np.int64), np.full(len(token), n, np.int64), n - np.arange(len(token))))
                size += len(token)
                if size > 1 << 18:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    def pairs(batches):
        held: dict[int, list] = {}
        for b in batches:
            for p, *rest in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(p, []).append(rest)
        kinds = (("<u8", 6), ("<i8", 8), ("<i4", 4), ("<i4", 4), ("<i4", 4))
        while held:
            rows = held.popitem()[1]
            token, g, low, more, left = (np.concatenate([_from_planes(r[i], *k) for r in rows]) for i, k in enumerate(kinds))
            low = low.astype(np.int64)
            for x, y in row_pairs(token, g, low, low + more, left.astype(np.int64), percent):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["g1", "g2"])

    rows = first.mapInArrow(packed, "part int, token binary, g binary, low binary, more binary, left binary")
    return rows.repartition(parts, "part").mapInArrow(pairs, "g1 long, g2 long").distinct()


def opened(pairs: DataFrame, groups: DataFrame, docs: DataFrame, words: int, percent: int, t: Tables) -> DataFrame:
    """Links (a, b) between groups of ``pairs`` of which two sets are linked."""
    sizes = groups.groupBy("g").agg(F.sum("n").alias("m"))
    groups = groups.select("sid", "text_key", "doc_id", "g")
    sided = pairs.join(sizes.select(F.col("g").alias("g1"), F.col("m").alias("m1")), "g1").join(sizes.select(F.col("g").alias("g2"), F.col("m").alias("m2")), "g2")
    first_larger = F.col("m1") >= F.col("m2")
    sided = t.cut(sided.select(
        F.when(first_larger, F.col("g1")).otherwise(F.col("g2")).alias("big"), F.when(first_larger, F.col("g2")).otherwise(F.col("g1")).alias("small"),
        F.ceil(F.greatest("m1", "m2") / CHUNK).cast("int").alias("chunks"), F.least("m1", "m2").alias("m"),
    ))
    load = sided.groupBy("big").agg(F.max("chunks").alias("chunks"), F.ceil(F.sum("m") / CHUNK).cast("int").alias("salts"))
    who = ["sid", "text_key", "doc_id", "big"]
    members = load.join(groups.withColumnRenamed("g", "big"), "big").select(
        *who, F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("small"))
    asking = sided.select("big", "small").join(load, "big").join(groups.withColumnRenamed("g", "small"), "small").select(
        *who, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt"), "small")
    wanted = t.cut(members.unionByName(asking))
    tokens = tokens_of(docs, t.cut(marks(wanted, "text_key", "doc_id")), words)

    def run(pdf):
        import pandas as pd

        asks = pdf["small"].notna().to_numpy()
        tokens = [unpacked_tokens(t) for t in pdf["tokens"]]
        index = Index([t for t, q in zip(tokens, asks) if not q])
        linked = set()
        for g, i in zip(pdf["small"][asks].astype("int64"), np.flatnonzero(asks)):
            if g not in linked and len(index.linked(tokens[i], percent)):
                linked.add(g)
        return pd.DataFrame({"a": [int(pdf["big"].iloc[0])] * len(linked), "b": sorted(linked)}, dtype="int64")

    return wanted.drop("sid", "doc_id").join(tokens, "text_key").groupBy("big", "chunk", "salt").applyInPandas(run, "a long, b long")


def set_components(sets: DataFrame, docs: DataFrame, words: int, percent: int, t: Tables) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (key, sid, least, m: what has the smallest id, and how
    many documents there are of it) and (sid, root) of their components."""
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    ids = sets.where("n > 0").groupBy("key").agg(F.min(least).alias("least"), F.count("*").alias("m"), F.first("sides").alias("sides"), F.first("n").alias("n"))
    ids = t.cut(ids.select(F.monotonically_increasing_id().alias("sid"), "key", "least", "m", "sides", "n", "least.doc_id", "least.text_key"))
    links = grouped(ids, docs, words, percent, t)
    found = components(links)
    groups = t.cut(ids.select("sid", "n", "text_key", "doc_id").join(found.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "n", "text_key", "doc_id", F.coalesce("root", "sid").alias("g")))
    pairs = t.cut(candidates(docs, groups, token_rarity(docs, words), words, percent, t))
    roots = groups.select("sid", F.col("g").alias("root"))
    if not pairs.isEmpty():
        links = components(opened(pairs, groups, docs, words, percent, t))
        roots = groups.join(links.select(F.col("node").alias("g"), "root"), "g", "left").select("sid", F.coalesce("root", "g").alias("root"))
    return ids.select("key", "sid", "least", "m"), roots


def component_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, text_key, n, and of its component (null
    without tokens) first_id, the smallest id, and first_text, the text_key of a
    document that has it."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    with Tables() as t:
        sets = t.cut(token_sets(docs, words))
        ids, roots = set_components(sets, docs, words, percent, t)
        named = t.cut(ids.join(roots, "sid").drop("sid"))
        least = t.cut(named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("sets")))
        firsts = t.cut(join_hot(named.drop("least"), least, "root", "sets").select("key", "m", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_text")))
        rows = sets.select("doc_id", "text_key", "n", "key")
        none = rows.where("n = 0").select("doc_id", "text_key", "n", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("binary").alias("first_text"))
        return cut(join_hot(rows.where("n > 0"), firsts, "key", "m").drop("key").unionByName(none))


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    first = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return component_rows(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), first.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = STAGE_WORDS, percent: int = STAGE_PERCENT) -> DataFrame:
    """One document of each component stays (the smallest id; null ids come
    last), its columns unchanged. Documents without words are no duplicates."""
    rows = component_rows(docs, words, percent).where("n > 0").withColumn("_m_id", F.coalesce("doc_id", F.lit(NO_ID)))
    first = F.coalesce("first_id", F.lit(NO_ID))
    # what is no component's first document, and first documents that are repeated
    lost = (F.col("_m_id") != first) | (F.col("text_key") != F.col("first_text"))
    told = cut(rows.groupBy("_m_id", F.col("text_key").alias("_m_text")).agg(F.max(lost).alias("_m_lost"), F.count("*").alias("_m_rows")).where("_m_lost or _m_rows > 1").drop("_m_rows"))
    # a row travels as one value, so that its names clash with nothing here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_m_row")
    mine = docs.select(row, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_m_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_m_text"))
    marked = with_mark(mine, cut(marks(told, "_m_id", "_m_text")), "_m_id", "_m_text")
    # only rows that may be told of are shuffled
    met = marked.where("_m_marked").join(told, ["_m_id", "_m_text"], "left")
    repeated = met.where("not _m_lost").groupBy("_m_id", "_m_text").agg(F.first("_m_row").alias("_m_row"))
    kept = marked.where("not _m_marked").select("_m_row").union(met.where("_m_lost is null").select("_m_row")).union(repeated.select("_m_row"))
    return kept.select("_m_row.*")


def op6_token_group_join(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
