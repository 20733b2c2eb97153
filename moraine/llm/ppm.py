"""Language-model scoring by prediction by partial matching.

A text is its token stream: words split by ASCII white space, A-Z lower-cased,
each followed by one space, and an end symbol (the zero byte). The model is a
trie of byte contexts up to ``order`` bytes. Its statistics are exact counts of
all (order+1)-byte grams of the training documents; shorter contexts are
marginals. A context takes half a count from each of its distinct successors for
the escape (method D); on escape, all symbols of the longer context are excluded in the
shorter one; below order 0 the rest of the 256 bytes share equally.

Every context of the training documents is kept, in a written table of counts.
With a pretrained (static) model the probability at a position depends only on
the gram that ends there. The most frequent grams (at most ``grams_head``) have theirs
broadcast; the others are counted per text, and their distinct ones meet the counts
in tasks that hold all grams of equal last contexts (three bytes), where
:func:`gram_logs` backs off as far as needed. Counts of shorter contexts (at most
256 ** 3 grams, however large the corpus) are broadcast to these tasks.

The unigram base needs the exact count of each word. The ``head`` most frequent
words (bounded) are broadcast; the others, each of which is rare by
construction, meet their counts in one equi-join on a 64-bit hash. Hot words
thus never meet in a task.

Edge cases: a null text is empty (it has just the end token); a zero byte within
a text is the same symbol as the end and is predicted like it; null ids are
never held out; equal texts get equal scores; without training documents the
model is uniform over bytes; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import by_bytes, cut, encoded, held_out, table

ORDER, HEAD, GRAMS_HEAD = 5, 131_072, 1_000_000
BASE = 3  # contexts of fewer bytes are known to every task
WORD, GRAM = 0, 1
_COUNTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])


def hash_word(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


END_KEY = hash_word(b"")  # no word is empty


def streams(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All token streams as one byte array, each after ``order`` zeros of
    context, and where each of them (its end symbol included) starts and ends."""
    pad = bytes(order)
    parts = [b" ".join([*w, b""]) + b"\0" for w in texts]
    flat = np.frombuffer(pad + pad.join(parts) if parts else pad, np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lengths + order) - lengths
    return flat, np.stack([starts, starts + lengths], 1)


def grams(flat: np.ndarray, spans: np.ndarray, order: int) -> np.ndarray:
    """The (order+1)-byte gram that ends at each position of the spans."""
    n = len(flat) - order
    code = np.zeros(n, np.int64)
    for k in range(order + 1):
        code = (code << 8) | flat[k : k + n]
    inside = np.zeros(len(flat) + 1, np.int8)
    inside[spans[:, 0]] += 1
    np.subtract.at(inside, spans[:, 1], 1)
    return code[np.cumsum(inside[:-1])[order:] > 0]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def corpus_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """kind (word or gram), key, n over the one text column of ``texts``; tasks
    add up what they see in tables of bounded size before the shuffle."""

    def run(batches):
        words, keys, counts, held = Counter(), [], [], 0

        def emit(kind, k, c):
            for at in range(0, len(k), 50_000):
                m = len(k[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(np.asarray(k[at : at + m], np.int64)), pa.array(np.asarray(c[at : at + m], np.int64))], schema=_COUNTS)

        def emit_words():
            yield from emit(WORD, np.fromiter(map(hash_word, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        for batch in batches:
            for part in by_bytes(batch, 0, 512):
                split = [t.lower().split() for t in encoded(part.column(0))]
                words.update(chain.from_iterable(split))
                words[b""] += len(split)
                k, c = np.unique(grams(*streams(split, order), order), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 3_000_000:
                    k, c = _merge(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > 1_500_000:
                        yield from emit(GRAM, k, c)
                        keys, counts, held = [], [], 0
                if len(words) > 400_000:
                    yield from emit_words()
        if keys:
            yield from emit(GRAM, *_merge(keys, counts))
        yield from emit_words()

    return texts.mapInArrow(run, _COUNTS_DDL).groupBy("kind", "key").agg(F.sum("n").alias("n"))


_COUNTS_DDL = "kind byte, key long, n long"


def _mask(size: int) -> int:
    return (1 << 8 * size) - 1


class Table:
    """Values of distinct keys of at least 0, by open addressing, half full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, np.nan)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several the last one stays
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        slot = self._slot(keys)
        got = self.keys.take(slot)
        out = np.where(got == keys, self.values.take(slot), np.nan)
        left = np.flatnonzero((got != keys) & (got >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got, own = self.keys.take(slot[left]), keys[left]
            hit = got == own
            out[left[hit]] = self.values.take(slot[left[hit]])
            left = left[~hit & (got >= 0)]
        return out


def _place(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key lies in the sorted table, and whether it does."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def gram_logs(wanted: np.ndarray, grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 probability of the last byte of each wanted gram. ``grams`` are all
    of training whose last contexts of ``min(BASE, order)`` bytes are those of the
    wanted ones, ``low`` all grams of so many bytes, with their counts.

    The successors of a context are among those of each shorter one, so what is
    excluded after an escape are the successors of the last context that occurs."""
    base = min(BASE, order)
    levels: list[tuple] = []
    for k in range(order + 1):
        g, n = (low if k < base else (grams, counts))
        g, n = _merge([g & _mask(k + 1)], [n])
        first = np.flatnonzero(np.r_[True, g[1:] >> 8 != g[:-1] >> 8]) if len(g) else np.zeros(0, np.int64)
        excluded = np.zeros(len(first), np.int64)  # of each context, what its successors have in the next shorter one
        if k and len(g):
            up, up_n = levels[-1][:2]
            excluded = np.add.reduceat(up_n[np.searchsorted(up, g & _mask(k))], first)
        levels.append((g, n, g[first] >> 8, np.add.reduceat(n, first) if len(g) else n, np.diff(np.r_[first, len(g)]), excluded))
    out, scale, open_ = np.zeros(len(wanted)), np.zeros(len(wanted)), np.ones(len(wanted), bool)
    gone, gone_kinds = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for k in range(order, -1, -1):
        g, n, contexts, totals, kinds, excluded = levels[k]
        if not len(g):
            continue
        code = wanted & _mask(k + 1)
        at, known = _place(contexts, code >> 8)
        total, distinct = np.where(known, totals[at] - gone, 0), np.where(known, kinds[at] - gone_kinds, 0)
        place, seen = _place(g, code)
        now = open_ & seen
        out[now] = scale[now] + np.log10((n[place[now]] - np.where(kinds[at[now]] < 256, 0.5, 0.0)) / total[now])
        open_ &= ~seen
        scale += np.where(total > 0, np.log10(np.maximum(distinct, 1) / np.maximum(2 * total, 1)), 0.0)
        gone, gone_kinds = np.where(known, excluded[at], 0), np.where(known, kinds[at], 0)
    out[open_] = scale[open_] - np.log10(np.maximum(256 - len(levels[0][0]), 1))
    return out


def scored_grams(wanted: DataFrame, grams: DataFrame, order: int, parts: int) -> DataFrame:
    """key, value: log10 probability of each of the ``wanted`` grams (key) under the
    counts ``grams`` (key, n), in ``parts`` tasks."""
    spark = wanted.sparkSession
    base = min(BASE, order)
    got = grams.groupBy(F.col("key").bitwiseAND(_mask(base)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast((got["key"].to_numpy(), got["n"].to_numpy()))

    def run(batches):
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            counts.append(batch.column(1).to_numpy(zero_copy_only=False))
        k, n = np.concatenate(keys), np.concatenate(counts)
        asked = k[n < 0]
        logs = gram_logs(asked, k[n > 0], n[n > 0], low.value, order)
        for at in range(0, len(asked), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(asked[at : at + 50_000]), pa.array(logs[at : at + 50_000])], ["key", "value"])

    both = grams.select("key", "n").union(wanted.select("key", F.lit(-1).cast("long").alias("n")))
    return both.repartition(parts, F.shiftright("key", 8).bitwiseAND(_mask(base))).mapInArrow(run, "key long, value double")


def most_frequent(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows (key, n) of the highest counts, at most ``most``, and how many
    rows there are: a cut between sixteenths of a doubling of the count, found from
    one number for each, so that no task sends more than its share of the result."""
    size = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["size"], r["count"]) for r in rows.groupBy(size.alias("size")).count().collect()), reverse=True)
    taken, least = 0, None
    for s, c in sizes:
        if taken + c > most:
            break
        taken, least = taken + c, s
    return rows.where(size >= least if least is not None else F.lit(False)), sum(c for _, c in sizes)


def frequent_grams(grams: DataFrame, most: int) -> tuple[Table, int]:
    """The log10 probabilities of at most ``most`` grams, those of the highest
    counts, and how many grams there are."""
    own_rows, all_ = most_frequent(grams, most)
    context = F.shiftright("key", 8).alias("context")
    totals = grams.groupBy(context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    own = F.when(F.col("kinds") < 256, 0.5).otherwise(0.0)
    head = own_rows.select("key", "n", context).join(totals, "context")
    got = head.select("key", F.log10((F.col("n") - own) / F.col("total")).alias("value")).toArrow()  # at most ``most`` rows
    return Table(got["key"].to_numpy(), got["value"].to_numpy()), all_


def score(docs: DataFrame, training: DataFrame, order: int = ORDER, head: int = HEAD, grams_head: int = GRAMS_HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each of
    ``docs`` under the model and the unigram counts of ``training``. ``head`` and
    ``grams_head`` say how much is broadcast; results don't depend on them."""
    if not 0 <= order <= 6:
        raise ValueError("order must be from 0 to 6")
    spark = docs.sparkSession
    counts = cut(corpus_counts(training.select("text"), order))
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    top = most_frequent(words.withColumnRenamed("word", "key"), head)[0].toPandas().sort_values("key")  # at most ``head`` rows
    grams_ = counts.where(F.col("kind") == GRAM).select("key", "n")
    frequent, n_grams = frequent_grams(grams_, grams_head)
    model = spark.sparkContext.broadcast((frequent, top["key"].to_numpy(np.int64), np.log10(top["n"].to_numpy(np.float64) + 1)))

    def run(batches):
        table_, known, logs = model.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in by_bytes(batch, 1, 128):
                split = [t.lower().split() for t in encoded(part.column(1))]
                flat, spans = streams(split, order)
                code = grams(flat, spans, order)
                p = table_.find(code)
                lengths = spans[:, 1] - spans[:, 0]
                other = np.isnan(p)
                s = np.add.reduceat(np.where(other, 0.0, p), np.cumsum(lengths) - lengths)
                rare_grams, gram_times = np.unique((np.repeat(np.arange(len(split)), lengths)[other] << 56) | code[other], return_counts=True)
                own = list(set(chain.from_iterable(split))) + [b""]
                index = dict(zip(own, range(len(own))))
                keys = np.fromiter(map(hash_word, own), np.int64, len(own))
                place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                is_head = known[place] == keys if len(known) else np.zeros(len(own), bool)
                log = np.where(is_head, logs[place], 0.0) if len(known) else np.zeros(len(own))
                lengths = np.array([len(w) + 1 for w in split], np.int64)
                flat = np.fromiter(map(index.__getitem__, chain.from_iterable([*w, b""] for w in split)), np.int64, int(lengths.sum()))
                starts = np.cumsum(lengths) - lengths
                log_sum, n_head = np.add.reduceat(log[flat], starts), np.add.reduceat(is_head[flat].astype(np.int64), starts)
                owner = np.repeat(np.arange(len(split)), lengths)
                rare = ~is_head[flat]
                pair, times = np.unique((owner[rare] << 32) | flat[rare], return_counts=True)

                def listed(owners, key, n):
                    ends = np.searchsorted(owners, np.arange(len(split) + 1)).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(key), pa.array(n.astype(np.int32))], ["key", "n"]))

                tails = [listed(pair >> 32, keys[pair & 0xFFFFFFFF], times), listed(rare_grams >> 56, rare_grams & _mask(7), gram_times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(len(split))), part.column(0).cast(pa.int64()), pa.array(lengths), pa.array(n_head), pa.array(log_sum), pa.array(s), *tails],
                    ["uid", "doc_id", "n_tokens", "n_head", "log_sum", "head_score", "tail", "tail_grams"],
                )
                uid += len(split)

    entries = "array<struct<key:long,n:int>>"
    rows = cut(docs.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id long, n_tokens long, n_head long, log_sum double, head_score double, tail {entries}, tail_grams {entries}"))

    def tail(name):
        return rows.select("uid", F.explode(name).alias("t")).select("uid", F.col("t.key").alias("key"), F.col("t.n").alias("times"))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_grams // 500_000 + 1)
    logs = scored_grams(tail("tail_grams").select("key").distinct(), grams_, order, parts)
    word_sums = tail("tail").join(words.withColumnRenamed("word", "key"), "key").groupBy("uid").agg(F.sum("times").alias("n_tail"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_sum"))
    gram_sums = tail("tail_grams").join(logs, "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("value")).alias("gram_sum"))
    out = rows.drop("tail", "tail_grams").join(word_sums, "uid", "left").join(gram_sums, "uid", "left")
    zero = F.lit(0)
    base = F.col("log_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    total_score = F.col("head_score") + F.coalesce("gram_sum", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", zero)).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"), total_score.alias("score"))


def op7_partial_matching(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, docs.where(~held_out("doc_id", 7, 2)))
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
