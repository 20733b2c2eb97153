"""Periodic runs of words by block matching.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and length of at least ``max(least, exponent * q)`` that no neighbouring word
extends. All runs of a text are found, exactly:

* The words become numbers. At each scale B, a power of two, the text's aligned blocks of B
  words are keys of an Aho-Corasick automaton over number sequences, which is
  run over the whole text. At the first scale a key is a block's words; then it is the two numbers
  that its halves got at the scale before, and the text is the sequence of the numbers found
  there, places half a block apart side by side: keys stay short, however large the blocks. A run of period q has more than ``(exponent - 1) * q`` words
  that are followed by their equal q words later; the scale of q is the largest B for
  which an aligned block must lie within them. So each run shows at
  its scale as a block that occurs again q words later, and only occurrences
  at distances of that scale are seeds.
* A seed is extended to both sides, word by word exactly, as long as words q apart are equal.
  What is long enough is a run if no smaller period gave the same stretch. A seed within a
  known run whose period divides its distance is that run again.
* Only blocks that can occur again are keys: at the first scale those all of whose
  neighbouring pairs occur twice in the text, at larger ones those whose halves
  have occurred again far enough. In a text without repeats no automaton is built.

One text is one row's work, of about ``n log n`` steps for n words; its memory follows that text alone.

Edge cases: null and empty texts and those of white space have no words and no runs;
equal and repeated rows and null ids are worked on one by one; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import small_batches, table

LEAST, EXPONENT = 24, 3
_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, from 0 in order of appearance."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def scales(n: int, least: int = LEAST, exponent: int = EXPONENT):
    """(B, low, high): every run of a period in [low, high) has an aligned block
    of B words that occurs again one period later."""
    turn = least // exponent  # where exponent * q takes over from least
    spare = min(max(least, exponent * q) - q for q in {max(turn, 1), turn + 1})  # words with an equal one a period later
    b = 1
    while 4 * b - 1 <= spare:
        b *= 2
    low = 1
    while low <= n // exponent:
        high = max(-(-(4 * b - 1) // (exponent - 1)), turn + 1)  # from here on blocks of 2 * B fit in
        yield b, low, high
        b, low = 2 * b, high


def equal_from(x: np.ndarray, d: int, at: int) -> int:
    """The first i >= at with x[i] != x[i + d] (or the end of such i)."""
    step, end = 64, len(x) - d
    while at < end:
        upto = min(at + step, end)
        differ = np.flatnonzero(x[at:upto] != x[at + d : upto + d])
        if len(differ):
            return at + int(differ[0])
        at, step = upto, min(2 * step, 1 << 20)
    return end


def equal_back(x: np.ndarray, d: int, at: int) -> int:
    """The smallest s with x[i] == x[i + d] for all s <= i < at."""
    step = 64
    while at > 0:
        low = max(at - step, 0)
        differ = np.flatnonzero(x[low:at] != x[low + d : at + d])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, step = low, min(2 * step, 1 << 20)
    return 0


def occurrences(sequence: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each key (rows; equal ones share it), then end and number of
    every place of ``sequence`` where one of them ends."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number, made = np.empty(len(keys), np.int64), 0
    for i, key in enumerate(map(tuple, keys.tolist())):
        number[i] = automaton.get(key, made)
        if number[i] == made:
            automaton.add_word(key, made)
            made += 1
    automaton.make_automaton()
    found = np.fromiter((end << 32 | c for end, c in automaton.iter(tuple(sequence.tolist()))), np.int64)  # keys of one length: one a place at most
    return number, found >> 32, found & 0xFFFFFFFF


def doubled(names: np.ndarray, b: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks of ``2 * b`` words (their numbers): the number of each content, then place and content
    of every occurrence. ``names``: what block of ``b`` words begins at each place, from 1 (0: none).
    Places that are ``b`` apart are put side by side, so that two names are a block."""
    rows = -(-len(names) // b)
    side = np.zeros((rows + 1) * b, np.int64)  # one empty row parts the columns
    side[: len(names)] = names
    side = side.reshape(-1, b).T.ravel()
    at = np.flatnonzero(side | np.r_[0, side[:-1]])
    first = 2 * b * blocks
    content, end, what = occurrences(side[at], np.stack([names[first], names[first + b]], 1))
    column, row = np.divmod(at[end - 1], rows + 1)
    return content, row * b + column, what


def runs(x: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(x)
    if n < max(least, exponent):
        return []
    pair = x[:-1] * (int(x.max()) + 1) + x[1:]
    _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
    once = np.cumsum(np.r_[0, count[which] < 2])
    period: dict[tuple[int, int], int] = {}  # (start, end) of a run -> its smallest period
    known: dict[int, list[tuple[int, int]]] = {}
    can, names = None, x
    for b, low, high in scales(n, least, exponent):
        first = np.arange(n // b) * b
        can = once[first + b - 1] == once[first] if can is None else can[: 2 * (n // b) : 2] & can[1 : 2 * (n // b) : 2]
        blocks = np.flatnonzero(can)
        if not len(blocks):
            break
        if low == 1:
            content, end, what = occurrences(x, x[: n // b * b].reshape(-1, b)[blocks])
            place = end - (b - 1)
        else:
            content, place, what = doubled(names, b // 2, blocks)
        names = np.zeros(n, np.int64)
        names[place] = what + 1
        of = np.full(n // b + 1, -1)
        of[blocks] = content
        last = np.zeros(len(blocks) + 1, np.int64)
        np.maximum.at(last, what, place)
        can = np.zeros(n // b, bool)
        can[blocks] = last[content] - first[blocks] >= high  # for the next scale
        starts, distances = [], []
        block = (place - low) // b
        for _ in range(-(-(high - low) // b) + 1):
            d = place - block * b
            good = (block >= 0) & (d < high) & (of[np.maximum(block, 0)] == what)
            starts.append(block[good] * b)
            distances.append(d[good])
            block = block - 1
        a, d = np.concatenate(starts), np.concatenate(distances)
        fresh = np.ones(len(a), bool)
        for p, spans in known.items():
            fresh &= ~_within(a, d, b, p, spans)
        order = np.lexsort((a[fresh], d[fresh]))
        a, d = a[fresh][order], d[fresh][order]
        cuts = np.flatnonzero(np.diff(d)) + 1
        at = 0
        for stop in [*cuts.tolist(), len(a)] if len(a) else []:
            q, own, at = int(d[at]), a[at:stop], stop
            for p in [p for p in known if p < q and p >= low]:  # found at this scale
                own = own[~_within(own, np.full(len(own), q), b, p, known[p])]
            i = 0
            while i < len(own):
                seed = int(own[i])
                s, e = equal_back(x, q, seed), equal_from(x, q, seed)
                if e + q - s >= max(least, exponent * q) and (s, e + q) not in period:
                    period[s, e + q] = q
                    known.setdefault(q, []).append((s, e + q))
                i = int(np.searchsorted(own, max(e, seed + 1)))
    return sorted((s, e - s, q) for (s, e), q in period.items())


def _within(a: np.ndarray, d: np.ndarray, b: int, p: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which seeds lie, both copies, in one of the runs of period ``p`` (by start) and have a multiple of it as distance."""
    s, e = np.array(spans).T
    i = np.searchsorted(s, a, "right") - 1
    return (d % p == 0) & (i >= 0) & (a + d + b <= e[i])


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words joined by spaces, without those that a run has after its first period."""
    if not found:
        return b" ".join(words).decode()
    depth = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        depth[s + q] += 1
        depth[s + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]).decode()


def split_words(doc_id: int | None, text: bytes) -> list[bytes]:
    return text.split()  # bytes split at ASCII white space only


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, words: Callable[[int | None, bytes], list[bytes]] = split_words) -> DataFrame:
    """One row per document (doc_id, text): doc_id, runs (an array by start, then period) and collapsed,
    the text with each run's repeats dropped. ``words`` makes a text's words."""
    if least < 1 or exponent < 2:
        raise ValueError("least must be at least 1 and exponent at least 2")
    small_batches(docs.sparkSession)
    names = ["doc_id", "runs", "collapsed"]

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            told, left = [], []
            for doc, v in zip(ids, texts):
                own = words(doc, v.as_py() or b"")
                found = runs(numbered(own), least, exponent)
                told.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                left.append(collapsed(own, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.list_(_RUN_TYPE)), pa.array(left, pa.string())], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, runs array<{_RUN}>, collapsed string")


def repeated_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; for one document in ten, by the crc32 of its id, all words
    from a place on repeat a stretch of up to a third of them."""
    words = text.split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * -(-(n - a) // p))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (the first of equal ones) and hashes of all
    runs and of the collapsed text."""
    best = F.aggregate("runs", F.lit(None).cast(_RUN), lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_block_matching_runs(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), words=repeated_words))
