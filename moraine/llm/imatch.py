"""Document fingerprints by I-Match with randomised lexicon subsets.

A text's terms are its distinct words whose inverse document frequency lies in a
band (too common and too rare ones say little). Document frequencies are exact:
each task adds up what it sees, and Spark sums by 64-bit term hash. A band of
``2 ** -high`` to ``2 ** -low`` of all documents has at most ``2 ** high`` times the
mean number of distinct terms of a text, however large the corpus: only the
band's terms are gathered and broadcast (checked against ``MOST_TERMS``).

Randomised lexicons: ``LEXICONS`` fixed subsets of the band for each share of
``SHARES``; a term belongs to a lexicon if a hash of both says so, whatever the text.
A signature is a hash of the terms, sorted, that text and lexicon share; an edit
leaves the signatures of those lexicons alone that hold none of the changed
terms. Large lexicons tell short texts apart, small ones let long texts survive
edits. A fingerprint is the signature of the whole band (all of the text's terms, 64 bits), then
the signatures of all lexicons (16 bits each), share by share. The likeness of two fingerprints is the share of equal signatures among the
lexicons of one share that hold a term of either text, for the share at which it
is largest; shares with less than ``LEAST`` such lexicons don't count.

A text with words but none in the band has no I-Match signature. Its terms are
then all its words, in the same lexicons, and its fingerprint begins with
``w`` instead of ``b``; fingerprints of different kinds have likeness 0. A text
without words has the fingerprint ``e``.

The next document (ascending id; after the last the first) is found by range
partitioning: tasks stream over sorted rows, and only each partition's first and
last row meet in a join of one row per partition. Texts travel compressed.

Edge cases: a null text is empty; equal texts have equal fingerprints; null ids
come first and rows of equal id follow each other by the hash of their text; a
single document is its own next; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Tables, by_bytes, cut, encoded, table
from moraine.llm.words import distinct, mix, word_hashes

BAND = (3.0, 12.0)  # log2 of (documents / documents with the term)
SHARES, LEXICONS, LEAST, SEED = (8, 64, 512, 4096), 16, 4, 97  # a lexicon keeps one in so many terms of the band
MOST_TERMS = 20_000_000
BATCH = 64
_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, (len(SHARES), LEXICONS), dtype=np.uint64)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """term (hash of the word), n: the texts that have it; tasks add up in
    tables of bounded size before the shuffle."""

    def run(batches):
        held, size = [], 0

        def emit():
            term, n = np.unique(np.concatenate(held).view(np.int64), return_counts=True)
            for at in range(0, len(term), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(term[at : at + 50_000]), pa.array(n[at : at + 50_000])], ["term", "n"])

        for batch in batches:
            for part in by_bytes(batch, 0, BATCH):
                for own in distinct(*word_hashes(encoded(part.column(0)))):
                    held.append(own)
                    size += len(own)
                if size > 1 << 22:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    return texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def band_terms(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The sorted hashes of the band's terms."""
    texts = docs.select("text")
    n = texts.count()
    inside = document_frequencies(texts).where((F.col("n") >= n * 2.0 ** -band[1]) & (F.col("n") <= n * 2.0 ** -band[0])).select("term")
    with Tables() as t:
        inside = t.cut(inside)
        if (found := inside.count()) > MOST_TERMS:
            raise ValueError(f"the band has {found} terms, more than {MOST_TERMS}; choose a narrower one")
        return np.sort(inside.toArrow()["term"].to_numpy().view(np.uint64))


def _hashed(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of sorted terms; ``first``: where the runs begin."""
    rank = np.arange(len(terms)) - np.repeat(first, np.diff(np.r_[first, len(terms)]))
    return mix(np.add.reduceat(mix(terms + mix(rank.astype(np.uint64) + np.uint64(1))), first))


def signatures(terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's sorted terms: one hash of all, and (texts, shares, LEXICONS)
    hashes of those that each lexicon keeps; 0 where there are none."""
    counts = np.array([len(t) for t in terms], np.int64)
    whole, out = np.zeros(len(terms), np.uint64), np.zeros((len(SHARES), LEXICONS, len(terms)), np.uint16)
    flat = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(terms)), counts)
    step = max(1, (1 << 21) // max(len(flat), 1))
    with np.errstate(over="ignore"):
        if len(flat):
            whole[counts > 0] = _hashed(flat, (np.cumsum(counts) - counts)[counts > 0])
        for s, share in enumerate(SHARES):
            limit = np.uint64(((1 << 64) - 1) // share)
            for a in range(0, LEXICONS, step):
                row, at = np.nonzero(mix(flat ^ _SEEDS[s, a : a + step, None]) <= limit)
                if not len(row):
                    continue
                run = row * len(terms) + owner[at]
                first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                out[s, a:].reshape(-1)[run[first]] = np.maximum((_hashed(flat[at], first) >> np.uint64(48)).astype(np.uint16), 1)
    return whole, out.transpose(2, 0, 1)


def fingerprints(texts: list[bytes], band: np.ndarray) -> list[str]:
    """The fingerprint of each text: its kind, the signature of all its terms and, for
    each share that has any, the share's number and signatures."""
    terms, kinds = [], []
    for own in distinct(*word_hashes(texts)):
        inside = own[band[np.minimum(np.searchsorted(band, own), len(band) - 1)] == own] if len(band) else own[:0]
        kinds.append("b" if len(inside) else "w" if len(own) else "e")
        terms.append(inside if len(inside) else own)
    whole, parts = signatures(terms)
    return [
        k if k == "e" else f"{k}{w:016x}" + "".join(f"{s}{row.astype('>u2').tobytes().hex()}" for s, row in enumerate(own) if row.any())
        for k, w, own in zip(kinds, whole.tolist(), parts)
    ]


_HEAD, _WIDTH = 17, 1 + 4 * LEXICONS


def parsed(fingerprint: str) -> dict[int, np.ndarray]:
    """The signatures of each share that has any."""
    return {int(fingerprint[a]): np.frombuffer(bytes.fromhex(fingerprint[a + 1 : a + _WIDTH]), ">u2") for a in range(_HEAD, len(fingerprint), _WIDTH)}


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if a[0] != b[0]:
        return 0.0
    x, y, best = parsed(a), parsed(b), 0.0
    none = np.zeros(LEXICONS, np.uint16)
    for s in x.keys() | y.keys():
        p, q = x.get(s, none), y.get(s, none)
        told = int(((p > 0) | (q > 0)).sum())
        if told >= LEAST:
            best = max(best, float(((p == q) & (p > 0)).sum() / told))
    return best


def edited_text(text: str, following: str) -> str:
    """The last quarter replaced by as much of the next text's beginning."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _judged(rows: list[tuple], band: np.ndarray) -> list[list]:
    """Columns for rows (doc_id, text, fingerprint, next text, its fingerprint)."""
    edited = [edited_text(r[1], r[3]).encode() for r in rows]
    prints = fingerprints(edited, band)
    return [
        [r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(e).hexdigest() for e in edited], [r[2] for r in rows], prints,
        [likeness(r[2], p) for r, p in zip(rows, prints)], [likeness(r[2], r[4]) for r in rows],
    ]


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compressed(docs: DataFrame) -> DataFrame:
    """doc_id, tie (of equal ids) and the text, compressed."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for part in by_bytes(b, 2, 256):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([press.compress(x) for x in encoded(part.column(2))], pa.binary())], ["doc_id", "tie", "packed"])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, packed binary")


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """The rows of ``_ROW``, one per document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(band_terms(docs, band))

    def run(batches):
        import zstandard

        part, last, unpack = TaskContext.get().partitionId(), None, zstandard.ZstdDecompressor()
        for batch in batches:
            for b in by_bytes(batch, 2, BATCH, 1 << 20):  # compressed
                raw = [unpack.decompress(x) for x in b.column(2).to_pylist()]
                own = list(zip(b.column(0).to_pylist(), [x.decode() for x in raw], fingerprints(raw, shared.value)))
                ends = [] if last else [(part, 1, *own[0])]
                line = [last, *own] if last else own
                done = [(*x, y[1], y[2]) for x, y in zip(line, line[1:])]
                last = own[-1]
                yield _batch(_judged(done, shared.value), ends)
        if last:
            yield _batch([[]] * len(_TYPES), [(part, 2, *last)])

    def _batch(done: list[list], ends: list[tuple]):
        n, m = len(done[0]), len(ends)
        doc, text, mark = ([e[i] for e in ends] for i in (2, 3, 4))
        columns = [[None] * n + [e[0] for e in ends], [0] * n + [e[1] for e in ends], [None] * n + text]
        own = [done[0] + doc, done[1] + [0] * m, done[2] + [None] * m, done[3] + mark, done[4] + [None] * m, done[5] + [None] * m, done[6] + [None] * m]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns + own, [pa.int32(), pa.int32(), pa.string(), *_TYPES])], ["part", "kind", "text", *_NAMES])

    order = ["doc_id", "tie"]
    rows = cut(_compressed(docs).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"part int, kind int, text string, {_ROW}"))
    parts = sorted(r[0] for r in rows.where("kind = 1").select("part").collect())  # one number a partition
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int")
    firsts = rows.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = rows.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(firsts, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")

    def finish(batches):
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_judged(rows, shared.value), _TYPES)], _NAMES)

    return rows.where("kind = 0").select(_NAMES).unionByName(ends.mapInArrow(finish, _ROW))


def op9_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
