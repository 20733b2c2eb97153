"""Best-fit packing of tokenized documents by the sum-of-squares rule.

A document's ids end with id 0; ids beyond ``length`` are cut into pieces of
``length``. A piece goes where the sum over residual gaps of the squared number
of open sequences with that gap becomes smallest, a new sequence being one of
the choices. Where that ends with more sequences than the ids need, the same
pieces are also packed with new sequences only where none has room, and the
better of the two packings stands. Full pieces are sequences by themselves.

Pieces (slim rows) are written and dealt round robin to packing tasks of about
``PER_TASK`` pieces, whatever their ids are; each task sorts its pieces by length
(longest first; ties by id, piece and crc), so its result does not depend on the
order of arrival, and packs them with one counter per gap: memory follows the
pieces of one task (about 40 bytes each), never the tokens.

Tokenizing is one pass of Arrow batches: white space always ends a token of this
vocabulary, so ids are remembered by white-space word in tables of bounded size
and only unseen words, or their unseen parts, reach the tokenizer.

Edge cases: null and empty texts are the single id 0; equal documents, null and
repeated ids are packed separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Tables, by_bytes, cut, small_batches, table

LENGTH, END = 2048, 0
PER_TASK = 50_000
CACHE_WORDS = 500_000  # of each of two tables in a worker; fewer where other stages need its memory
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered(dict):
    """A dictionary of bounded size that makes what it lacks: when it is full it
    becomes the old half, and what is found there moves to the new one."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.half, self.old, self.make = most // 2, {}, make

    def __missing__(self, key: str) -> bytes:
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.half:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


#: Of lower-cased text up to U+00FF: what the vocabulary's pattern takes as one.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^a-z0-9\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u00b2\u00b3\u00b9\u00bc-\u00be]+")
#: White space for Python but not for the vocabulary.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it
    is visible, else the next one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """Ids of texts as little-endian uint32 bytes, by remembered words.

    White space always ends a token, so a text's ids are those of its words. An
    unseen word of plain letters, digits and signs (up to U+00FF) is split into
    the parts that the vocabulary never joins, and only unseen parts are merged
    by the tokenizer's model; all other words are encoded by the tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = Remembered(cache_words, self._word), Remembered(cache_words, self._part)
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.by_parts = self._agrees()

    def _agrees(self) -> bool:
        """Whether working by parts gives this tokenizer's ids for samples."""
        try:
            samples = ["Don't", "x9's", "na\u00efve,42", "!!a--b", "\u00c9T\u00c9'LL", "\u00bd\u00b2\u00aa\u00d7"]
            return all(self._merged(_PART.findall(s.lower())) == self._encoded([s])[0] for s in samples)
        except Exception:
            return False

    def _encoded(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(part if part.isascii() and part.isalnum() else part.translate(self.letters))]).tobytes()

    def _merged(self, parts: list[str]) -> bytes:
        return b"".join(map(self._part, parts))

    def _word(self, word: str) -> bytes:
        if self.by_parts and (word.isascii() or max(word) <= "\u00ff") and "<|" not in word:
            parts = _PART.findall(word.lower())
            return self.parts[parts[0]] if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))
        return self._encoded([word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.words.__getitem__
        return [self._encoded([t])[0] if _SEPARATORS.search(t) else b"".join(map(known, t.split())) for t in texts]


_kept: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, cache_words: int = CACHE_WORDS) -> WordIds:
    """One per Python worker, so that tasks go on with what others remembered."""
    if (path, cache_words) not in _kept:
        _kept[path, cache_words] = WordIds(path, cache_words)
    return _kept[path, cache_words]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece; a piece's ids are known by their crc32."""
    small_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = word_ids(path, cache_words)
        for batch in batches:
            for part in by_bytes(batch, 1, 256):
                rows = []
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                for doc, data in zip(part.column(0).to_pylist(), ids.encode(texts)):
                    data += tail
                    n = len(data) // 4
                    for k, s in enumerate(range(0, n, length)):
                        own = data[4 * s : 4 * (s + length)]
                        rows.append((doc, k, s, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES.types)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH, opening: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length in the order given.

    With N[g] open sequences of gap g, adding s to one of gap g changes the sum
    of squares by 2 (N[g-s] - N[g] + 1), or by 1 - 2 N[g] where it gets full; a new
    sequence changes it by 2 N[capacity-s] + 1. The smallest change wins. Ties: the
    smallest gap, an open sequence before a new one. Without ``opening`` a new
    sequence is no choice as long as any has room.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            sequence[i], made = made, made + 1
            continue
        here, g = count[s:capacity], capacity
        if here.any():
            change = 2 * (count[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = 1 << 60
            best = int(change.argmin())
            if not opening or change[best] <= 2 * count[capacity - s] + 1:
                g = best + s
        if g < capacity:
            b = open_at[g].pop()
            count[g] -= 1
        else:
            b, made = made, made + 1
        sequence[i], offset[i] = b, capacity - g
        if g > s:
            open_at[g - s].append(b)
            count[g - s] += 1
    return sequence, offset


def best_packing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The packing by :func:`sum_of_squares`, with ``opening`` or without, that
    needs fewer sequences."""
    found = sum_of_squares(lengths, capacity)
    if len(lengths) and found[0].max() + 1 > -(-int(lengths.sum()) // capacity):
        other = sum_of_squares(lengths, capacity, opening=False)
        if other[0].max() < found[0].max():
            return other
    return found


def pack(rows: DataFrame, capacity: int = LENGTH, per_task: int = PER_TASK) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length."""
    with Tables() as tables:
        rows = tables.cut(rows)
        tasks = -(-rows.count() // per_task) or 1

        def run(batches):
            t = pa.Table.from_batches(list(batches), schema=_PIECES)  # about per_task slim rows
            if not t.num_rows:
                return
            t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            sequence, offset = best_packing(t.column("length").to_numpy(), capacity)
            sequence += TaskContext.get().partitionId() << 40
            yield from t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

        return cut(rows.repartition(tasks).mapInArrow(run, PACKED))


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, cache_words: int = CACHE_WORDS) -> DataFrame:
    return pack(pieces(docs, path or tokenizer_path(), length, cache_words=cache_words), length)


def op2_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
