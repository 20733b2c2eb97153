"""Token counts by the whole-token shortcut.

A SentencePiece BPE model only ever joins neighbours whose characters stand side
by side in some piece of its vocabulary. From the vocabulary alone, before any text is
read, three things are proven:

* where two characters stand side by side in no piece, no token reaches across: a
  normalised text falls apart there, and its tokens are those of its parts. A part
  from a space to before the next one is a *pre-token*; it falls apart further
  at its other seams;
* which pieces, standing alone, are encoded as the one token that they are (a piece
  can be out of the merges' reach): the *whole tokens*;
* a character that joins nothing, behind which a part can be encoded without its
  context.

Counting is then a look-up: a pre-token that is a whole token counts one. Only the rest
is split at its seams, again looked up, and what is left is merged by the library;
numbers of pre-tokens seen before are remembered in a table of bounded size. The proofs are made once
on the driver and sent to the tasks as a set no larger than the vocabulary.

A model for which a proof fails (spaces inside pieces, no character that joins nothing), and
a part that the library's normaliser would change when it stands alone, is counted by the library as it is.

Texts are worked through in stretches of pre-tokens, whatever their length.

Edge cases: null and empty texts have no bytes and no tokens; equal and
repeated rows and null ids are counted one by one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import small_batches, table
from moraine.llm.packing import Remembered

LIMIT = 4096
CACHE, LONGEST = 500_000, 64  # pre-tokens remembered in a worker, and their greatest length
STRETCH = 1 << 16  # pre-tokens at a time
SPACE = "▁"  # what the normaliser makes of a space
_PRE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_whole", pa.int64())])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Proofs:
    """What a model's vocabulary proves: ``joined``, the pairs of characters that stand side by
    side in a piece; ``whole``, the pieces that are one token on their own; ``apart``, a
    character that joins nothing (None: there is none); ``spaces``, whether spaces only begin pieces."""

    def __init__(self, path: str):
        sp = _model(path)
        pieces = [p for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (p := sp.id_to_piece(i))]
        self.joined = frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))
        self.spaces = not any(pair[1] == SPACE != pair[0] for pair in self.joined) and not any(sp.is_unused(i) for i in range(sp.vocab_size()))
        inside = {c for pair in self.joined for c in pair}
        self.apart = next((c for c in "\n\x01\x02" if c not in inside and sp.normalize(c) == SPACE + c), None)
        whole = set()
        if self.spaces and self.apart is not None:
            alone = sp.encode(self.apart)
            begins = [p for p in pieces if p[0] == SPACE and sp.normalize(_plain(p[1:])) == p]
            inner = [p for p in pieces if p[0] != SPACE]
            whole |= {p for p, ids in zip(begins, sp.encode([_plain(p[1:]) for p in begins])) if [sp.piece_to_id(p)] == ids}
            whole |= {p for p, ids in zip(inner, sp.encode([self.apart + p for p in inner])) if [*alone, sp.piece_to_id(p)] == ids}
        self.whole = frozenset(whole)


def _plain(normalised: str) -> str:
    return normalised.replace(SPACE, " ")


class PieceCounter:
    """Counts tokens of texts with a model and its proofs."""

    def __init__(self, path: str, proofs: Proofs, cache: int = CACHE):
        self.sp, self.proofs = _model(path), proofs
        self.merged = Remembered(cache, self._merged)
        self.after = proofs.apart and len(self.sp.encode(proofs.apart))

    def parts(self, pre: str) -> list[str]:
        """A pre-token's parts between its seams."""
        joined, out, at = self.proofs.joined, [], 0
        for i in range(1, len(pre)):
            if pre[i - 1 : i + 1] not in joined:
                out.append(pre[at:i])
                at = i
        return [*out, pre[at:]]

    def _merged(self, pre: str) -> int:
        total = 0
        for part in self.parts(pre):
            if part in self.proofs.whole:
                total += 1
            elif part[0] == SPACE and self.sp.normalize(plain := _plain(part[1:])) == part:
                total += len(self.sp.encode(plain))
            elif part[0] != SPACE and self.sp.normalize(self.proofs.apart + part) == SPACE + self.proofs.apart + part:
                total += len(self.sp.encode(self.proofs.apart + part)) - self.after
            else:
                raise ValueError(part)  # can't stand alone
        return total

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens that were whole tokens) of a text."""
        if not text:
            return 0, 0
        if not self.proofs.whole:
            return len(self.sp.encode(text)), 0
        whole, rest, hits = self.proofs.whole, 0, 0
        found = _PRE.finditer(self.sp.normalize(text))
        try:
            while pre := [m.group() for m in islice(found, STRETCH)]:
                left = [p for p in pre if p not in whole]
                hits += len(pre) - len(left)
                rest += sum(self.merged[p] if len(p) <= LONGEST else self._merged(p) for p in left)
        except ValueError:
            return len(self.sp.encode(text)), 0
        return hits + rest, hits


_kept: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_bytes, n_tokens, over_limit and
    n_whole, how many of its pre-tokens were whole tokens."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    proofs = docs.sparkSession.sparkContext.broadcast(Proofs(path))  # no larger than the vocabulary

    def run(batches):
        if path not in _kept:  # one per Python worker, so that tasks go on with what others remembered
            _kept[path] = PieceCounter(path, proofs.value)
        count = _kept[path].count
        for b in batches:
            rows = []
            for v in b.column(1):
                text = v.as_py() or ""
                rows.append((len(text) if text.isascii() else len(text.encode()), *count(text)))
            sizes, tokens, whole = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(whole, pa.int64())], schema=_COUNTS)

    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_whole long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")


def op12_whole_token_shortcut(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
