"""Quality classifier: regularised quadratic discriminant on text statistics.

Each document becomes a short vector of variance-stabilised statistics of its
whole text (sizes, byte classes, word and line repetition). Each class has a
mean and a covariance shrunk towards the pooled one (``pool``) and towards a
multiple of the identity (``ridge``); both are chosen on a fold of the training
rows. The score is the difference of the classes' Mahalanobis log densities,
from Cholesky factors inverted once per model, mapped to 0..1 by a two-parameter
logistic fit on the same fold.

The fit uses about ``max_rows`` labelled rows, chosen by hash (a documented
bound, default 20,000; no more than the hash's share of it varies); labels are broadcast to the scan, so only statistics of
labelled documents come back. Scoring is one pass of Arrow batches.

Edge cases: null and empty texts have the statistics of an empty text and get a
score; contradictory labels of a document both count; without two classes among
the labels every score is the share of ones (0.5 without labels); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import by_bytes, crc_mod, encoded, hash_unit, held_out, table

MAX_ROWS, CUTOFF = 20_000, 0.3
POOLS, RIDGES = (0.02, 0.1, 0.3, 0.6), (0.001, 0.01, 0.05)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "symbol": b"#$%&*@^~=+_<>{}[]\\/|`",
    "bar": b"|",
    "quote": b"\"'()-",
}
_MASK = np.zeros((256, len(_CLASSES) + 1), np.float64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _MASK[list(_bytes), _i] = 1
_MASK[128:, -1] = 1
WIDTH = 17


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one text."""
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.sqrt(counts @ _MASK / max(n, 1)).tolist()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    w, distinct = len(words), set(words)
    long = max(map(len, words), default=0)
    plain = sum(1 for x in distinct if x.isalpha())
    return [
        *share,
        np.log1p(n),
        np.log1p(w),
        np.log1p((n - counts[32] - counts[10]) / max(w, 1)),
        np.log1p(long),
        np.log1p(len(distinct)) / np.log1p(max(w, 1)) if w else 0.0,
        np.sqrt(len(set(lines)) / len(lines)) if lines else 0.0,
        np.log1p(w / max(len(lines), 1)),
        np.sqrt(plain / max(len(distinct), 1)),
    ]


class Discriminant:
    """Fitted classes; ``score`` maps statistics (rows) to 0..1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.rows, self.share = len(y), float(y.mean()) if len(y) else 0.5
        self.classes = None
        if min((y == 0).sum(), (y == 1).sum()) < 2:
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.scale
        rest = ~fold if min((y[~fold] == k).sum() for k in (0, 1)) > 1 and len(set(y[fold])) == 2 else np.ones(len(y), bool)
        test = fold if rest.sum() < len(y) else rest
        best = None
        for pool in POOLS:
            for ridge in RIDGES:
                classes = self._fit(z[rest], y[rest], pool, ridge)
                d = self._difference(z[test], classes)
                a, b = self._logistic(d, y[test])
                p = np.clip(1 / (1 + np.exp(-np.clip(a * d + b, -30, 30))), 1e-9, 1 - 1e-9)
                loss = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))
                if best is None or loss < best[0]:
                    best = (loss, pool, ridge, a, b)
        self.loss, self.pool, self.ridge, self.a, self.b = best
        self.classes = self._fit(z, y, self.pool, self.ridge)

    @staticmethod
    def _fit(z, y, pool, ridge):
        means = [z[y == k].mean(0) for k in (0, 1)]
        own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
        n = [(y == k).sum() for k in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
        out = []
        for k in (0, 1):
            s = (1 - pool) * own[k] + pool * pooled
            s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            out.append((means[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum()))
        return out

    @staticmethod
    def _difference(z, classes):
        density = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - logdet for m, inv, logdet in classes]
        return np.clip((density[1] - density[0]) / z.shape[1], -50, 50)

    @staticmethod
    def _logistic(d, y):
        """Slope (kept positive) and intercept by Newton steps."""
        x, beta = np.c_[d, np.ones(len(d))], np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            beta = beta + np.linalg.solve(h, x.T @ (y - p) - 1e-3 * beta)
        return max(float(beta[0]), 1e-3), float(beta[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        d = self._difference((x - self.centre) / self.scale, self.classes)
        return 1 / (1 + np.exp(-np.clip(self.a * d + self.b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Discriminant:
    """Learn from (doc_id, quality) of ``labels`` and the texts of ``docs``. If
    more than ``max_rows`` labels or labelled documents are found, a share of them is chosen by hash."""
    labels = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("_m_y")).distinct()
    n = labels.count()
    if n > max_rows:
        labels = labels.where(hash_unit(F.lit(3), F.col("doc_id")) < max_rows / n)
    found = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "text", "_m_y")
    m = docs.select("doc_id").join(F.broadcast(labels), "doc_id").count()
    if m > 2 * max_rows:  # ids are repeated
        found = found.where(hash_unit(F.lit(4), F.col("doc_id"), F.col("text")) < max_rows / m)

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in encoded(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # rows that are equal in id and statistics count once
    got = found.mapInArrow(run, "doc_id long, y int, x array<double>").distinct().withColumn("fold", crc_mod("doc_id", 5) == 1).toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda i: (got["doc_id"].iat[i], got["y"].iat[i], tuple(got["x"].iat[i])))]
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), WIDTH)
    return Discriminant(x, got["y"].to_numpy(np.float64), got["fold"].to_numpy(bool))


def score(docs: DataFrame, model: Discriminant, column: str = "score", keep: float | None = None) -> DataFrame:
    """``docs`` with a score column; with ``keep``, only rows of that score or
    more. Needs a text column; all others pass through."""
    at = docs.columns.index("text")
    schema = f"`{column}` double"

    def run(batches):
        for b in chain.from_iterable(by_bytes(whole, at, 512) for whole in batches):
            x = np.array([statistics(t) for t in encoded(b.column(at))]).reshape(b.num_rows, WIDTH)
            s = model.score(x)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*(f"c{i}" for i in range(b.num_columns)), column])
            yield out if keep is None else out.filter(pa.array(s >= keep))

    from pyspark.sql.types import StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(schema).fields]))


def filter_quality(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Documents that the classifier doesn't reject, their columns unchanged."""
    return score(docs, fit(docs, labels), "_m_score", cutoff).drop("_m_score")


def op3_quadratic_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"))
