"""Language identification by a bidirectional gated recurrent network on bytes.

A text's bytes (A-Z lower-cased) are cut into windows of ``span`` positions. Two
gated recurrent units, one in each direction, read every window; each position
gets class probabilities from both states, and a document's probabilities are
the mean over all its letter positions. Nothing of a text is skipped.

The network is trained here in numpy by backpropagation through time on a
bounded sample: about ``per_language`` documents of each language, chosen by a
hash of id and text, and at most ``windows`` windows of each, drawn from its whole text
(documented bounds of the training sample; a long text has more). It has about
13,000 weights, so it travels with the task. Gates use the softsign curve in place of
the logistic one, which costs a third of the time.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
documents without a language are never learned from; without any language to
learn every document is ``und``; with a single one all get it with score 1;
equal texts get equal results; an empty table gives no rows; other columns are
ignored or pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moraine.llm.common import by_bytes, encoded, hash_unit, held_out, small_batches, table

SPAN, HIDDEN, STEPS, BATCH = 48, 8, 350, 256
PER_LANGUAGE, WINDOWS, SEED = 400, 64, 5
UNKNOWN = "und"
REJECT_BELOW = 0.35

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, np.float32)
_LETTER[97:123] = 1
_LETTER[128:] = 1


def _soft(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    np.divide(x, d, out=x)
    return x


class Network:
    """Weights: byte table ``e`` (256, 3H), recurrent ``u`` (H, 3H) for each
    direction; output ``v`` (2H, C) and ``c``. Column blocks: update, reset, new."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w["e" + d] = rng.normal(0, 0.5, (256, 3 * hidden)).astype(np.float32)
            self.w["u" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.w["v"] = rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
        self.w["c"] = np.zeros(classes, np.float32)

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each position; ``x``: (T, N) bytes."""
        h, (t, n), e, u = self.h, x.shape, self.w["e" + d], self.w["u" + d]
        out = np.empty((t, n, h), np.float32)
        s = np.zeros((n, h), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, g = e.take(x[i], 0), s @ u
            gates = _soft(a[:, : 2 * h] + g[:, : 2 * h])
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = r * g[:, 2 * h :]
            new += a[:, 2 * h :]
            _soft(new)
            if keep is not None:
                keep.append((i, s, z, r, new, g[:, 2 * h :]))
            s = new + z * (s - new)
            out[i] = s
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, N, C) class probabilities of each position."""
        t, n = x.shape
        y = self._states(x, "f").reshape(t * n, -1) @ self.w["v"][: self.h]
        y += self._states(x, "b").reshape(t * n, -1) @ self.w["v"][self.h :]
        y += self.w["c"]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y.reshape(t, n, -1)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over letter positions, and its gradients."""
        h, (t, n) = self.h, x.shape
        kept = {"f": [], "b": []}
        states = np.concatenate([self._states(x, d, kept[d]) for d in "fb"], 2)
        y = states.reshape(t * n, -1) @ self.w["v"] + self.w["c"]
        y -= y.max(1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(1, keepdims=True)
        weight = _LETTER[x].reshape(-1) / max(_LETTER[x].sum(), 1)
        hit = np.tile(label, t)
        at = np.arange(t * n)
        loss = float(-(np.log(p[at, hit] + 1e-9) * weight).sum())
        p[at, hit] -= 1
        p *= weight[:, None]
        grad = {"v": states.reshape(t * n, -1).T @ p, "c": p.sum(0)}
        into = (p @ self.w["v"].T).reshape(t, n, 2 * h)
        order = np.argsort(x.reshape(-1), kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(x.reshape(-1)[order].astype(np.int64)) > 0])
        for k, d in enumerate("fb"):
            u, ds = self.w["u" + d], np.zeros((n, h), np.float32)
            du, da = np.zeros_like(u), np.empty((t, n, 3 * h), np.float32)
            for i, s, z, r, new, g in reversed(kept[d]):
                ds = ds + into[i, :, k * h : (k + 1) * h]
                dz = ds * (s - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dn = ds * (1 - z) * (1 - np.abs(new)) ** 2
                dr = dn * g * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                da[i] = np.concatenate([dz, dr, dn], 1)
                dg = np.concatenate([dz, dr, dn * r], 1)
                du += s.T @ dg
                ds = ds * z + dg @ u.T
            grad["u" + d] = du
            rows = np.add.reduceat(da.reshape(t * n, -1)[order], first, axis=0)
            grad["e" + d] = np.zeros_like(self.w["e" + d])
            grad["e" + d][x.reshape(-1)[order][first]] = rows
        return loss, grad


def train(windows: np.ndarray, label: np.ndarray, classes: int, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> Network:
    """Adam on windows (M, T) of bytes, classes drawn evenly."""
    net, rng = Network(classes, seed=seed), np.random.default_rng(seed)
    own = [np.flatnonzero(label == k) for k in range(classes)]
    own = [x for x in own if len(x)]
    m = {k: np.zeros_like(w) for k, w in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, -(-batch // len(own))) for x in own])
        _, grad = net.gradients(np.ascontiguousarray(windows[pick].T), label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1 / (norm + 1e-9))
        for k, g in grad.items():
            g = g * min(1.0, 1 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.w[k] = (net.w[k] - rate / min(1.0, 1 / (norm + 1e-9)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def cut_windows(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(W, span) lower-cased bytes, zero-padded, and the windows of each text."""
    counts = np.array([-(-len(t) // span) for t in texts], np.int64)
    flat = np.zeros(int(counts.sum()) * span, np.uint8)
    for t, at in zip(texts, np.r_[0, np.cumsum(counts)] * span):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return _LOWER[flat].reshape(-1, span), counts


class Identifier:
    """A trained network and the names of its classes."""

    def __init__(self, names: list[str], net: Network | None):
        self.names, self.net = names, net

    def predict(self, texts: list[bytes], block: int = 2048) -> tuple[list[str], list[float]]:
        windows, counts = cut_windows(texts)
        if self.net is None or not len(windows):
            sums = np.zeros((len(texts), max(len(self.names), 1)))
        else:
            sums = np.empty((len(windows), len(self.names)))
            for at in range(0, len(windows), block):
                x = np.ascontiguousarray(windows[at : at + block].T)
                sums[at : at + block] = np.einsum("tnc,tn->nc", self.net.probabilities(x), _LETTER[x])
            ends = np.cumsum(counts)
            total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)])
            sums = total[ends] - total[ends - counts]
        names, scores = [], []
        for t, s in zip(texts, sums):
            mass = s.sum()
            if not self.names or not (mass > 0 or self.net is None) or not any(c.isalpha() for c in t.decode("utf-8", "replace")):
                names.append(UNKNOWN)
                scores.append(0.0)
            elif self.net is None:
                names.append(self.names[0])
                scores.append(1.0)
            else:
                k = int(s.argmax())
                names.append(self.names[k])
                scores.append(min(1.0, float(s[k] / mass)))
        return names, scores


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, span: int = SPAN, seed: int = SEED) -> Identifier:
    """Learn from text and lang of ``docs``; rows without either are left out.
    Equal windows of a language count once, so repeated rows don't swell the sample."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect())  # one row a language
    names = [n for n, _ in counts]
    if len(names) < 2:
        return Identifier(names, None)
    shares = docs.sparkSession.createDataFrame([(n, i, per_language / c) for i, (n, c) in enumerate(counts)], "lang string, k int, share double")
    some = rows.join(F.broadcast(shares), "lang").where(hash_unit(F.lit(seed), F.col("doc_id"), F.col("text")) < F.col("share")).select("doc_id", "text", "k")

    def run(batches):
        for b in batches:
            out = []
            for doc, text, k in zip(b.column(0).to_pylist(), encoded(b.column(1)), b.column(2).to_pylist()):
                own, _ = cut_windows([text], span)
                if len(own):
                    for i in np.random.default_rng([seed, (doc or 0) % (1 << 32)]).permutation(len(own))[:windows]:
                        out.append((k, own[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["k", "w"])

    got = some.mapInArrow(run, "k int, w binary").distinct().toPandas().sort_values(["k", "w"])
    x = np.frombuffer(b"".join(got["w"]), np.uint8).reshape(-1, span)
    return Identifier(names, train(x, got["k"].to_numpy(np.int64), len(names), seed=seed) if len(x) else None)


def identify(docs: DataFrame, model: Identifier, keep=None) -> DataFrame:
    """``docs`` with lang_pred and score (names that clash with a column get the
    prefix ``_m_``); with ``keep(name, score)`` only the rows for which it holds."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    names = [f"_m_{c}" if c in docs.columns else c for c in ("lang_pred", "score")]
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{names[0]}` string, `{names[1]}` double").fields])

    def run(batches):
        for whole in batches:
            for b in by_bytes(whole, at, 512):
                lang, score = model.predict(encoded(b.column(at)))
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(f"c{i}" for i in range(b.num_columns)), *names])
                yield out if keep is None else out.filter(pa.array([keep(n, s) for n, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def _clear(name: str, score: float) -> bool:
    return name != UNKNOWN and score >= REJECT_BELOW


def filter_language(docs: DataFrame) -> DataFrame:
    """Documents of a recognised language, their columns unchanged. Rejected:
    texts without a letter and texts that no language fits clearly."""
    out = identify(docs, fit(docs), _clear)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_byte_recurrent_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id", 5, 0)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
