"""Yinyang clusters, token counts and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from moraine.llm import periodic, token_counts, yinyang

TEXTS = "doc_id long, text string, runs string, n_tokens string, words string"
VECTORS = "vec_id long, embedding array<float>, label string, cluster string, codes string"


# ---- 11: centroid clustering


def cloud() -> list[tuple]:
    g = np.random.default_rng(2)
    centres = g.normal(0, 1, (6, 4))
    rows = [(i, (centres[i % 6] + g.normal(0, 0.3, 4)).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5, 0.25, -0.5, 1.0]) for i in range(60)]  # equal vectors
    rows += [(500, None), (501, []), (502, [1.0, 2.0, 3.0]), (503, [1.0, None, 1.0, 1.0]), (504, [1.0, float("nan"), 1.0, 1.0]), (505, [float("-inf"), 1.0, 1.0, 1.0])]
    rows += [rows[0], rows[0], (None, [0.1, 0.2, 0.3, 0.4]), (600, [0.0] * 4), (601, [-0.0] * 4)]
    return [(i, v, "x", "clash", None) for i, v in rows]


def plain_clusters(rows, k, rounds, dims, scale=256, seed="2:"):
    kept = [(i, [int(np.floor(scale * float(np.float32(e)))) for e in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), b"".join(e.to_bytes(4, "little", signed=True) for e in r[1]))
    c = [list(x) for _, x in sorted(kept, key=key)[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(c)):
            members = [x for (_, x), o in zip(kept, own) if o == j]
            if members:
                c[j] = [sum(e) // len(members) for e in zip(*members)]
    told = [(i, *nearest(x)) for i, x in kept]
    whole = sum(d for _, d, _ in told)
    return [(i, j, d, sum(e for _, e, o in told if o == j), whole, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in told]


@pytest.mark.parametrize("k, rounds", [(12, 5), (40, 3), (1, 2), (25, 0), (1000, 2)])
def test_yinyang_equals_measuring_all(spark, k, rounds):
    rows = cloud()
    got = yinyang.yinyang_clusters(spark.createDataFrame(rows, VECTORS).repartition(3), k, rounds, dims=4).drop("centroid")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_clusters(rows, k, rounds, 4), key=str)


def test_bounds_spare_distances_and_change_nothing():
    g = np.random.default_rng(5)
    middle = g.integers(-400, 400, (30, 8))
    x = (middle[g.integers(0, 30, 5000)] + g.integers(-60, 60, (5000, 8))).astype(np.int64)
    c = x[:30].copy()
    group = yinyang.centroid_groups(c)
    assert sorted(set(group)) == list(range(group.max() + 1)) and group.max() >= 1
    cluster, upper, lower = yinyang.first_bounds(x, c, group)
    measured = []
    for _ in range(6):
        after = np.stack([np.floor_divide(x[cluster == j].sum(0), (cluster == j).sum()) if (cluster == j).any() else c[j] for j in range(30)])
        drift = np.sqrt(((after - c) ** 2).sum(1).astype(float)) * (1 + 1e-12)
        c = after
        cluster, upper, lower, n = yinyang.next_bounds(x, c, drift, group, cluster, upper, lower)
        true = yinyang.squares(x, c)
        assert (cluster == true.argmin(1)).all()
        assert (upper**2 >= true[np.arange(len(x)), cluster] * (1 - 1e-9)).all()
        others = true.astype(float)
        others[np.arange(len(x)), cluster] = np.inf
        least = np.sqrt(np.stack([others[:, group == h].min(1) for h in range(group.max() + 1)], 1))
        assert (lower <= least).all()
        measured.append(n)
    assert max(measured[1:]) < 30 * len(x) / 2


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [float(3e5 + 0.5 * i), -4e5]) for i in range(20)]
    got = yinyang.yinyang_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 2, dims=2).drop("centroid")
    assert sorted(map(tuple, got.collect())) == sorted(plain_clusters(rows, 3, 2, 2))
    with pytest.raises(Exception, match="64 bits"):
        yinyang.yinyang_clusters(spark.createDataFrame([(1, [1e7, 0.0])], "vec_id long, embedding array<double>"), 3, 2, dims=2)


def test_clusters_of_nothing(spark):
    got = yinyang.yinyang_clusters(spark.createDataFrame([(1, None, "x", None, None)], VECTORS))
    assert got.count() == 0 and got.columns[0] == "vec_id"


# ---- 12: token counts


def awkward_texts() -> list[str | None]:
    r = random.Random(4)
    letters = [chr(c) for c in [*range(0, 0x180), 0x2581, 0x3A3, 0x301, 0x4E2D, 0x1F600, 0x2028, 0x3000, 0x660, 0xFF21, 0xFB01]]
    out = [None, "", " ", "   ", "\n", " a  b ", "▁x ▁", "<s> hi </s><unk><0x41>", "x" * 20_000, "中" * 5000, "word, word. (word) 3.14" * 3, "a" * 70 + " b"]
    return out + ["".join(r.choice(letters) if r.random() < 0.6 else r.choice([" the", "ing", " (", "print", "  "]) for _ in range(r.randint(0, 60))) for _ in range(400)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    rows = [(i, t, "clash", "clash", None) for i, t in enumerate(awkward_texts())] + [(None, "no id", "", "", ""), (3, "twice", "", "", ""), (3, "twice", "", "", "")]
    got = token_counts.token_counts(spark.createDataFrame(rows, TEXTS).repartition(3), limit=20).drop("n_whole")
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 20) for i, t, *_ in rows for n in [len(sp.encode(t or ""))]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(spark.createDataFrame([], TEXTS)).count() == 0


def test_long_text_in_stretches(monkeypatch):
    counter = token_counts.PieceCounter(token_counts.tokenizer_path(), token_counts.Proofs(token_counts.tokenizer_path()), cache=10)
    text = " ".join(f"word{i % 97}, and the rest\n" for i in range(20_000))
    want = len(counter.sp.encode(text))
    assert counter.count(text)[0] == want
    monkeypatch.setattr(token_counts, "STRETCH", 7)
    assert counter.count(text)[0] == want


def test_proofs_hold():
    proofs = token_counts.Proofs(token_counts.tokenizer_path())
    counter = token_counts.PieceCounter(token_counts.tokenizer_path(), proofs)
    assert proofs.spaces and proofs.apart == "\n" and len(proofs.whole) > 30_000
    assert counter.count("the")[1] == 1 and counter.parts("▁word,x") != ["▁word,x"]
    assert all(counter.count(p[1:].replace("▁", " "))[0] == 1 for p in sorted(proofs.whole)[:2000] if p[0] == "▁")


def test_a_model_without_proofs_is_counted_by_the_library():
    proofs = token_counts.Proofs(token_counts.tokenizer_path())
    proofs.whole = frozenset()
    counter = token_counts.PieceCounter(token_counts.tokenizer_path(), proofs)
    assert [counter.count(t or "") for t in awkward_texts()] == [(len(counter.sp.encode(t or "")), 0) for t in awkward_texts()]


# ---- 13: periodic runs


def plain_runs(x, least=24, exponent=3):
    found = {}
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i < len(x) - q:
            s = i
            while i < len(x) - q and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(least, exponent * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences(seed: int, n: int):
    g = np.random.default_rng(seed)
    for _ in range(n):
        x = g.integers(0, int(g.choice([1, 2, 3, 10, 100])), int(g.integers(0, 300)))
        for _ in range(int(g.integers(0, 4))):
            if len(x) > 10:
                a = int(g.integers(0, len(x)))
                p, m = 1 + int(g.integers(0, (len(x) - a) // 3 + 1)), int(g.integers(0, len(x) - a + 1))
                for i in range(a, a + m):
                    x[i] = x[a + (i - a) % p]
        if len(x) and g.random() < 0.3:
            x[int(g.integers(0, len(x)))] = 999
        yield x


@pytest.mark.parametrize("least, exponent", [(24, 3), (10, 2), (1, 2), (5, 4), (40, 3), (2, 7)])
def test_runs_equal_brute_force(least, exponent):
    seen = 0
    for x in sequences(least * 10 + exponent, 150):
        want = plain_runs(x.tolist(), least, exponent)
        assert periodic.runs(x, least, exponent) == want
        seen += len(want)
    assert seen > 20


def test_nested_runs_of_several_scales():
    u, v = [1, 2, 3] * 12, [7, 8, 9, 7, 8]
    x = np.array((u + v) * 4 + [5] * 30 + list(range(100, 150)) * 3)
    want = plain_runs(x.tolist())
    assert periodic.runs(x) == want and {q for _, _, q in want} >= {1, 3, 41, 50}


def test_long_texts_of_one_word_are_one_run():
    words = [b"x"] * 300_000
    found = periodic.runs(periodic.numbered(words))
    assert found == [(0, 300_000, 1)] and periodic.collapsed(words, found) == "x"


def plain_op13(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_op13_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    some = ["é", "A", "a", "b,", " ", " ", "c"]
    rows = [(i, " ".join(r.choice(some) for _ in range(r.randint(0, 200))), "clash", "clash", None) for i in range(150)]
    rows += [(200, None, "", "", ""), (201, "", "", "", ""), (202, " \t\n\x0b", "", "", ""), (None, "b a " * 20, "", "", ""), (203, "one two three " * 30, "", "", ""), rows[4], rows[4]]
    rows += [(i, "one two three four five six seven eight " * 4, "", "", "") for i in range(300, 400)]
    spark.createDataFrame(rows, TEXTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op13_block_matching_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes[:6])
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_op13(i, t) for i, t, *_ in rows), key=str)
    assert periodic.periodic_runs(spark.createDataFrame([], TEXTS)).count() == 0
