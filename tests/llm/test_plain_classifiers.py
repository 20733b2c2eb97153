"""The language network and the quality discriminant against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from moraine.llm import language, quality


def softsign(x: float) -> float:
    return x / (1 + abs(x))


def plain_states(w: dict, d: str, data: list[int], h: int) -> list[list[float]]:
    """One direction of the recurrence, number by number."""
    s, out = [0.0] * h, [None] * len(data)
    for i in range(len(data)) if d == "f" else reversed(range(len(data))):
        a = [float(v) for v in w["e" + d][data[i]]]
        g = [sum(s[j] * float(w["u" + d][j][k]) for j in range(h)) for k in range(3 * h)]
        z = [0.5 + 0.5 * softsign(a[k] + g[k]) for k in range(h)]
        r = [0.5 + 0.5 * softsign(a[h + k] + g[h + k]) for k in range(h)]
        new = [softsign(a[2 * h + k] + r[k] * g[2 * h + k]) for k in range(h)]
        s = [z[k] * s[k] + (1 - z[k]) * new[k] for k in range(h)]
        out[i] = s
    return out


def plain_prediction(net: language.Network, text: bytes, classes: int) -> list[float]:
    """Mean class probabilities over the letters of all windows."""
    total, letters = [0.0] * classes, 0
    low = [c + 32 if 65 <= c <= 90 else c for c in text]
    for at in range(0, len(low), language.SPAN):
        window = low[at : at + language.SPAN]
        window += [0] * (language.SPAN - len(window))
        forth, back = (plain_states(net.w, d, window, net.h) for d in "fb")
        for c, f, b in zip(window, forth, back):
            if 97 <= c <= 122 or c >= 128:
                y = [sum(v * float(net.w["v"][j][k]) for j, v in enumerate([*f, *b])) + float(net.w["c"][k]) for k in range(classes)]
                e = [math.exp(v - max(y)) for v in y]
                total = [t + v / sum(e) for t, v in zip(total, e)]
                letters += 1
    return [t / letters for t in total]


def test_network_equals_a_plain_forward_pass():
    r = random.Random(2)
    net = language.Network(3, hidden=4, seed=9)
    net.w["c"][:] = [0.1, -0.2, 0.05]
    model = language.Identifier(["x", "y", "z"], net)
    texts = ["".join(r.choice("abcdefgABC é,.1 \n") for _ in range(n)) + "q" for n in (1, 30, 47, 48, 150)]
    names, scores = model.predict([t.encode() for t in texts], block=2)
    for t, name, score in zip(texts, names, scores):
        want = plain_prediction(net, t.encode(), 3)
        assert name == "xyz"[want.index(max(want))] and score == pytest.approx(max(want), abs=1e-5)
    assert model.predict([b"", b"12 34", b"   "])[0] == ["und"] * 3


def plain_statistics(data: bytes) -> list[float]:
    """Counted byte by byte and word by word."""
    n, words, lines = len(data), data.split(), [x for x in data.split(b"\n") if x]
    share = [math.sqrt(sum(b in set(own) for b in data) / max(n, 1)) for own in quality._CLASSES.values()] + [math.sqrt(sum(b >= 128 for b in data) / max(n, 1))]
    visible = sum(b not in (32, 10) for b in data)
    return [
        *share, math.log(1 + n), math.log(1 + len(words)), math.log(1 + visible / max(len(words), 1)), math.log(1 + max([len(w) for w in words] or [0])),
        math.log(1 + len(set(words))) / math.log(1 + len(words)) if words else 0.0, math.sqrt(len(set(lines)) / len(lines)) if lines else 0.0,
        math.log(1 + len(words) / max(len(lines), 1)), math.sqrt(sum(w.isalpha() for w in set(words)) / max(len(set(words)), 1)),
    ]


def test_statistics_equal_plain_counts():
    r = random.Random(7)
    for n in (0, 1, 5, 200):
        text = "".join(r.choice("abcXYZ 012,.!#|\"é\n\n  ") for _ in range(n)).encode()
        assert quality.statistics(text) == pytest.approx(plain_statistics(text), rel=1e-12)
    assert len(plain_statistics(b"")) == quality.WIDTH


def test_scores_equal_plain_densities():
    """Each class's normal density from its whole covariance, its determinant and a solved system."""
    g = np.random.default_rng(4)
    y = (g.random(400) < 0.4).astype(float)
    x = g.normal(size=(400, quality.WIDTH)) * (1 + y[:, None] * np.linspace(0, 2, quality.WIDTH)) + y[:, None]
    model = quality.Discriminant(x, y, g.random(400) < 0.2)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    own = []
    for k in (0, 1):
        d = z[y == k] - z[y == k].mean(0)
        own.append(d.T @ d / len(d))
    pooled = ((y == 0).sum() * own[0] + (y == 1).sum() * own[1]) / len(y)
    log = []
    for k in (0, 1):
        s = (1 - model.pool) * own[k] + model.pool * pooled
        s = (1 - model.ridge) * s + model.ridge * np.trace(s) / len(s) * np.eye(len(s))
        d = z - z[y == k].mean(0)
        log.append(-0.5 * np.einsum("ij,ji->i", d, np.linalg.solve(s, d.T)) - 0.5 * np.linalg.slogdet(s)[1])
    difference = np.clip((log[1] - log[0]) / quality.WIDTH, -50, 50)
    want = 1 / (1 + np.exp(-np.clip(model.a * difference + model.b, -30, 30)))
    assert np.allclose(model.score(x), want, atol=1e-10) and ((want > 0.5) == (y == 1)).mean() > 0.85
    assert model.a > 0 and model.pool in quality.POOLS and model.ridge in quality.RIDGES
