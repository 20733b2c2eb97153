"""The pipeline against a plain version of each stage, and the registry."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from moraine.llm import language, mixing, packing, quality
from moraine.llm.common import table
from tests.llm.test_operators import brute_components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_registry():
    names = entry.queries()
    assert [sum(bool(re.match(rf"op{n}_", q)) for q in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    stages, before = dict(corpus_pipeline.STAGES), docs

    def stage(name):
        path = str(tmp_path / name)
        stages[name](spark, before, DATA).write.parquet(path)
        return spark.read.parquet(path)

    rows = [tuple(r) for r in before.collect()]
    model = quality.fit(docs, table(spark, DATA, "labels"))
    score = model.score(np.array([quality.statistics((r[1] or "").encode()) for r in rows]))
    want = [r for r, s in zip(rows, score) if s >= quality.CUTOFF]
    before = stage("quality")
    assert before.columns == docs.columns and Counter(map(tuple, before.collect())) == Counter(want) and 0 < len(want) < len(rows)

    identifier = language.fit(before)
    names, scores = identifier.predict([(r[1] or "").encode() for r in want])
    want = [r for r, n, s in zip(want, names, scores) if n != "und" and s >= language.REJECT_BELOW]
    before = stage("language")
    assert before.columns == docs.columns and Counter(map(tuple, before.collect())) == Counter(want)

    found = brute_components(want, 5, 80)
    want = [r for r, (doc, n, first) in zip(want, found) if not n or doc == first]
    before = stage("near_duplicates")
    assert before.columns == docs.columns and Counter(map(tuple, before.collect())) == Counter(want)

    drawn = Counter({r["doc_id"]: len(r["_m_draws"]) for r in mixing.mix(before).collect()})
    before = stage("mixing")
    assert before.columns == docs.columns and Counter(r["doc_id"] for r in before.collect()) == +drawn
    texts = {r[0]: r[1] for r in want}

    packed = stage("packing").collect()
    ids, places, pieces = packing.WordIds(packing.tokenizer_path()), defaultdict(list), Counter()
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["piece"], r["ids_crc32"]] += 1
    expected = Counter()
    for doc, times in drawn.items():
        data = ids.encode([texts[doc] or ""])[0] + bytes(4)
        for k, at in enumerate(range(0, len(data), 4 * 2048)):
            expected[doc, k, zlib.crc32(data[at : at + 4 * 2048])] += times
    assert pieces == +expected
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [a for a, _ in sorted(p)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048

    again = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert again == pieces


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, DATA, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
