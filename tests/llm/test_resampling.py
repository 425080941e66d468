"""Importance resampling against a plain version; the whole query is held against its SQL in test_oracles."""

import math
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from gridloom.llm import resampling
from gridloom.llm.words import WORD, ngrams, words

LONG = "alpha beta gamma delta " * 30
DOCS = [(1, None), (2, ""), (3, "rare one"), (4, LONG), (5, LONG), (5, LONG), (None, LONG), (None, "beta " * 25), (7, "Éa éa ÉA " * 12), (8, "w" * 5000 + " " + "v " * 40), (9, " ".join(f"w{i}" for i in range(400)))]
TARGET = ["alpha beta", None, "w1 w2 w3 beta", ""]


def plain(low, high, buckets):
    of = lambda t: [g.decode() for g in ngrams(words((t or "").encode(), WORD), low, high)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in DOCS:
        s.update(map(bucket, of(text)))
    for text in TARGET:
        t.update(map(bucket, of(text)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for key, text in DOCS:
        weight = sum(gain(bucket(f)) for f in of(text))
        h = int(sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words((text or "").encode()))))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, fit


@pytest.mark.parametrize(("low", "high", "heavy"), [(1, 1, 20_000), (1, 2, 20_000), (1, 1, 3), (2, 3, 1)])
def test_weights_scores_and_ranks(spark, monkeypatch, low, high, heavy):
    monkeypatch.setattr(resampling, "HEAVY", heavy)  # with 1 nearly all features go through the join
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in DOCS], "doc_id long, text string, weight int, rank string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs, target, percent=50, low=low, high=high, buckets=97).collect()
    rows, fit = plain(low, high, 97)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted((r[:4] for r in rows), key=key)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(fit) // 2 + 1))
    assert [(r["doc_id"], r["score"]) for r in drawn] == [(r[0], r[3]) for r in fit[: len(fit) // 2]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b " * 10)], "doc_id long, text string")
    assert [(r["n_features"], r["rank"]) for r in resampling.resample(one, none, percent=100).collect()] == [(20, 1)]


def test_the_session_keeps_its_setting(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 7777)
    try:
        resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"))
        assert spark.conf.get(name) == "7777"
    finally:
        spark.conf.unset(name)
