"""License scans against the plain table of edit distances, and exact phrases against a plain walk over the words."""

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex

from gridloom.llm import licenses, queries

SF = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def distance(text, notice):
    """The least edit distance of the notice to any part of the text that begins and ends at word bounds."""
    t = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    edge = np.ones(len(t) + 1, dtype=bool)
    edge[1:-1] = (t[1:] == 32) != (t[:-1] == 32)
    row = np.where(edge, 0, 10**6)
    steps = np.arange(len(row))
    row = np.minimum.accumulate(row - steps) + steps
    for i, c in enumerate(notice, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != ord(c)))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[edge].min())


def test_whole_table_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op11_fuzzy_licenses(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    seen = set()
    for d in docs:
        words, r = plain_words(d["text"]), got[d["doc_id"]]
        at, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            starts = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += starts
            base |= {label} if starts else set()
        joined, labels, score = " ".join(words), set(base), 1.0 if base else 0.0
        for n in licenses.NOTICES:
            if joined and (found := distance(joined, n.words)) <= n.errors:
                labels.add(n.label)
                score = max(score, 1 - found / len(n.words))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(labels)))
        assert r["score"] == pytest.approx(score)
        seen |= labels
    assert {"apache", "mit", "cc-by"} <= seen  # the small table holds no other


CASES = [
    (1, None, None),
    (2, "", None),
    (3, "# Licensed under\n# the Apahce  Lisence, Version 2.0 (the", "apache"),
    (4, "THE GNU GENERAL PUBIC LICENSE", "gpl"),
    (5, "Gnu Lesser Generall Public Licence v3", "lgpl"),
    (6, "emit license fees under the emitting body", None),
    (7, "Permission is hereby granted, free of charge, to any persons obtaining copies of this software", "mit"),
    (8, "redistribution in source form", None),
    (9, "été under the MIT licence – fin", "mit"),
    (9, "été under the MIT licence – fin", "mit"),
    (None, "x" * 300_000 + " mozilla public license", None),
    (12, "subject to terms of the Mozilla Public License", "mpl"),
]


def test_small_cases_and_other_columns(spark):
    docs = spark.createDataFrame([(k, t, "q") for k, t, _ in CASES], "id long, Words string, labels string")
    got = licenses.scan(docs, key="id", text="Words").collect()
    assert sorted((r["id"] or 0, r["labels"]) for r in got) == sorted((k or 0, label or "") for k, _, label in CASES)
    assert all(r["score"] == 0 for r in got if not r["labels"])
    found = licenses.spans(docs, key="id", text="Words").collect()
    texts = {k: t for k, t, _ in CASES}
    assert all(texts[r["id"]][r["begin"] : r["end"]] == r["found"] for r in found)
    one = next(r for r in found if r["id"] == 4)
    assert (one["found"], one["errors"]) == ("GNU GENERAL PUBIC LICENSE", 1)
    assert len([r for r in found if r["id"] == 9]) == 2


def test_every_error_within_the_bound_is_found():
    rng = np.random.default_rng(5)
    for n in [n for n in licenses.NOTICES if n.errors]:
        search = licenses.Search([n])
        for _ in range(40):
            text = list(n.words)
            for _ in range(n.errors):
                at = int(rng.integers(1, len(text) - 1))
                kind = rng.integers(3)
                if kind == 0:
                    text[at] = "z"
                elif kind == 1:
                    del text[at]
                else:
                    text.insert(at, "z")
            inside = f"some words {''.join(text)} more words"
            found = search(inside)
            want = distance(inside, n.words)
            assert want <= n.errors and min(f.errors for f in found) == want


def test_repeated_and_overlapping_notices():
    search = licenses.Search(licenses.NOTICES)
    text = " ".join(["gnu general public license"] * 50)
    assert [f.errors for f in search(text) if f.notice.words == "gnu general public license"] == [0] * 50
    assert licenses.places(b"cc by cc by x cc by", b"cc by") == [0, 2, 5]
    assert licenses.places(b"cc by", b"cc by") == [0] and licenses.places(b"", b"cc by") == []


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
