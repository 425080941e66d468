"""The audit against a plain version on hard rows; the whole query is held against its SQL in test_oracles."""

from collections import Counter, defaultdict

import pytest

from gridloom.llm import divergence
from gridloom.llm.words import TERM, words

ROWS = [
    ("en", "a", "one two two three"), ("en", "a", "one two THREE"), ("en", "b", "one one one two"), ("en", "c", None), ("en", "c", ""), ("en", "c", "three 12 one"),
    ("en", None, "two Two tWo éa"), ("en", None, "éa éa"), ("en", "b", "éa " * 2000), ("en", "b", "x" * 40_000), ("en", "hot", "one two three éa " * 500),
    ("de", "a", "nur hier"), ("de", "b", None), (None, "a", "leer leer"), (None, "a", "leer"), (None, "b", "leer"), ("fr", "a", None), *[("es", f"s{i:03d}", "uno dos") for i in range(300)], ("es", "s000", "uno uno"),
]


def plain(rows, least=3, most=200):
    of = [((lang or "", source or ""), [w.decode() for w in words((text or "").encode(), TERM)]) for lang, source, text in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source), w in of:
        docs[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = sorted(g[1] for g in counts if g[0] == lang)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in groups}
        q = share(sum((counts[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [256, 64])
def test_audit_equals_the_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)  # 300 sources of one language are several blocks
    docs = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "lang string, source string, text string, value int, term string")
    got = sorted(tuple(r) for r in divergence.audit(docs, most_terms=2).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain(ROWS, most=2)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
