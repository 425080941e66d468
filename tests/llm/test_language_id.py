import zlib

import numpy as np

from gridloom.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_rank_order_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(held) > 100 and np.mean(held) >= 0.97


def brute_counts(text, max_n):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = {}
    for word in words:
        out_of = list(word)
        padded = f" {word} "
        for c in out_of:
            out[c] = out.get(c, 0) + 1
        for n in range(2, max_n + 1):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if " " not in gram[1:-1]:
                    out[gram] = out.get(gram, 0) + 1
    return out


def value(gram):
    """The number that stands for an n-gram and breaks ties between equal counts."""
    out = 0
    for c in gram:
        out = (out * 0xD6E8FEB86659FD93 + (1 if c == " " else ord(c) + 1)) % (1 << 64)
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_predictions(rows, max_n=3, most=400):
    """Predictions of all texts by dictionaries: profiles of labelled texts outside the fold, then the sum of places out of place."""
    profiles = {}
    for lang in sorted({lang for _, _, lang in rows if lang is not None}):
        total = {}
        for doc_id, text, of in rows:
            if of == lang and zlib.crc32(str(doc_id).encode()) % 4 != 2:
                for g, n in brute_counts(text or "", max_n).items():
                    total[g] = total.get(g, 0) + n
        order = sorted(total, key=lambda g: (-total[g], signed(value(g))))[:most]
        profiles[lang] = {g: i for i, g in enumerate(order)}
    out = {}
    for doc_id, text, _ in rows:
        counts = brute_counts(text or "", max_n)
        top = sorted(counts, key=lambda g: (-counts[g], value(g)))[:most]
        if not top:
            out[doc_id] = ("und", 0.0)
            continue
        distance = {lang: sum(min(most, abs(p[g] - i)) if g in p else most for i, g in enumerate(top)) for lang, p in profiles.items() if p}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        out[doc_id] = (best, 1 - distance[best] / (most * len(top)))
    return out


def test_whole_table_equals_out_of_place_by_dictionaries(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain_predictions(rows)
    got = {r.doc_id: r for r in queries.op5_rank_order_language(spark, folder).collect()}
    assert set(got) == set(want)
    for k, (lang, score) in want.items():
        assert got[k].lang_pred == lang and abs(got[k].score - score) < 1e-12


def test_counts_equal_brute_force():
    for text in ["Anble anes.", "É, x!! zz-top", "a", "  a b  ", "one two two three three three"]:
        for max_n in (1, 2, 3, 4):
            _, counts = language_id.gram_counts(language_id.letter_codes(text), max_n)
            assert sorted(counts) == sorted(brute_counts(text, max_n).values())
            # Texts that are counted together count as they do apart.
            _, both = language_id.gram_counts(np.concatenate([language_id.letter_codes(text)] * 2), max_n)
            assert both.tolist() == (2 * counts).tolist()


def test_distance_is_out_of_place_and_ties_go_to_the_smaller_name():
    grams = language_id.top_grams(language_id.letter_codes("abab abab abc"), 2, 10)
    order = np.argsort(grams)
    same = language_id.Profile("b", grams[order], order)
    twin = language_id.Profile("a", grams[order], order)
    other = language_id.Profile("z", np.array([1], dtype=np.uint64), np.array([0]))
    assert language_id.predict(["abab abab abc"], [twin, same, other], 2, 10) == (["a"], [1.0])
    assert language_id.predict(["abab abab abc"], [other], 2, 10) == (["z"], [0.0])


def test_nulls_empty_tables_and_unlabelled_rows(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ?!", "en"), (None, "some words", "en"), (4, "words again", None), (4, "words again", None), (5, "x" * 300_000, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as language").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.lang_pred) for r in queries.op5_rank_order_language(spark, str(tmp_path)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 6
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.op5_rank_order_language(spark, str(tmp_path / "empty")).count() == 0
