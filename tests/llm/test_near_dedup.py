import re
from collections import defaultdict

import numpy as np

from gridloom.llm import components, near_dedup, queries
from gridloom.llm.shingles import shingle_sets
from gridloom.llm.superminhash import signatures

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for some in holders.values():
        for i in some:
            for j in some:
                if i < j and find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    root[find(j)] = find(i)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, len(sets[i]), low.get(find(i)), low.get(find(i)) == k) for i, (k, _) in enumerate(rows)), key=str)


def check(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op4_superminhash_near_dedup(spark, folder).collect()]
    assert sorted(got, key=str) == brute(rows, 85)


def test_whole_table_equals_brute_force(spark):
    check(spark, SF)


def test_hard_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (5, "one two"), (6, "one two three"), (9, long), (8, long.replace("w150", "x")), (7, long + " w300 w301"), (7, long), (10, "z " * 30_000), (None, long), (None, "alone here")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as set_id", "3 as key").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_large_group_of_near_copies_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for k in rng.choice(120, rng.integers(0, 8), replace=False):
            copy[k] = f"e{i}_{k}"
        rows.append((i, " ".join(copy)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_empty_table_and_filter(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op4_superminhash_near_dedup(spark, str(tmp_path)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, long, "b"), (1, long + " x", "a"), (1, long + " x", "a"), (3, None, "c")], "doc_id long, text string, row_key string")
    left = near_dedup.without_near_duplicates(docs)
    assert sorted(map(tuple, left.collect())) == [(1, long + " x", "a"), (3, None, "c")]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    for size in (1, 4, 50, 500):
        error = []
        for _ in range(100):
            x = rng.integers(0, 2**63, size, dtype=np.uint64)
            a, b = np.sort(x[: max(1, size * 9 // 10)]), np.sort(x[size // 10 :])
            s = signatures([a, b], 128)
            error.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_shingle_counts_of_long_and_odd_texts():
    texts = ["", None, "a b c d", "a b c d e f", "x" * 2_500_000, "a b " * 700_000, "é b c"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_words_of_a_recursive_pattern_stay_apart(spark, tmp_path):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word), (4, "z" * 3_000_000), (5, "z" * 3_000_001)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_one_of_a_group_stays_without_ids_and_with_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(None, long), (None, long.replace("w150", "x")), (7, long.replace("w", "v")), (7, long.replace("w", "v") + " end"), (None, long.replace("w", "v") + " last"), (3, "alone"), (3, None), (None, "")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, _row_key string, row_key string")
    left = near_dedup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text, r._row_key, r.row_key) for r in left.collect()]
    assert len(got) == 5 and all(r[2:] == ("a", "b") for r in got)
    assert sum(r[0] == 7 for r in got) == 1 and sum(r[0] is None and bool(r[1]) for r in got) == 1


def test_words_of_a_recursive_pattern_stay_apart(spark):
    """Words of 22 blocks, each a Thue-Morse word of 1024 letters or its complement: sums over their bytes collide for any base."""
    from itertools import product

    from gridloom.llm.shingles import LONG_WORD, word_hashes

    t = "a"
    while len(t) < 1024:
        t += t.translate(str.maketrans("ab", "ba"))
    blocks = (t, t.translate(str.maketrans("ab", "ba")))
    some = ["".join(blocks[b] for b in (*bits, *([0] * 11))) for bits in product((0, 1), repeat=11)]
    assert len(set(word_hashes(" ".join(some).encode()).tolist())) == len(some)
    assert len({int(word_hashes(w.encode())[0]) for w in some}) == len(some)
    # The bound of long words doesn't show: words on both sides of it and in any company have one hash.
    for n in (LONG_WORD - 1, LONG_WORD, LONG_WORD + 1, 5000):
        assert word_hashes(("x " + "q" * n).encode())[1] == word_hashes(("q" * n).encode())[0]
    docs = spark.createDataFrame(list(enumerate(some[:40])), "doc_id long, text string")
    assert all(r["kept"] for r in near_dedup.near_duplicates(docs, percent=85).collect())
