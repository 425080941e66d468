from collections import Counter, defaultdict

import numpy as np
from test_packing import expected_pieces

from gridloom.llm import queries, token_output

SF = "/root/testdata/sf0.01"


def check(spark, folder, slack):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op10_packed_output(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(expected_pieces(rows))
    assert all(r.restarts for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        assert [o for o, _ in sorted(items)] == np.cumsum([0, *(n for _, n in sorted(items))])[:-1].tolist()
        assert sum(n for _, n in items) <= 1024
    assert len(places) <= -(-sum(r.length for r in got) // 1024) * slack + 1


def test_written_output_holds_every_piece(spark):
    check(spark, SF, 1.02)


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    rows = [(1, None), (1, ""), (2, "same"), (2, "same"), (None, "no id"), (3, "word " * 5000), (4, "<|endoftext|> 日本"), (5, "a" * 1023)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as ids", "3 as keys").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), 2)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op10_packed_output(spark, str(tmp_path)).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 41, rng.integers(0, 200)).tolist()
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            free.remove(best := min(fits)) if fits else None
            free.append((best if fits else 40) - n)
        rows = token_output.best_fit_decreasing(lengths, 40)
        assert sorted(40 - sum(lengths[i] for i in r) for r in rows) == sorted(free)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
