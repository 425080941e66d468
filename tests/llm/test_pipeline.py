from collections import defaultdict

import corpus_pipeline
import pytest
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near
from test_packing import expected_pieces

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, folder)
    assert kept.columns == columns
    assert sorted(rows_of(kept), key=str) == sorted(((k, t) for k, t in rows_of(docs) if any(c.isalpha() for c in t or "")), key=str)
    before = rows_of(kept)
    lines = stages["line_dedup"](spark, kept, folder)
    assert lines.columns == columns
    got = lines.select("doc_id", "text", "n_chars").collect()
    assert all(r.n_chars == len(r.text) for r in got)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k[0]) for k in brute_lines(before, staying=True).elements())
    left = stages["near_dedup"](spark, lines, folder)
    assert left.columns == columns
    want = defaultdict(int)
    for doc_id, _, _, stays in brute_near(rows_of(lines), corpus_pipeline.NEAR_PERCENT):
        want[doc_id] += stays
    assert sorted(k for k, _ in rows_of(left)) == sorted(k for k, n in want.items() if n)
    packed = stages["packing"](spark, left, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(expected_pieces(rows_of(left)))


def test_stages_equal_brute_force(spark):
    check(spark, SF)


def test_run_gives_the_pieces_of_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_hard_rows(spark, tmp_path):
    text = " ".join(f"wort{i} und" for i in range(40))
    rows = [(1, text, "de", "a", 1), (2, text + " ende", None, "a", 1), (3, None, "de", None, None), (4, "12 !?", "de", "b", 5), (5, "ein kurzer text\n\nnoch einer", "de", "b", 5), (6, "ein kurzer text", "de", "b", 5)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


@pytest.mark.parametrize("stage", range(4))
def test_empty_tables(spark, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame([], COLUMNS), "").count() == 0
