import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from gridloom.llm import packing, queries
from gridloom.llm.tokenization import byte_level_encoder, load_tokenizer

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected_pieces(rows):
    tokenizer = load_tokenizer(PATH)
    out = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % 1024 + 1
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        out += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    return out


def check(spark, folder, slack):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op8_best_fit_packing(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(expected_pieces(rows))
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(r.length for r in got) // 1024) * slack + 1


def test_pieces_and_places(spark):
    check(spark, SF, 1.01)


def test_nulls_repeats_long_and_odd_texts(spark, tmp_path):
    rows = [(1, None), (1, ""), (2, "same"), (2, "same"), (None, "no id"), (3, "word " * 5000), (4, "x" * 3000), (5, "<|endoftext|> 日本 \x1c"), (6, "a" * 1023)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as sequence_id").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), 2)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op8_best_fit_packing(spark, str(tmp_path)).count() == 0


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(0)
    histogram = Counter(rng.integers(1, 1025, 5000).tolist())
    places = packing.plan(histogram)
    ranks = defaultdict(list)
    filled = Counter()
    for length, rank, n, sequence, offset in places.tolist():
        ranks[length] += range(rank, rank + n)
        for s in range(sequence, sequence + n):
            filled[s] += length
        assert offset + length <= 1024
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert max(filled.values()) <= 1024


def test_encoder_equals_the_library():
    encoder, library = byte_level_encoder(PATH), load_tokenizer(PATH)
    for text in ["", "don't  stop\n\n now", "Ünïcode é", "½ ² 日本語", "<|endoftext|>x", "a" * 3000, "\x1c \x1d"]:
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def best_fit_decreasing(histogram, capacity=1024):
    free, sequences = Counter(), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [f for f in free if f >= length and free[f]]
            room = min(fits, default=capacity)
            sequences += not fits
            if fits:
                free[room] -= 1
            free[room - length] += 1
    return sequences


def test_sequences_against_best_fit_decreasing():
    rng = np.random.default_rng(1)
    n = 5000
    for lengths in (
        rng.integers(300, 600, n),
        rng.integers(65, 400, n),
        rng.choice([200, 333, 400, 510, 700], n),
        rng.integers(330, 350, n),
        np.clip(rng.lognormal(5.5, 0.9, n).astype(int), 1, 1024),
        np.clip(rng.exponential(280, n).astype(int), 1, 1024),
        rng.integers(1, 1025, n),
    ):
        histogram = Counter(lengths.tolist())
        places = packing.plan(histogram)
        used = {s for _, _, k, first, _ in places.tolist() for s in range(first, first + k)}
        assert len(used) <= best_fit_decreasing(histogram)


def test_columns_of_the_caller_stay(spark):
    rows = [(i, 0, 400 + i % 3, i, i, i, i) for i in range(30)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, _bucket int, _row int, rank int, before int")
    assert sorted(tuple(r)[:7] for r in packing.pack(pieces).collect()) == sorted(rows)


def test_few_sizes_stay_within_groups():
    counts = [(length, 7) for length in range(1000, 100, -1)]
    groups = packing.equal_groups(counts, packing.GROUPS)
    assert len(groups) == packing.GROUPS and sum(k for g in groups for _, k in g) == 7 * 900
