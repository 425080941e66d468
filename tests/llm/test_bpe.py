import hashlib
from collections import Counter

import numpy as np
import public_tokenizers

from gridloom.llm import bpe, queries
from gridloom.llm.tokenization import load_tokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer = load_tokenizer(PATH)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return Counter(out)


def check(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.op6_bpe_tree(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == expected(rows)


def test_whole_table(spark):
    check(spark, SF)


HARD = [
    (1, None), (1, ""), (2, " \n\t "), (3, "unsplit" * 20_000), (3, "unsplit" * 20_000), (None, "no id"), (4, "word's, and MORE 123 ½ 日本語 " * 4000),
    (5, "<|endoftext|> <|startoftext|>x"), (6, "\x1c a\x1fb"), (7, "a" * 70_000), (8, "İ ß Ω Σς é é"), (9, "'s 't '" * 30_000),
]


def test_hard_rows(spark, tmp_path):
    spark.createDataFrame(HARD, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as piece", "3 as decoded").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op6_bpe_tree(spark, str(tmp_path)).count() == 0


def test_tree_equals_the_library_for_many_cuts():
    tokenizer = load_tokenizer(PATH)
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = "".join(rng.choice(list("abehint'  .,12é日\n"), rng.integers(1, 400)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.encode_by_tree(text, PATH, leaf_chars=int(rng.integers(5, 60))).tolist() == want


def test_tokens_in_other_cases_are_text(spark, tmp_path):
    rows = [(1, "<|ENDOFTEXT|>"), (2, "<|ENDOFTEXT|> Hi"), (3, "<|endoftext|> Hi <|EndOfText|>"), (4, "A<|STARTOFTEXT|>b"), (5, "x <|ENDOFTEXT|> y " * 2000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_random_texts_with_tokens_in_any_case():
    tokenizer, encoder = load_tokenizer(PATH), bpe.field_encoder(PATH)
    rng = np.random.default_rng(4)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", " ", "\n", "Word", "it's", "É", "İ", "日", "12", ".", "\x1d"]
    for _ in range(800):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == want, text
        assert bpe.encode_by_tree(text, PATH, leaf_chars=int(rng.integers(3, 12))).tolist() == want, text


def test_most_texts_are_joined(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["the", "Quick", "été", "naïve", "don't", "3.14", "...", "supercalifragilistic", "日本", "x" * 300]
    rows = [(i, " ".join(rng.choice(words, 1500)) + ("y" * 9000 if i % 3 == 0 else "")) for i in range(12)] + [(99, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_pieces_of_very_long_texts_are_dealt_out(spark):
    rng = np.random.default_rng(6)
    words = ["the", "Quick", "été", "don't", "3.14", "...", "supercalifragilistic", "日本", "x" * 300]
    rows = [(i, " ".join(rng.choice(words[: 7 + 2 * (i % 2)], 3000))) for i in range(6)] + [(7, "12" * 9000), (7, "12" * 9000), (8, "short"), (9, "Ab \t" * 8000)]
    docs, tokenizer = spark.createDataFrame(rows, "doc_id long, text string"), load_tokenizer(PATH)
    want = Counter((i, np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()) for i, t in rows)
    for dealt in (5000, 20_000):
        got = bpe.encode(docs, PATH, leaf_chars=1000, dealt_chars=dealt).collect()
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want


def test_windows_that_grow_beyond_the_known_spans(monkeypatch):
    tokenizer, encoder = load_tokenizer(PATH), bpe.PieceEncoder(bpe.field_encoder(PATH))
    rng = np.random.default_rng(7)
    words = ["word", "it's", "12", "Éa", "...", "of", "unknowable"]
    partial = 0
    for edge in (1, 2, 30):
        monkeypatch.setattr(bpe, "EDGE_FIELDS", edge)
        for _ in range(40):
            text = " ".join(rng.choice(words, rng.integers(50, 900)))
            pieces = [encoder.leaf(text[i : i + 700]) for i in range(0, len(text), 700)]
            partial += sum(x.head < len(x.ids) for x in pieces)
            for x in pieces:
                again = bpe._unpack_spans(x.text, x.ids, bpe._pack_spans(x))
                whole = encoder.encode(x.text)
                assert np.array_equal(whole.ids, x.ids)
                for known in (x, again):
                    assert np.array_equal(known.starts[: x.head], whole.starts[: x.head]) and np.array_equal(known.ends[: x.head], whole.ends[: x.head])
                    last = len(x.ids) - x.tail
                    assert np.array_equal(known.starts[last:], whole.starts[last:]) and np.array_equal(known.ends[last:], whole.ends[last:])
            assert encoder.tree(pieces).ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert partial > 100


def test_fields_that_go_straight_to_the_model():
    tokenizer, encoder = load_tokenizer(PATH), bpe.field_encoder(PATH)
    assert encoder.ids.pattern is not None
    rng = np.random.default_rng(8)
    parts = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2016), 0x20AC]] + ["'s", "'LL", "ing", "THE", "½", "<|endoftext|>"]
    for _ in range(20_000):
        field = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert np.frombuffer(encoder.encode(field), dtype="<u4").tolist() == tokenizer.encode(field, add_special_tokens=False).ids, field
