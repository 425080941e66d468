import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from gridloom.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"


def shingles(line, k=line_dedup.SHINGLE_CHARS):
    return frozenset(line[i : i + k] for i in range(max(1, len(line) - k + 1)))


def brute(rows, staying=False):
    """Expected (doc_id, n_lines, n_kept, digest, repeats) of every document, or of those that stay in the pipeline."""
    places = defaultdict(list)
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                places[line.strip().lower()].append((doc_id is not None, doc_id or 0, text, i))
    sets = {x: shingles(x) for x in places}
    root = {x: x for x in places}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    known = list(sets)
    size = np.array([len(sets[x]) for x in known])
    for i, x in enumerate(known):
        for y in sets[x]:
            holders[y].append(i)
    for i, x in enumerate(known):
        both = np.bincount(np.concatenate([holders[y] for y in sets[x]]), minlength=len(known))
        for j in np.flatnonzero(100 * both >= 80 * (size[i] + size - both)):
            root[find(x)] = find(known[j])
    first = {}
    for x, found in places.items():
        first[find(x)] = min([first[find(x)], *found] if find(x) in first else found, key=lambda p: (p[0], p[1], p[3]))
    out = []
    for doc_id, text in rows:
        lines = None if text is None else text.split("\n")
        if lines is None:
            out.append((doc_id, None, None, None, ()))
            continue
        stay, gone = [], []
        for i, x in enumerate(lines):
            one = first[find(x.strip().lower())] if x.strip() else None
            if one is None or one == (doc_id is not None, doc_id or 0, text, i):
                stay.append(x)
            else:
                gone.append((i, one[1] if one[0] else None, one[3]))
        if staying and gone and not any(x.strip() for x in stay):
            continue
        out.append((doc_id, len(lines), len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest(), tuple(gone)))
    return Counter(out)


def check(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter((r.doc_id, None if r.n_lines == -1 else r.n_lines, None if r.n_kept == -1 else r.n_kept, r.text_sha256, tuple(map(tuple, r.repeats))) for r in queries.op2_fuzzy_lines(spark, folder).collect())
    assert got == brute(rows)


def test_whole_table_equals_brute_force(spark):
    check(spark, SF)


def test_nulls_blank_short_and_repeated_lines(spark, tmp_path):
    long = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest tonight"
    rows = [
        (1, None), (2, ""), (3, "\n \n"), (4, f"{long}\nshort\n\nown line"), (5, f"{long.upper()}!\nshort"), (6, "short"), (6, "short"), (7, f"other\n{long.replace('wolf', 'wolves')}"),
        (8, "x" * 50_000), (9, "x" * 40_000 + "y"), (4, f"{long}\nshort\n\nown line"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as place", "3 as bucket").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_heavy_buckets(spark, tmp_path):
    base = "all of these lines come from one text and differ by a number that stands at the end of the line namely "
    rows = [(i, f"{base}{i}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op2_fuzzy_lines(spark, str(tmp_path)).count() == 0


def test_one_edit_in_lines_of_50_to_100_characters(spark, tmp_path):
    pick = random.Random(5)
    word = lambda n: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = []
    for n in (50, 60, 75, 90, 100):
        line, other = (" ".join(word(4) for _ in range(25))[:n] for _ in range(2))
        pairs.append((line, line[: n // 2] + "#" + line[n // 2 + 1 :]))
        at = other.index(" ", n // 2)
        pairs.append((other, f"{other[:at]} new{other[at:]}"))
    pairs.append((notice := "copyright 2019 the contributors of this project, all rights reserved, see the file", notice.replace("2019", "2024")))
    rows = [(2 * i + j, line) for i, two in enumerate(pairs) for j, line in enumerate(two)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in queries.op2_fuzzy_lines(spark, str(tmp_path)).collect() if r.n_kept) == list(range(0, len(rows), 2))


def test_long_lines_of_few_shingles(spark, tmp_path):
    rows = [(i, unit * (100 + 37 * i)) for i, unit in enumerate(["-", "-", "=-", "=-", "abc def ", "abc def ", "-"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path))


def test_blank_lines_of_any_white_space_stay(spark):
    texts = ["a first line of some length here\r\n\r\nsome second one here\r\n\r\n\t\nlast\t", "quite another line stands here\r\n\r\n\u00a0\u2003\nA First Line of some length here \r\n\x0b\r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.with_kept_lines(docs).collect()}
    assert got[0].kept is None and [(g.place, g.of_id, g.of_place) for g in got[1].gone] == [(3, 0, 0)]
    assert got[1].kept == ["quite another line stands here\r", "\r", "\u00a0\u2003", "\x0b\r"]


def test_planted_pairs_are_found(spark):
    """Pairs of lines at a Jaccard similarity of 0.80 to 0.86, of 50 to 1000 characters: at least 0.99 are found."""
    rng = random.Random(11)
    letters, pairs = "abcdefghijklmnopqrstuvwxyz ", []
    while len(pairs) < 400:
        a = "".join(rng.choice(letters) for _ in range(rng.choice((50, 60, 90, 150, 300, 1000)))).strip()
        b = list(a)
        for _ in range(max(1, round(len(a) * rng.uniform(0.018, 0.025)))):
            b[rng.randrange(len(b))] = rng.choice(letters)
        b = "".join(b).strip()
        x, y = shingles(a), shingles(b)
        if a != b and 0.80 <= len(x & y) / len(x | y) <= 0.86:
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, line) for i, p in enumerate(pairs) for k, line in enumerate(p)], "doc_id long, text string")
    gone = {(r.doc_id, g.of_id) for r in line_dedup.with_kept_lines(docs).where("gone is not null").collect() for g in r.gone}
    found = sum((2 * i + 1, 2 * i) in gone for i in range(len(pairs)))
    assert found >= 0.99 * len(pairs) and len(gone) == found


def test_buckets_move_once_whatever_their_number(spark, tmp_path, monkeypatch):
    pick, plans = random.Random(3), []
    rows = [(i, pick.choice((0, 0b1011, -1)), [pick.randrange(60) for _ in range(3)]) for i in range(80)]
    spark.createDataFrame(rows, "class long, bits long, buckets array<long>").write.parquet(str(tmp_path / "classes"))
    classes = spark.read.parquet(str(tmp_path / "classes"))

    def collected(df, name):
        out = spark.createDataFrame(df.collect(), df.schema)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return out

    monkeypatch.setattr(line_dedup, "stored", collected)
    near = lambda a, b: a[0] != b[0] and (a[1] ^ b[1] & 2**64 - 1) % 2**64 in (0, 0b1011)
    want = {(x, a[0]) for a in rows for x in a[2] for b in rows if near(a, b) and x in b[2]}
    assert {tuple(r) for r in line_dedup.candidates(classes).select("bucket", "class").collect()} == want
    assert all(p.count("- Exchange hashpartitioning(bucket") == 1 and p.count("ReusedExchange") == 1 for p in plans), plans[0]


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(1, "A line\n \nb"), (2, None), (3, "")], "doc_id long, text string")
    lines = line_dedup.split_lines(docs, "doc_id", "text")
    assert sorted((r.id, r.place, r.line) for r in lines.collect()) == [(1, 0, "a line"), (1, 2, "b")]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1


def test_two_passes_over_the_texts(spark, monkeypatch):
    """One for the classes, one for the places of lines and what candidates say; what follows reads stored tables."""
    line = "a line of more than fifty characters that is nearly the same in two documents"
    docs, plans, stored = spark.createDataFrame([(1, f"{line}\nother"), (2, f"{line}s\nanother")], "doc_id long, text string"), [], line_dedup.stored

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(line_dedup, "stored", noted)
    assert [(r.place, r.of_id, r.of_place) for r in line_dedup.repeated_lines(docs).collect()] == [(0, 1, 0)]
    assert sum("split(text" in p for p in plans) == 2


def test_lines_with_plain_ends_are_not_trimmed(spark):
    """Blanks of every kind go from both ends; a trim, which looks at every byte, is met only where an end isn't visible ASCII."""
    ends = [*line_dedup._BLANKS, "", "x", "~", "!", "\x7f", "\x00", "\u00e9", "\u3002", "\U0001f600"]
    texts = [f"{a}Mid dle{b}" for a in ends for b in ends if "\n" not in (a, b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_dedup.split_lines(docs, "doc_id", "text")
    assert {r.id: r.line for r in lines.collect()} == {i: x.strip().lower() for i, x in enumerate(texts)}
    assert "CASE WHEN" in lines._jdf.queryExecution().optimizedPlan().toString().split("trim(")[0]


def test_sizes_and_parities_of_sets(spark):
    """Of the distinct shingles: those that repeat in a line count once."""
    texts = ["abc def abc def abc def", "-" * 300, "ab", "\u4f60\u597d, \U0001f600 x" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "class long, line string")
    got = {r["class"]: r for r in line_dedup.described(rows, 5).collect()}
    for r in rows.select("class", line_dedup.shingle_set("line", 5).alias("of")).collect():
        want = [0] * line_dedup.PARITY_LONGS
        for h in r.of:
            want[(h >> 6) % line_dedup.PARITY_LONGS] ^= 1 << (h & 63)
        assert got[r["class"]].n == len(r.of) == len(set(r.of))
        assert [got[r["class"]][f"p{j}"] % 2**64 for j in range(line_dedup.PARITY_LONGS)] == want


def test_sets_are_described_only_for_what_first_links_leave_apart(spark, monkeypatch):
    """Near copies that their first pairs connect need no sizes and parities; those of a large bucket that stay apart do."""
    rng, rows = random.Random(2), []
    for i in range(20):
        line = "".join(rng.choice("abcdefghij klmnopq") for _ in range(120)).strip()
        rows += [f"{line}{end}" for end in ("", "!")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    seen, described = [], line_dedup.described

    def noted(texts, k):
        seen.append(texts.count())
        return described(texts, k)

    monkeypatch.setattr(line_dedup, "described", noted)
    assert line_dedup.repeated_lines(docs).count() == 20
    assert seen == [0]


def test_verified_pairs_are_those_of_exact_sets(spark):
    """At 80 of 100 exactly and next to it, with shingles that repeat and lines of less than a shingle; the map of draws has its old bound afterwards."""
    lines = ["abcdefghijklm", "abcdefghijkl", "abcdefghijklmno", "abcdeabcdeabcdeabcdeabcde", "abcdeabcdeabcde", "abc", "abcd", "你好\U0001f600 abc", "你好\U0001f600 abcd"]
    texts = spark.createDataFrame(list(enumerate(lines)), "class long, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines))], "a long, b long")
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if 100 * len((x := shingles16(lines[i])) & (y := shingles16(lines[j]))) >= 80 * len(x | y)}
    assert {tuple(r) for r in line_dedup.verified(pairs, texts, 5, 80).collect()} == want and (0, 2) in want
    before = spark.conf.get(line_dedup.MAP_BITS[0])
    assert line_dedup.repeated_lines(texts.withColumnsRenamed({"class": "doc_id", "line": "text"})).count() and spark.conf.get(line_dedup.MAP_BITS[0]) == before


def shingles16(line, k=line_dedup.SHINGLE_CHARS):
    """Shingles of a line's UTF-16 units, as Spark's are."""
    wide = line.encode("utf-16-be")
    return {wide[i : i + 2 * k] for i in range(0, max(1, len(wide) - 2 * k + 1), 2)}
