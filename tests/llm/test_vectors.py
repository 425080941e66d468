import numpy as np
import pytest

from gridloom.llm import components, pq, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def read(spark, folder):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_top(rows):
    rows = [(i, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows if usable(v)]
    width = max((len(v) for _, v in rows), default=0)
    rows = [(i, np.pad(v, (0, width - len(v)))) for i, v in rows]
    out = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        ranked = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:5]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


def brute_links(rows, cosine=0.95):
    good = [usable(v) and any(x != 0 for x in v) for _, v in rows]
    x = np.array([np.array(v, dtype=float) if ok else np.full(len(rows[0][1]), np.nan) for (_, v), ok in zip(rows, good, strict=True)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= cosine
    np.fill_diagonal(links, False)
    root = list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        if root[i] != i:
            continue
        todo = [i]
        while todo:
            for k in np.flatnonzero(links[todo.pop()]):
                if root[k] == k and k != i:
                    root[k] = i
                    todo.append(k)
    return sorted((rows[i][0], int(links[i].sum()), rows[root[i]][0], rows[root[i]][0] == rows[i][0]) for i in range(len(rows)))


def save(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as list", "3 as n_links").write.parquet(str(folder / "embeddings.parquet"))


HARD = [
    (0, [0.5, -0.25], 0), (50, [0.5, -0.25], 0), (50, [0.5, -0.25], 0), (100, None, 0), (150, [float("nan"), 1.0], 0), (151, [1.0, None], 0),
    (152, [float("inf"), 1.0], 0), (200, [0.0, 0.0], 0), (201, [0.0, 0.0], 0), (202, [1.0, 0.0], 0), (203, [1e-3, 0.0], 0), (300, [0.51, -0.25], 0),
]


def test_top_k_equals_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op7_term_at_a_time_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(read(spark, SF))


def test_top_k_of_hard_rows_in_many_blocks(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.llm import top_k

    save(spark, tmp_path, HARD)
    got = sorted(tuple(r) for r in queries.op7_term_at_a_time_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(read(spark, tmp_path))
    rows = [(i, [int(x) for x in np.random.default_rng(i).integers(-3, 4, 6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, w array<long>")
    found = top_k.top_k(df, F.col("vec_id") % 50 == 0, key="vec_id", weights="w", k=5, query_block=2, candidate_block=30)
    want = []
    for q, v in rows[::50]:
        ranked = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("query", [queries.op7_term_at_a_time_top_k, queries.op9_product_quantisation])
def test_empty_table(spark, tmp_path, query):
    save(spark, tmp_path, [])
    assert query(spark, str(tmp_path)).count() == 0


def test_links_equal_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op9_product_quantisation(spark, SF).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute_links(read(spark, SF))


def test_links_of_hard_rows(spark, tmp_path):
    save(spark, tmp_path, HARD)
    got = sorted(tuple(r) for r in queries.op9_product_quantisation(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    rows = [(i, v if v is None else [*v]) for i, v in read(spark, tmp_path)]
    assert got == brute_links(sorted(rows, key=lambda r: (r[0], r[1] is None)))


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= np.sum(noise * base, axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.953 * base + np.sqrt(1 - 0.953**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = pq.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.95)
    found = {r.vec_id: r.component_id for r in got.collect()}
    recall = np.mean([found[i + 3000] == found[i] for i in range(3000)])
    assert recall >= 0.9
    print("recall", recall)


def test_recall_with_as_many_lists_as_there_may_be(spark, monkeypatch):
    """2048 lists, of which 8 are probed: pairs of random vectors at a cosine of 0.953."""
    monkeypatch.setattr(pq, "ROWS_A_LIST", 4)
    rng = np.random.default_rng(6)
    n = 4200
    base = rng.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= np.sum(noise * base, axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.953 * base + np.sqrt(1 - 0.953**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    found = {r.vec_id: r.component_id for r in pq.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.95).collect()}
    recall = np.mean([found[i + n] == found[i] for i in range(n)])
    print("recall", recall)
    assert recall >= 0.9


def test_spanning_forest():
    a, b = np.array([5, 3, 1, 8]), np.array([3, 2, 7, 9])
    assert components.spanning_forest(a, b, 10).tolist() == [0, 1, 2, 2, 4, 2, 6, 1, 8, 8]
