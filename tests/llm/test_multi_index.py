import numpy as np
from pyspark.sql import functions as F

from crate.llm import multi_index


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 2 * rng.normal(size=(8, d))[rng.integers(0, 8, n)]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    books = multi_index.Codebooks(6, (rng.normal(size=(7, 3)), rng.normal(size=(7, 3))), 1.0)
    counts = np.ones(49, int)
    q = rng.normal(size=6)
    cells = books.visited(q, counts, 49)
    cost = [-(q[:3] @ books.halves[0][c // 7]) - q[3:] @ books.halves[1][c % 7] for c in cells]
    assert sorted(cells) == list(range(49)) and np.all(np.diff(cost) >= -1e-12)
    assert books.visited(q, counts, 10) == cells[:10]


def brute(ids, x, q, k):
    s = x.astype(float) @ x[np.flatnonzero(ids == q)[0]].astype(float)
    keep = ids != q
    order = np.lexsort((ids[keep], -np.round(s[keep], 12)))[:k]
    return ids[keep][order].tolist()


def test_recall_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 300)
    monkeypatch.setattr(multi_index, "GROUP_QUERIES", 20)
    x = vectors(1500, 16, 2)
    x[1000:1400] = x[1000]  # one vector many times: more than a block holds
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(2000, None, "x"), (2020, [0.0] * 16, "x"), (2040, [float("nan")] * 16, "x"), (2060, [1.0, None] * 8, "x"), (2080, [1.0] * 3, "x"), (None, x[0].tolist(), "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cell string")
    got = multi_index.search(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    ids, hit = np.arange(1500), 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, (x[part.vec_id].astype(float) * x[q].astype(float)).sum(axis=1), atol=1e-12)
        assert all(a > b or (a == b and i < j) for a, b, i, j in zip(part.score, part.score[1:], part.vec_id, part.vec_id[1:], strict=False))
        hit += len(set(part.vec_id) & set(brute(ids, x, q, 20)))
    assert hit / (20 * 75) >= 0.9
    copies = got[got.query_id == 1000].sort_values("rank")
    assert copies.vec_id.tolist() == list(range(1001, 1021))


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = multi_index.search(df, F.col("vec_id") == 0, 20).collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 1), (2, 2)]
    assert multi_index.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_ids_are_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    got = multi_index.search(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int"), F.col("vec_id") == 0, 20).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3] and sorted(r.vec_id for r in got) == [1, 1, 2]
