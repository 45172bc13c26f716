import random

import numpy as np
import pandas as pd

from crate.llm import near_dedup


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(20, 120)))) for i in range(60)]
    base = text(300)
    for i in range(100, 180):  # a large group: one word differs from the base in each
        t = list(base)
        t[rng.randrange(300)] = "edit"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, "same text here for all of these rows") for i in range(30)]
    rows += [(300, None), (301, ""), (302, "two words"), (303, "Two, words"), (None, "two words"), (304, "x " * 9000)]
    return rows


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    hits, want = [], []
    for _ in range(60):
        s = rng.integers(0, 2**63, 300).astype(np.uint64)
        s.sort()
        a, b = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        hits.append((near_dedup.bands(s, a) == near_dedup.bands(s, b)).mean())
    assert abs(np.mean(hits) - np.mean(np.array(want) ** near_dedup.ROWS)) < 0.03


def test_classes_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, label string, bucket int")
    got = near_dedup.near_groups(df).collect()
    assert len(got) == len(rows)
    idf = near_dedup._frequent(df.select("text"))
    vectors = [near_dedup.vector(t, idf) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8:
                root[find(i)] = find(j)
    want = {}
    for i, (doc, _) in enumerate(rows):
        want.setdefault(find(i), set()).add(doc)
    found = {}
    for r in got:
        found.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(str, want.values())) == sorted(map(str, found.values())) or {frozenset(x) for x in want.values()} == {frozenset(x) for x in found.values()}
    for r in got:
        assert r.class_size == len(found[r.class_id])
    assert sum(r.kept for r in got) == len(found)


def test_dropping(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus()] + [(302, "two words", "x")], "doc_id long, text string, node string")
    kept = near_dedup.drop_near_copies(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and len(ids) == len(set(ids))
    assert [i for i in ids if 100 <= i < 180] == [100] and [i for i in ids if 200 <= i < 230] == [200]
    assert 300 in ids and 301 not in ids and 302 in ids and 303 not in ids
    assert near_dedup.drop_near_copies(df.limit(0)).count() == 0


def pair(rng, n, similarity, kind):
    """Two vectors of about n shingles at the given weighted Jaccard similarity: other shingles, or the same at other counts."""
    found = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    n = len(found)
    if kind == "shingles":
        own = round(n * (1 - similarity) / 2)
        return (found[own:], np.ones(n - own)), (found[: n - own], np.ones(n - own))
    counts = np.ones(n)
    counts[rng.choice(n, round(n * (1 - similarity) / similarity), replace=False)] = 2
    return (found, np.ones(n)), (found, counts)


def test_signatures_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    limit, lost, shared, pairs = near_dedup.bits_apart(0.8), 0, 0, 0
    for n, turns in ((300, 120), (3_000, 30), (20_000, 6)):
        for kind in ("shingles", "weights"):
            for _ in range(turns):
                a, b = pair(rng, n, 0.8, kind)
                if abs(near_dedup.weighted_jaccard(a, b) - 0.8) > 0.01:
                    continue
                x, y = near_dedup.bands(*a), near_dedup.bands(*b)
                apart = sum(int(p ^ q).bit_count() for p, q in zip(x[-2:].view(np.uint64).tolist(), y[-2:].view(np.uint64).tolist(), strict=True))
                lost += apart > limit
                shared += bool((x[:-2] == y[:-2]).any())
                pairs += 1
    assert pairs > 250 and lost == 0 and shared >= pairs - 2


def test_blocks_multiply_to_the_same_similarities():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(rng.choice(words) if rng.random() < p else w for w in base) for p in (0, 0.01, 0.03, 0.05, 0.1, 0.3) for _ in range(4)] + ["x " * 900, "x " * 700, "", "one two"]
    idf = near_dedup.Idf(np.zeros(0, np.uint64), np.zeros(0))
    of, vectors = [near_dedup.shingles(t, idf) for t in texts], [near_dedup.vector(t, idf) for t in texts]
    got = near_dedup.similarities(of[:9], of)
    want = np.array([[near_dedup.weighted_jaccard(a, b) for b in vectors] for a in vectors[:9]])
    assert np.abs(got - want).max() < 1e-5
    rows = pd.DataFrame({"text": texts * 2, "label": list(range(len(texts))) * 2, "out": [True] * len(texts) + [False] * len(texts)})
    tree = near_dedup._block(rows, idf, 0.8)
    root = {i: i for i in range(len(texts))}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in zip(tree["a"], tree["b"], strict=True):
        assert find(a) != find(b)
        root[find(a)] = find(b)
    whole = np.array([[near_dedup.weighted_jaccard(a, b) for b in vectors] for a in vectors])
    linked = {i: i for i in range(len(texts))}
    up = lambda i: i if linked[i] == i else up(linked[i])
    for i, j in np.argwhere(whole >= 0.8):
        linked[up(int(i))] = up(int(j))
    assert all((find(i) == find(j)) == (up(i) == up(j)) for i in range(len(texts)) for j in range(i))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "OUT_NODES", 5)
    monkeypatch.setattr(near_dedup, "MET_NODES", 7)
    test_classes_against_all_pairs(spark)
