import random
import re

import numpy as np
import pandas as pd
import pytest

from crate.llm import ngram_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plainly(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(99)], [words[k], "more"]])
    return words


def corpus(seed=2):
    rng = random.Random(seed)
    text = lambda n: ["w%d" % rng.randrange(3_000) for _ in range(n)]
    passage = text(60)
    rows = [(i, " ".join(text(rng.randint(0, 60)) + passage * (i % 3 == 0) + text(rng.randint(0, 40)))) for i in range(80)]
    i = 1_000
    for size in (4, 5, 8, 9, 10, 11, 14, 20, 40, 90, 200):
        base = text(size)
        for k in range(10):
            i += 1
            rows.append((i, " ".join(edited(rng, base, rng.randint(0, max(1, size // 25) * (k % 3))))))
    base = text(120)
    rows += [(2_000 + k, " ".join(edited(rng, base, rng.randint(1, 6)))) for k in range(150)]  # alike, some linked and some not
    rows += [(3_000 + k, "A Copy of THE same text") for k in range(20)] + [(3_100, "a copy of the\x0b same  text"), (3_101, "a copy of the same text")]
    rows += [(4_000, None), (4_001, ""), (4_002, " \t\n"), (4_003, "one two"), (4_004, "One two"), (4_005, "one two three"), (None, "one two"), (None, "nothing like it at all"), (None, "nothing like it at all"), (4_003, "other words here for once")]
    huge = text(30_000)
    return [*rows, (5_000, " ".join(huge)), (5_001, " ".join(edited(rng, huge, 300)))]


def test_components_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, bucket string, n int")
    got = ngram_join.jaccard_components(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == plainly(rows)


@pytest.mark.parametrize(("small", "sets"), [(2, 8), (10_000, 8)])
def test_blocks_and_candidates_find_the_same(spark, monkeypatch, small, sets):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "OUT_SETS", sets)
    monkeypatch.setattr(ngram_join, "MET_SETS", 2 * sets)
    rng = random.Random(9)
    base = ["w%d" % k for k in range(60)]
    rows = [(k, " ".join(edited(rng, base, rng.randint(1, 4)))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.jaccard_components(df).collect()), key=str) == plainly(rows)


def test_an_empty_table(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for n in [*range(6, 60), 100, 171, 172, 400, 1_000, 5_000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = int(rng.integers(0, n * 15 // 100 + 1))
            b = a[rng.permutation(len(a))[drop:]]
            grow = len(b)
            while grow and ngram_join.linked(a, c := np.unique(np.concatenate([b, rng.integers(0, 1 << 63, grow).astype(np.uint64)]))) is False:
                grow -= 1
            c = c if grow else np.sort(b)
            if ngram_join.linked(a, c) and not np.array_equal(a, c):
                assert np.intersect1d(ngram_join.keys(a), ngram_join.keys(c)).size


def test_traversal_drops_no_linked_pair_and_prunes():
    rng = np.random.default_rng(4)
    bases = [rng.integers(0, 1 << 63, 200).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rng.permutation(200)[: rng.integers(185, 201)]], rng.integers(0, 1 << 63, rng.integers(0, 12)).astype(np.uint64)])) for b in bases for _ in range(20)]
    maps = ngram_join.folded([ngram_join.signature(s, 512) for s in sets])
    n = np.array([len(s) for s in sets])
    order = np.lexsort((*maps.T[:4], n))
    maps, n, sets = maps[order], n[order], [sets[i] for i in order]
    labels = np.arange(len(sets))
    a, b = ngram_join.tree(maps, n, labels), ngram_join.tree(maps, n, labels)
    met = {(int(x), int(y)) for i, j in ngram_join.traversed(a, b) for x, y in zip(i, j, strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and ngram_join.linked(sets[i], sets[j])}
    assert want <= met
    assert len(met) < 0.2 * len(sets) ** 2
    same = ngram_join.tree(maps, n, np.zeros(len(sets), np.int64))
    assert not list(ngram_join.traversed(same, ngram_join.tree(maps, n, np.zeros(len(sets), np.int64))))


def test_joined_links_as_few_as_connect():
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    rows = pd.DataFrame([{"node": k, "label": k, "n": 99, "bitmap": ngram_join.signature(np.delete(base, k), 256).tobytes(), "tokens": np.delete(base, k).tobytes(), "out": k < 5} for k in range(30)])
    left, right = ngram_join.joined(rows)
    assert len(left) == len(right) == 29


def test_keys_move_once(spark, monkeypatch):
    """Keys of one node only are dropped after one shuffle, before groups with the same members are sought; the groups left are those of all keys."""
    plans, tables, real = {}, {}, ngram_join.saved

    def saved(df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString())
        out = real(df, tag)
        if tag in ("shared", "members"):
            tables[tag] = [tuple(r) for r in out.select("node", "bucket", "m").collect()]
        return out

    monkeypatch.setattr(ngram_join, "saved", saved)
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(900) for _ in range(60)]
    rows = [(i, " ".join(edited(rng, base, i % 4))) for i in range(30)] + [(100 + i, f"one{i} two three four five{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ngram_join.jaccard_components(df)
    assert [tag for tag, plan in plans.items() if "explode(" in plan.lower() and "keys" in plan] == ["shared"]
    texts = {frozenset(shingles(t)) for _, t in rows}
    nodes = {b: set() for _, b, _ in tables["shared"]}
    for node, b, _ in tables["shared"]:
        nodes[b].add(node)
    assert all(m == len(nodes[b]) > 1 for _, b, m in tables["shared"])
    groups = [frozenset(x) for x in nodes.values()]
    left = {b for _, b, _ in tables["members"]}
    assert len(left) == len(set(groups)) and {frozenset(nodes[b]) for b in left} == set(groups)
    counts = {}
    for found in {ngram_join.shingles(t.encode()).tobytes() for _, t in rows}:
        for key in set(ngram_join.keys(np.frombuffer(found, np.uint64)).view(np.int64).tolist()):
            counts[key] = counts.get(key, 0) + 1
    assert {b: len(x) for b, x in nodes.items()} == {k: n for k, n in counts.items() if n > 1} and len(texts) > 20
