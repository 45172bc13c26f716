import random

import numpy as np

from crate.llm import quality


def rows(n, seed):
    rng = random.Random(seed)
    words = ["sun", "moon", "river", "stone", "walk", "house", "tree"]
    out = []
    for i in range(n):
        good = rng.random() < 0.8
        t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 80)))
        out.append((i, t if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in t.split()), int(good)))
    return out


def test_linear_time_score_is_the_sum_over_pairs():
    m = quality.fit([(quality.features(t), y) for _, t, y in rows(200, 1)])
    for _, t, _ in rows(5, 2):
        ids, x = m.row(quality.features(t))
        v = m.factors[ids]
        pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert np.isclose(m.logit(quality.features(t)), m.bias + m.linear[ids] @ x + pairs)


def test_held_out_accuracy(spark):
    data = rows(900, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(5000, None, "x"), (5001, "", "x"), (None, "sun moon", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 3] + [(7, None), (99999, 1)], "doc_id long, quality int")
    sample = quality.fitting_sample(docs, labels, rows=400)
    assert len(sample) <= 400
    got = quality.scored(docs, quality.fit(sample)).collect()
    assert len(got) == 903 and all(0 <= r.quality_score <= 1 for r in got)
    want = {i: y for i, _, y in data}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 0]
    assert sum((r.quality_score >= quality.THRESHOLD) == want[r.doc_id] for r in held) / len(held) > 0.97


def test_without_labels_every_score_is_a_half(spark):
    docs = spark.createDataFrame([(1, "a text", 5.0), (1, "a text", 5.0), (2, None, 1.0), (3, "word " * 30_000, 2.0)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    machine = quality.fit(quality.fitting_sample(docs, labels))
    assert [r.quality_score for r in quality.scored(docs, machine).collect()] == [0.5] * 4
    assert quality.scored(docs.limit(0), machine).count() == 0
