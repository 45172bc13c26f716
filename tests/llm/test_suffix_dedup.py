import hashlib
import random

import numpy as np

from crate.llm import suffix_dedup


def brute(rows):
    """All 100-byte strings in order of document and start."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 300))) for _ in range(12)]
    rows = []
    for i in range(110):
        k, t = rng.random(), rng.choice(base)
        if 0.3 <= k < 0.6:
            j = rng.randint(0, len(t))
            t = t[:j] + rng.choice(["é", "xyz ", ""]) + t[j:]
        elif 0.6 <= k < 0.7:
            t = rng.choice(["a", "ab", "abc "]) * rng.randint(1, 300)
        elif 0.7 <= k < 0.75:
            t = None
        elif k >= 0.75:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 100))) + t[: rng.randint(50, 400)]
        rows.append((i, t))
    return rows


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(df).collect()}


def test_ranks_are_the_suffix_order():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 300)
        s = np.array([rng.randint(1, rng.choice([2, 4, 200])) for _ in range(n)])
        rank = suffix_dedup.ranks(s, n + 5)
        assert sorted(range(n), key=lambda i: rank[i]) == sorted(range(n), key=lambda i: tuple(s[i:]))


def test_against_brute_force(spark):
    rows = corpus()
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hot_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 3000)
    rows = corpus()
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_long_texts_in_segments(spark, monkeypatch):
    rng = random.Random(9)
    b = np.frombuffer(bytes(rng.choice(b"abcd ") for _ in range(5000)), np.uint8)
    whole = suffix_dedup.anchors(b)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    cut = suffix_dedup.anchors(b)
    owner = lambda a: np.repeat(a[1], a[3]).tolist()
    assert owner(whole) == owner(cut)


def test_empty_null_and_clashing(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == {}
    long = "x y z " * 60
    df = spark.createDataFrame([(1, long, "k"), (None, long, "k"), (2, "", "k")], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in suffix_dedup.repeated_bytes(df).collect()}
    assert got[None].n_removed == len(long) and bytes(got[2].kept) == b"" and got[1].n_removed < len(long)


def test_rows_with_no_or_equal_ids_are_documents_of_their_own(spark):
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    known, shared, same = fresh(150), fresh(150), fresh(200)
    texts = {"known": known + fresh(250), "alone": fresh(400), "one": shared + fresh(200), "two": shared + fresh(220)}
    rows = [(1, known)] + [(i, t) for i in (None, 7) for t in (texts["known"], texts["alone"])] + [(None, texts["one"]), (None, texts["two"]), (None, same), (None, same), (None, same)]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    of = lambda doc, n: sorted(x[2] for x in got if x[:2] == (doc, n))
    assert of(1, 150) == [0] and of(7, 400) == [0, 150] and of(None, 400) == [400, 400]  # 7 has both texts, so those without an id go
    assert of(None, 200) == [0, 200, 200] and sorted(of(None, 350) + of(None, 370)) == [0, 150]
