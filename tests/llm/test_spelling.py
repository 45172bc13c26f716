import random
import re
import zlib
from collections import Counter

import numpy as np

from crate.llm import spelling


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_apart(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = [n, len(near), best if best and counts[best] >= 2 * n else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return out


def words_of(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            counts[word] += len(word) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def check(found, counts):
    want = plainly(counts)
    assert len(found) == len(want)
    for r in found:
        n, n_near, form, root = want[r.word]
        assert (r.n, r.n_near, r.form, r.root) == (n, n_near, form, root)
        assert r.form_n == (counts[form] if form else None)


def corpus():
    rng = random.Random(5)
    words = ["letter", "latter", "litter", "Letters", "bitter", "better", "éclair", "ÉCLAIR", "eclair", "naïve", "naive", "aaaaa", "aaaaaa", "aaaaaaa", "short", "four", "x×y÷zz", "straße"]
    words += ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))) for i in range(120)]
    long = "q" * 200
    return [*rows, (None, "letter letter better"), (None, None), (7, ""), (7, "letter better better"), (900, " ".join(["hot hotter"] * 20_000)), (901, f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]} {long}z")]


def test_words_and_forms_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    counts = words_of(rows)
    assert any(zlib.crc32(f"{i}:letter".encode()) % 97 == 0 for i in range(10_000))
    check(spelling.spelling_variants(df).collect(), counts)


def test_chains_ties_and_small_passes(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BYTES", 200)  # several passes
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10, "zzzz日": 9, "lonely": 4, "z" * 300: 4, "z" * 299: 8}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.variants(df).collect()
    check(found, counts)
    assert {r.word: r.root for r in found}["aaaaa"] == "abbbb"
    assert {r.word: r.form for r in found}["zzzzz"] == "zzzzx"  # a tie


def test_empty_and_null(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).count() == 0
    got = spelling.variants(spark.createDataFrame([(None, 3), ("alone", 1)], "word string, n long")).collect()
    assert [tuple(r) for r in got] == [("alone", None, "alone", 1, 0, None)]


def test_filters_hold_every_word(spark):
    words = ["".join(random.Random(i).choices("abcdefgh", k=5 + i % 4)) for i in range(3_000)]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    loads = Counter(map(len, set(words)))
    known = spelling.filters(df, loads, 0, 1)
    false = 0
    for length in loads:
        own = [w for w in set(words) if len(w) == length]
        assert known.holds(length, spelling.word_hashes(spelling._points(own, length))).all()
        other = ["".join(random.Random(-i).choices("ijklmnop", k=length)) for i in range(1, 2_000)]
        false += known.holds(length, spelling.word_hashes(spelling._points(other, length))).mean()
    assert false / len(loads) < 0.02


def test_edits_are_those_of_the_word():
    class All:
        def holds(self, length, hashes):
            seen.append(hashes)
            return np.ones(len(hashes), bool)

    seen: list = []
    points = spelling._points(["aabca"], 5)
    found = [(int(p), chr(c) if c else "") for _, at, letters in spelling.edits(points, np.array([97, 98, 99], np.uint32), All()) for p, c in zip(at, letters, strict=True)]
    made = ["aabca"[:p] + c + "aabca"[p + 1 :] for p, c in found]
    assert len(made) == len(set(made)) == 4 + 3 * 2 + 1
    hashes = np.concatenate(seen)
    for word, h in zip(made, hashes, strict=True):
        assert spelling.word_hashes(spelling._points([word], len(word)))[0] == h
