import math
import random

import numpy as np

from crate.llm import language_id

SYLLABLES = {"xx": ["ka", "to", "mi", "ra"], "yy": ["str", "eng", "und", "ich"], "zz": ["ção", "lho", "nha", "que"]}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    words = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))
    return [" ".join(words() for _ in range(rng.randint(8, 60))) + "." for _ in range(n)]


def models():
    return language_id.fit([(lang, t) for lang in SYLLABLES for t in texts(lang, 60, 1)])


def test_folding():
    show = lambda s: "".join(map(chr, language_id.folded(s)))
    assert show("Hé, 12 wörld!") == " hé wörld "
    assert show("...42") == "" and show("") == ""


def test_probabilities_sum_to_one():
    """Of all next characters after any context, unseen ones included, in each language."""
    m = models()
    chars = sorted({int(c) for lang in SYLLABLES for t in texts(lang, 60, 1) for c in language_id.folded(t)})
    for context in ("kat", "und", "zzz", " qu"):
        base = np.array([ord(c) for c in context], np.uint32)
        total = np.zeros(3)
        for c in [*chars, 0x4E2D]:  # one unseen character stands for the rest of the alphabet
            total += np.exp(-(m.losses(np.append(base, np.uint32(c))) - m.losses(base)))
        assert np.allclose(total, 1, atol=2e-3), (context, total)


def test_blocks_give_the_same(monkeypatch):
    m = models()
    chars = language_id.folded(" ".join(texts("xx", 10, 3)))
    whole = m.losses(chars)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert np.allclose(m.losses(chars), whole, rtol=1e-4)


def test_held_out_accuracy_and_rejection(spark):
    rows = [(i, t, lang) for lang in SYLLABLES for i, t in enumerate(texts(lang, 80, 2))]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "12 !!", "yy"), (903, "ψψψ ωωω φφφ χχχ ψωψω φχφχ ωφχ", "xx"), (None, texts("xx", 1, 5)[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = language_id.identified(df, models()).collect()
    known = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(r.rejected for r in got if r.doc_id is not None and r.doc_id >= 900)
    want = {t: lang for _, t, lang in rows}
    assert sum(r.lang_pred == want[r.text] for r in known) / len(known) > 0.98
    assert sum(r.rejected for r in known) <= 2


def test_sample_is_bounded_and_repeatable(spark):
    rows = [(i, f"text {i}", "xx" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = language_id.sample(df, per_lang=20), language_id.sample(df.repartition(7), per_lang=20)
    assert a == b and 5 <= len(a) <= 20
    assert language_id.sample(df.limit(0)) == []


def test_tables_without_languages(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, None), (3, "12 34", None)], "doc_id long, text string, lang string")
    for docs in (df, df.limit(0)):
        models = language_id.fit(language_id.sample(docs))
        got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in language_id.identified(docs, models).collect()}
        assert models is None and got in ({}, {1: ("und", 0.0, False), 2: ("und", 0.0, True), 3: ("und", 0.0, True)})


def test_fitting_rows_are_whole_and_bounded(spark):
    rows = [(i, "ab " * (50 + i), "x") for i in range(40)] + [(100, "long " * 5000, "y")]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=10, chars=1500)
    texts = {t for _, t, _ in rows}
    assert all(t in texts for _, t in got) and sum(len(t) for lang, t in got if lang == "x") <= 1500 and sum(lang == "y" for lang, _ in got) == 1


def plain_kneser_ney(texts, text):
    """Cross-entropy of the characters of `text` after its first, from counts in dictionaries, order by order."""
    from collections import Counter

    order, sets = language_id.ORDER, {}
    grams = {n: Counter(s[i : i + n] for s in texts for i in range(len(s) - n + 1)) for n in range(1, order + 1)}
    for n in range(1, order):
        before = Counter(g[1:] for g in grams[n + 1])
        sets[n] = {g: before.get(g, 1) for g in grams[n]}
    sets[order] = dict(grams[order])
    alphabet = max(2, len(grams[1]) + 1)
    discount, total, kinds = {}, {}, {}
    for n, counts in sets.items():
        ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
        total[n], kinds[n] = Counter(), Counter()
        for g, c in counts.items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(context, c):
        if context is None:
            return 1 / alphabet
        n, shorter = len(context) + 1, context[1:] if context else None
        if not total[n][context]:
            return p(shorter, c)
        own = max(sets[n].get(context + c, 0) - discount[n], 0) / total[n][context]
        return own + discount[n] * kinds[n][context] / total[n][context] * p(shorter, c)

    return -sum(float(np.log(p(text[max(0, i - order + 1) : i], text[i]))) for i in range(1, len(text)))


def test_models_against_plain_counts():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(1, 6))) for _ in range(40)]
    texts = [" " + " ".join(rng.choice(words, 30)) + " " for _ in range(6)]
    codes = [np.array([ord(c) for c in t], np.uint32) for t in texts]
    models = language_id._smoothed({"x": codes})
    for text in (texts[0], " abz gfe ", " zzz "):
        got = models.losses(np.array([ord(c) for c in text], np.uint32))[0]
        assert abs(got - plain_kneser_ney(texts, text)) < 1e-3 * len(text)
