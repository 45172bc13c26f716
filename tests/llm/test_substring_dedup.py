import random

from crate.llm import substring_dedup


def pieces(text, end):
    """(start, end) of what stands between line breaks, or after ends of sentences and white space, by looking at each character."""
    at, i = 0, 0
    while i < len(text):
        if (end == "\n" and text[i] == "\n") or (end != "\n" and text[i].isspace() and i and text[i - 1] in end):
            yield at, i
            at = i + 1
            while end != "\n" and at < len(text) and text[at].isspace():
                at += 1
            i = at
        else:
            i += 1
    yield at, len(text)


def brute(rows, min_words=0, sentences=False):
    """Marks every repeated line (or sentence) of rows in their order, then drops the marks of stretches that are too short."""
    seen, out = set(), []
    for text in rows:
        text, own, gone = text or "", set(), []
        for a, b in pieces(text, "\n"):
            inner = [(a + c, a + d) for c, d in pieces(text[a:b], ".!?") if text[a + c : a + d].strip()]
            for c, d in [(a, b), *(inner if sentences and len(inner) > 1 else [])]:
                name = " ".join(text[c:d].lower().split())
                if name and (name in seen or name in own) and not (gone and c < gone[-1][1]):
                    gone.append((c, d))
                own.add(name)
        seen |= own
        kept, stretch = [], []
        for i, (a, b) in enumerate(gone):
            stretch.append((a, b))
            if i + 1 == len(gone) or text[b : gone[i + 1][0]].strip():
                if sum(len(text[c:d].split()) for c, d in stretch) >= min_words:
                    kept += stretch
                stretch = []
        out.append(kept)
    return out


def test_units_keep_offsets():
    text = "One two three four five. Six seven eight nine ten!\nshort\n\nA b c d e"
    line = "One two three four five. Six seven eight nine ten!"
    assert [text[a:b] for a, b, _ in substring_dedup.units(text, sentences=True)] == [line, "One two three four five.", "Six seven eight nine ten!", "short", "A b c d e"]
    assert [text[a:b] for a, b, _ in substring_dedup.units(text)] == [line, "short", "A b c d e"]
    assert [text[a:b] for a, b, _ in substring_dedup.units(text, "paragraph")] == [f"{line}\nshort", "A b c d e"]


def test_against_brute_force(spark):
    rng = random.Random(1)
    sentences = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 9))) + "." for _ in range(60)]
    rows = [(i, "\n".join(" ".join(rng.choice(sentences) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, sentences[0].upper() + "  x"), (503, "\n".join(sentences) * 40), (504, "\n".join(f"line {k % 60_000}" for k in range(100_000)))]
    df = spark.createDataFrame([(i, t, 1, "x", 7) for i, t in rows], "doc_id long, text string, high int, gone string, row int")
    for min_words, inner in ((0, False), (20, True), (1, True)):
        want = dict(zip([i for i, _ in rows], brute([t for _, t in rows], min_words, inner), strict=True))
        assert sum(map(bool, want.values())) > 20
        for r in substring_dedup.substring_dedup(df, sentences=inner, min_words=min_words).collect():
            original = dict(rows)[r.doc_id] or ""
            spans = [(s.start, s.end) for s in r.spans]
            assert spans == want[r.doc_id]
            left, at = "", 0
            for a, b in spans:
                left, at = left + original[at:a], b
            assert r.text == left + original[at:] and r.n_removed == sum(b - a for a, b in spans) and r.n_chars == len(original)


def test_a_minimum_keeps_what_is_repeated_by_chance(spark):
    long = " ".join(f"word{i}" for i in range(20))
    texts = f"a short line of words\n{long}", f"a short line of words\nfresh\n{long}\na short line of words"
    assert removed(spark, *texts) == {0: [], 1: [long, "a short line of words"]}
    assert removed(spark, *texts, min_words=0) == {0: [], 1: ["a short line of words", long, "a short line of words"]}


def test_rows_without_an_id_or_with_one_id_are_documents_of_their_own(spark):
    line = "a line of six words here"
    texts = [(None, f"{line}\nnull one"), (None, f"{line}\nnull two"), (7, f"{line}\nseven"), (7, f"seven again\n{line}"), (7, "twice\nthe same"), (7, "twice\nthe same"), (9, line)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = substring_dedup.substring_dedup(df).collect()
    assert len(got) == len(texts)
    kept = [r for r in got if line in r.text]
    assert [r.doc_id for r in kept] == [7]
    assert sorted(r.n_removed for r in got if r.doc_id is None) == [len(line)] * 2
    assert sorted(r.text for r in got if "twice" in r.text or r.text == "\n") == ["\n", "twice\nthe same"]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def removed(spark, *texts, min_words=20):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.spans] for r in substring_dedup.substring_dedup(df, sentences=True, min_words=min_words).collect()}


def test_scripts_without_spaces(spark):
    chinese, thai = "我们今天去公园散步。天气非常好，大家都很高兴！", "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะ"
    got = removed(spark, f"{chinese}\n{thai}", f"开头的一句话跟前面不同。{chinese}\n短句", f"x\n{thai}\n短句", min_words=5)
    assert got == {0: [], 1: ["我们今天去公园散步。", "天气非常好，大家都很高兴！"], 2: [thai, "短句"]}


def test_passages_go_without_holes(spark):
    poem = "one two three\nfour five\nshort\na line of six words here\nend"
    talk = "Some words that are long enough. Yes. And then five words more."
    got = removed(spark, f"{poem}\n{talk}", f"other\n{poem}\nfresh words\nshort", f"New words open this line here. {talk} No.", "yes.\nshort\nend", min_words=5)
    assert got[0] == [] and got[1] == poem.split("\n") and got[3] == []
    assert got[2] == ["Some words that are long enough.", "Yes.", "And then five words more."]


def test_the_only_copy_stays_before_white_space(spark):
    assert removed(spark, "One two three four five. \n我们今天去公园散步了。 ", min_words=1) == {0: []}
