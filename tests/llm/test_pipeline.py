import random

import corpus_pipeline

SENTENCES = ["the old house stands near the river and the stone bridge", "we walk along the water in the morning light with the dog", "nobody knows who built the first wall around this small town"]


def test_stages(spark, tmp_path):
    text = lambda i: " ".join(f"{s} {chr(97 + i % 26)}{chr(97 + i // 26)}" for s in SENTENCES * 3)
    unlike = lambda i: " ".join("".join(random.Random(f"{i} {j}").choices("abcdefgh", k=4)) for j in range(40))
    rows = [(i, unlike(i), "en", "s", 1) for i in range(60)]
    rows += [(100, text(1), "en", "s", 1), (101, text(1) + " ", "en", "s", 1), (102, text(1) + " end", "en", "s", 1)]
    rows += [(200, None, "en", "s", 0), (201, "12 34", None, "s", 5), (202, unlike(77) + " card 4845168114407329", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == df.columns
    ids = {name: {r.doc_id for r in d.select("doc_id").collect()} for name, d in seen.items()}
    assert not {200, 201} & ids["language_id"] and {*range(60), 100, 101, 102, 202} <= ids["language_id"]
    assert ids["language_id"] - ids["exact_dedup"] == {100}  # 101 has more code points
    assert ids["exact_dedup"] - ids["near_dedup"] == {102}
    hidden = seen["pii"].filter("doc_id = 202").first()
    assert "4845168114407329" not in hidden.text and hidden.n_chars == len(hidden.text)
    assert ids["packing"] == ids["pii"] == ids["near_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def through(spark, df, path):
    """The documents after each stage but the last, and the last one's rows."""
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(path))
        assert docs.dtypes == df.dtypes
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, str(path))


def test_columns_of_any_name_stay(spark, tmp_path):
    unlike = lambda i: " ".join("".join(random.Random(f"{i} {j}").choices("abcdefgh", k=4)) for j in range(40))
    names = ["score", "lang_pred", "rejected", "_key", "_h", "_k1", "_h1", "_nth", "n_replaced", "_found", "c0", "held_out", "bucket"]
    rows = [(i, unlike(i % 9), "en", "s", 1, *[100 * i + k for k in range(len(names))]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    docs, packed = through(spark, df, tmp_path)
    got = docs.collect()
    assert {r.doc_id for r in got} == set(range(9))
    assert all([r[n] for n in names] == [100 * r.doc_id + k for k in range(len(names))] for r in got)
    assert packed.select("doc_id").distinct().count() == 9


def test_empty_unlabelled_repeated_and_very_long(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs, packed = through(spark, spark.createDataFrame([], schema), tmp_path)
    assert docs.count() == packed.count() == 0
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, "some words of a text", None, None, 20), (1, "some words of a text", None, None, 20), (None, "other words, without an id", None, "s", 26), (3, long, None, "s", len(long)), (4, None, None, None, None), (5, "", None, "s", 0)]
    docs, packed = through(spark, spark.createDataFrame(rows, schema), tmp_path)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None"]
    pieces = packed.filter("doc_id = 3").orderBy("piece").collect()
    assert len(pieces) > 1 and all(p.length == 4096 for p in pieces[:-1]) and [p.start for p in pieces] == [4096 * k for k in range(len(pieces))]


def test_pseudonyms_need_a_secret_of_the_session(spark, tmp_path):
    spark.conf.unset(corpus_pipeline.KEY)
    df = spark.createDataFrame([(1, "card 4845168114407329 here", "en", "s", 26)], "doc_id long, text string, lang string, source string, n_chars long")
    hide = lambda: corpus_pipeline.without_personal_data(spark, df, str(tmp_path)).first().text
    first = hide()
    assert first == hide() != df.first().text
    spark.conf.unset(corpus_pipeline.KEY)
    assert hide() != first
