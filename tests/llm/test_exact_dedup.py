import pytest
from pyspark.sql import functions as F

from crate.llm import exact_dedup

ROWS = [
    (1, "a b", "x"), (2, "ab", "x"), (3, " a b ", "x"), (4, " ab  ", "x"), (5, None, "x"), (6, "", "x"),
    (7, "\t\n", "x"), (8, "aé", "x"), (None, "q", "x"), (9, "q", "x"), (10, "z", "x"), (10, "z", "x"), (None, "n", "x"), (None, "n", "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, h string")


def test_groups_and_what_stays(spark):
    got = exact_dedup.exact_dedup(frame(spark, ROWS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(got) == len(ROWS)
    assert sorted(len(v) for v in by.values()) == [1, 2, 2, 2, 3, 4]
    for rows in by.values():
        assert sum(r.kept for r in rows) == 1
        assert {r.group_size for r in rows} == {len(rows)}
    keep = {r.doc_id: r.keep_id for r in got if r.doc_id is not None}
    assert keep[1] == keep[2] == keep[3] == keep[4] == 3  # five code points, as 4 has; the smaller id
    assert keep[5] == keep[6] == keep[7] == 7
    assert keep[9] == 9 and {r.keep_id for r in got if r.doc_id is None} == {9, None}


def test_directory_splits_full_buckets_only(spark):
    rows = [(i, f"text {i}", "x") for i in range(300)] + [(1000 + i, "same", "x") for i in range(400)]
    got = exact_dedup.exact_dedup(frame(spark, rows), bucket_keys=20).collect()
    load = {}
    for r in got:
        load.setdefault(r.bucket, set()).add(r.text_sha256)
    assert len(load) >= 16 and max(map(len, load.values())) <= 20
    assert {r.keep_id for r in got if r.doc_id >= 1000} == {1000}
    assert {r.chain for r in got} == {1}


def test_dropping_leaves_columns_alone(spark):
    kept = exact_dedup.drop_exact_copies(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "h"]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "n"), (3, " a b "), (7, "\t\n"), (8, "aé"), (9, "q"), (10, "z")]


def test_empty(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(frame(spark, [])).count() == 0


@pytest.mark.parametrize("extra", ["slot", "norm", "bucket"])
def test_clashing_names(spark, extra):
    df = frame(spark, ROWS[:3]).withColumnRenamed("h", extra)
    assert exact_dedup.exact_dedup(df).count() == 3


def test_the_directory_decides(spark, monkeypatch):
    """Rows are grouped and looked up in the bucket that the directory names: a directory that splits a slot splits its groups."""
    rows = [(i, "same text", "x") for i in range(6)] + [(9, "other", "x")]
    whole = exact_dedup._directory
    both = lambda keys, n: whole(keys, n).unionByName(whole(keys, n).withColumn("bucket", F.col("bucket") + 1))
    assert exact_dedup.exact_dedup(frame(spark, rows)).count() == 7
    monkeypatch.setattr(exact_dedup, "_directory", lambda keys, n: whole(keys, n).limit(0))
    assert exact_dedup.exact_dedup(frame(spark, rows)).count() == 0
    monkeypatch.setattr(exact_dedup, "_directory", both)
    assert exact_dedup.exact_dedup(frame(spark, rows)).count() == 14
