"""Merges into stored tables: only touched buckets change, a failed merge leaves the table."""

from pathlib import Path

import pytest

from crate.sources import stored, tables

KIND = "id long, name string, n int"


def key(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(base, version_bucket):
    return {(p.name, p.stat().st_mtime_ns) for p in (Path(base) / "data" / version_bucket).iterdir()}


def test_merges_equal_those_of_tables_and_leave_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, f"a{i}", i) for i in range(40)] + [(None, "none", 0)], KIND)
    new = spark.createDataFrame([(3, "b3", None), (100, "b100", 1), (None, "some", 5)], KIND)
    stored.create(old, path, ["id"], 8)
    with pytest.raises(stored.Clash):
        stored.create(old, path, ["id"], 8)
    before = stored._manifest(spark, path)["at"]
    seen = {at: files(path, at) for at in before.values()}
    touched = stored.upsert(spark, path, new)
    after = stored._manifest(spark, path)["at"]
    assert 0 < len(touched) < 8 and {b for b in before if before[b] != after.get(b)} <= set(map(str, touched))
    assert all(files(path, at) == seen[at] for b, at in after.items() if int(b) not in touched)
    want = tables.upsert(old, new, ["id"])
    assert key(stored.read(spark, path)) == key(want)
    stored.patch(spark, path, new)
    want = tables.patch(want, new, ["id"])
    assert key(stored.read(spark, path)) == key(want) and key(stored.read(spark, path, 1)) == key(old)
    more = spark.createDataFrame([(3, "c", 9), (200, "c", 9)], KIND)
    stored.insert_or_ignore(spark, path, more)
    want = tables.insert_or_ignore(want, more, ["id"])
    stored.replace_group(spark, path, spark.createDataFrame([(5, "x", 1), (5, "y", 2)], KIND))
    assert key(stored.read(spark, path).filter("id <> 5 or id is null")) == key(want.filter("id <> 5 or id is null"))
    assert key(stored.lookup(spark, path, id=5)) == [(5, "x", 1), (5, "y", 2)] and stored.lookup(spark, path, id=None).count() == 1
    assert stored.upsert(spark, path, new.limit(0)) == []
    now = key(stored.read(spark, path))
    stored.vacuum(spark, path)
    assert key(stored.read(spark, path)) == now
    with pytest.raises(FileNotFoundError):
        stored.read(spark, path, 1)


def test_a_merge_that_fails_before_the_swap_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], KIND), spark.createDataFrame([(2, "c", 3)], KIND)
    stored.create(old, path, ["id"], 4)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(stored, "_swap", lost)
        stored.upsert(spark, path, new)
    assert key(stored.read(spark, path)) == key(old)
    stored.upsert(spark, path, new)
    assert key(stored.read(spark, path)) == [(1, "a", 1), (2, "c", 3)]
    state = stored._manifest(spark, path)
    with pytest.raises(stored.Clash):
        stored._swap(spark, path, state)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(spark.createDataFrame([], KIND), path, ["id"], 4)
    assert stored.read(spark, path).count() == 0
    stored.patch(spark, path, spark.createDataFrame([(1, "a", 1)], KIND))
    assert key(stored.read(spark, path)) == [(1, "a", 1)]
