import numpy as np
from pyspark.sql import functions as F

from crate.operators import embed


def load():
    def loaded():
        def run(samples, rate):
            if rate <= 0:
                raise ValueError(f"rate {rate}")
            return np.array([samples.mean(), np.abs(samples).max()])

        return run

    return loaded


def windows(spark, tracks=6):
    rows = [(t, 10 * t + w, [float(t + w), -1.0, 2.0], 0 if (t, w) == (3, 1) else 8_000) for t in range(tracks) for w in range(3)]
    rows.append((90, 900, None, 8_000))
    return spark.createDataFrame(rows, "track_id long, window_id long, samples array<double>, rate int")


def test_jobs(spark, tmp_path):
    path = str(tmp_path / "space")
    model = embed.register("plain", load())
    w = windows(spark)
    labelled = spark.createDataFrame([(1,), (3,)], "track_id long")
    got = {r.track_id: r.error for r in embed.embed_job(w, path, "plain", labelled).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "rate 0", 4: None, 5: None, 90: "no samples"}
    vectors = {r.track_id: r.vector for r in embed.stored(spark, f"{path}/vectors", embed.VECTORS, "plain").collect()}
    assert set(vectors) == {0, 1, 2, 4, 5}
    each = np.mean([[(t + 1.0) / 3, max(t, 2.0)] for t in (2, 3, 4)], axis=0)
    assert np.allclose(vectors[2], each / np.linalg.norm(each))
    kept = embed.stored(spark, f"{path}/windows", embed.WINDOWS).collect()
    assert sorted(r.window_id for r in kept) == [10, 11, 12]  # of 3, which has an error, none
    files = lambda: {p.name for p in (tmp_path / "space").rglob("part-*")}
    before = files()
    assert embed.embed_job(w, path, "plain", labelled).count() == 0  # nothing is left to do
    assert embed.stored(spark, f"{path}/vectors", embed.VECTORS).count() == 5
    more = windows(spark, 8)
    assert {r.track_id for r in embed.embed_job(more, path, model).collect()} == {6, 7}
    assert before <= files()
    assert embed.stored(spark, f"{path}/vectors", embed.VECTORS).count() == 7


def test_force_replaces_one_model_only(spark, tmp_path):
    path = str(tmp_path / "space")
    w = windows(spark, 3).filter("track_id < 3")
    ones, twos = (embed.Model(name, lambda v=v: lambda s, r: np.array([v, v])) for name, v in (("one", 1.0), ("two", 2.0)))
    embed.embed_job(w, path, ones)
    embed.embed_job(w, path, twos)
    other = {p.name for p in (tmp_path / "space").rglob("model=one/part-*")}
    embed.embed_job(w.filter("track_id = 1"), path, embed.Model("two", lambda: lambda s, r: np.array([0.0, -3.0])), force=True)
    found = {(r.model, r.track_id): r.vector for r in embed.stored(spark, f"{path}/vectors", embed.VECTORS).collect()}
    assert set(found) == {("one", 0), ("one", 1), ("one", 2), ("two", 1)} and {p.name for p in (tmp_path / "space").rglob("model=one/part-*")} == other


def test_no_windows(spark, tmp_path):
    model = embed.Model("none", lambda: lambda s, r: np.ones(2))
    assert embed.embed_job(windows(spark).limit(0), str(tmp_path / "space"), model).count() == 0
    got = embed.embedded_windows(spark.createDataFrame([(1, 2, [1.0], 5), (1, 3, [float("nan")], 5)], "track_id long, window_id long, samples array<double>, rate int"), embed.Model("same", lambda: lambda s, r: s))
    assert sorted((r.window_id, r.error) for r in got.select(F.col("window_id"), "error").collect()) == [(2, None), (3, "no finite vector")]
