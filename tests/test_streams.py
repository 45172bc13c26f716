import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from crate.operators import classify
from crate.streaming import streams


def test_duplicates_are_dropped_by_hash(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "content_hash string, s long").select("content_hash", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = streams.ingest(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_running_sums_equal_the_batch(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "genre_id long, vector array<double>")
    b = spark.createDataFrame([(1, [3.0, 0.0])], "genre_id long, vector array<double>")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(streams.centroid_sums(streams.centroid_sums(None, a), b)) == key(streams.centroid_sums(None, a.union(b)))


def test_centroids_of_a_stream_survive_a_batch_that_runs_again(spark, tmp_path):
    base, store, state = str(tmp_path / "in"), str(tmp_path / "sums"), str(tmp_path / "state")
    kind = "genre_id long, vector array<double>"
    batches = [[(1, [1.0, 2.0]), (2, [0.0, 1.0])], [(1, [3.0, 0.0])], [(3, None), (2, [0.0, 5.0])]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(base)
        stream = spark.readStream.schema(kind).parquet(base)
        streams.keep_centroids(stream, store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    expected = classify.mean_vectors(spark.createDataFrame(sum(batches, []), kind), "genre_id")
    key = lambda df: sorted((r.genre_id, [round(x, 9) for x in r.vector]) for r in df.collect())
    assert key(streams.kept_centroids(spark, store)) == key(expected)
    old = spark.read.schema(streams.SUMS).parquet(store).filter("batch = 1").drop("batch")
    again = spark.createDataFrame(batches[2], kind)
    streams.centroid_sums(old, again).write.mode("overwrite").parquet(f"{store}/batch=2")
    assert key(streams.kept_centroids(spark, store)) == key(expected)


def test_runs_of_many_mixes_share_the_state_of_a_bucket(spark, tmp_path):
    """Runs equal those worked out mix by mix over the same batches; equal times go by order; no id, no match and no time are values as others."""
    rng = random.Random(7)
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, UTC)
    kind = "mix_id long, best string, score double, ts timestamp, n long"
    mixes = [None, 0, *range(5, 120), (1 << 62) + 1]
    # In the second batch some mixes have no windows; the last two lie far ahead, so that what is open is sent.
    batches = [[(m, rng.choice(["a", "b", None]), float(rng.randint(0, 9)), at(600 * k + rng.randint(0, 40)), rng.randrange(10**6)) for m in mixes for _ in range(rng.randint(0, 12))] for k in range(2)]
    batches[0] += [(7, "x", 9.0, None, 1), (7, "x", 9.5, None, 2)]
    batches += [[(-1, "-", 9.0, at(10_000_000 * k), 1)] for k in (1, 2)]
    want, held = [], {}
    for rows in batches[:2]:
        for m, best, score, ts, _ in sorted((r for r in rows if r[2] >= 3), key=lambda r: (r[3] is None, r[3] or at(0), r[4])):
            run = held.get(m)
            if run and run[0] == best:
                held[m] = [best, run[1], max(filter(None, (run[2], ts)), default=None), run[3] + 1, max(run[4], score)]
            else:
                want += [(m, *run)] if run else []
                held[m] = [best, ts, ts, 1, score]
    want += [(m, *run) for m, run in held.items()]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    states = []
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        found = streams.tracklist(spark.readStream.schema(kind).parquet(folder), floor=3.0, gap="30 days", order="n", buckets=5)
        run = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.parquet(f"{out}/rows").select("mix_id", "best", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "windows", "score")
    micros = lambda ts: ts and round(ts.timestamp() * 1e6)
    key = lambda rows: sorted(rows, key=repr)
    assert key(tuple(r) for r in got.filter("best is null or best <> '-'").collect()) == key((m, b, micros(f), micros(e), n, s) for m, b, f, e, n, s in want)
    assert 0 < states[0] <= 5 and states[1] <= 5
