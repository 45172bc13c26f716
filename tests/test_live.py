"""Tracklists of mixes from vectors: the batch by hand, the stream equal to the batch."""

import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from crate.operators import mixes
from crate.streaming import live

ITEMS = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)]


def test_runs_of_a_mix(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, vector array<double>")
    rows = [(7, 0.0, 15.0, [2.0, 0.1]), (7, 7.0, 22.0, [0.0, 0.0]), (7, 14.0, 29.0, [5.0, 0.0]), (7, 21.0, 36.0, [0.1, 3.0]), (7, 28.0, 43.0, None), (7, 35.0, 50.0, [1.0, 0.0]), (8, 0.0, 9.0, [-1.0, -1.0]), (None, 0.0, 1.0, [1.0, 1.0])]
    windows = spark.createDataFrame(rows, "mix_id long, start double, end double, vector array<double>")
    names = spark.createDataFrame([(1, "one")], "item_id long, name string")
    got = {(r.mix_id, r.run): (r.track_id, r.start, r.end, r.windows, round(r.score, 3), r.name) for r in mixes.tracklist(windows, items, names).collect()}
    assert got == {(7, 1): (1, 0.0, 29.0, 2, 1.0, "one"), (7, 2): (2, 21.0, 36.0, 1, 0.999, "2"), (7, 3): (1, 35.0, 50.0, 1, 1.0, "one"), (None, 1): (3, 0.0, 1.0, 1, 1.0, "3")}
    assert mixes.tracklist(windows.limit(0), items).count() == 0


def test_the_stream_equals_the_batch_on_windows_out_of_order(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, vector array<double>")
    rng = random.Random(4)
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, UTC)
    rows = [(m, i, at(10 * i), at(10 * i + 15), [float(rng.random() > 0.4), rng.random()]) for i in range(60) for m in (1, 2)]
    kind = "mix_id long, window_id long, start timestamp, end timestamp, vector array<double>"
    arrive = sorted(rows, key=lambda r: r[1] + rng.random() * 20)  # up to 200 seconds late
    folder = str(tmp_path / "in")
    for part in range(0, len(arrive), 40):
        spark.createDataFrame(arrive[part : part + 40], kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).parquet(folder)
        live.keep_matches(stream, items, str(tmp_path / "found")).option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start().awaitTermination()
        got = live.written(live.matches(spark, str(tmp_path / "found")), str(tmp_path / "out"), delay="5 minutes", gap="1 hour")
    early = got.count()
    end = spark.createDataFrame([(-1, 0, at(10_000), at(10_001), [1.0, 0.0])], kind)
    end.coalesce(1).write.mode("append").parquet(folder)
    live.keep_matches(spark.readStream.schema(kind).parquet(folder), items, str(tmp_path / "found")).option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start().awaitTermination()
    got = live.written(live.matches(spark, str(tmp_path / "found")), str(tmp_path / "out"), delay="5 minutes", gap="1 hour")
    want = mixes.tracklist(spark.createDataFrame(rows, kind), items)
    key = lambda df: sorted(map(tuple, df.select("mix_id", "track_id", "start", "end", "windows", F.round("score", 6)).collect()))
    assert key(got) == key(want) and 0 < early < want.count()
