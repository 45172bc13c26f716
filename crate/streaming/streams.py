"""Stream forms of the batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crate.functions.vectors import l2_normalize


def ingest(stream: DataFrame, key: str = "content_hash", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Rows of which no earlier row within the watermark has the key."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Counts and sums by window and key, sent once the watermark has passed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


#: Times are whole microseconds, NONE where there is none; a mix is its id and whether it lacks one.
NONE = (1 << 63) - 1
RUN = "mix_id long, lacks boolean, best string, first long, last long, windows long, score double"
OPEN = "mix_id array<long>, lacks array<boolean>, best array<string>, first array<long>, last array<long>, windows array<long>, score array<double>, due array<long>"


def tracklist(stream: DataFrame, floor: float = 0.0, gap: str = "1 hour", delay: str = "10 minutes", order: str | None = None, buckets: int = 4096) -> DataFrame:
    """Runs of windows (mix_id, best, score, ts) with one best match: sent when the match changes, or when nothing came for `gap`.

    Windows below the floor are left out before, so they don't break a run; a window late within the batch is put in order, one older
    than the open run's end is counted to it. Equal times go by `order`, a column of whole numbers, null last.

    Mixes are dealt to buckets by a hash; state is the open runs of a bucket, so that a call works on many mixes at once. A batch writes
    the state of the buckets that it meets anew: take more buckets for a stream of small batches over very many open mixes.
    """
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)
    names = ["mix_id", "lacks", "best", "first", "last", "windows", "score"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = dict(zip([*names, "due"], state.get if state.exists else [[]] * 8, strict=True))
        new = [] if state.hasTimedOut else list(batches)
        old, size = len(held["mix_id"]), sum(map(len, new))
        column = lambda c, kind: np.concatenate([np.array(x[c], kind) for x in (held, *new)])
        both = lambda c, kind, x: np.r_[np.array(held[c], kind), x]
        at = np.concatenate([np.zeros(0, "int64"), *[x["at"].to_numpy() for x in new]])
        seq = np.concatenate([np.zeros(old, "int64"), *[x["seq"].to_numpy() for x in new]])
        mix, lacks, score = column("mix_id", "int64"), column("lacks", bool), column("score", float)
        best = column("best", object)
        fresh = np.arange(old + size) >= old
        by = np.lexsort((seq, np.r_[np.zeros(old, "int64"), at], fresh, mix, lacks))  # a mix's open run comes first
        mix, lacks, best, score, fresh = mix[by], lacks[by], best[by], score[by], fresh[by]
        first, last = both("first", "int64", at)[by], both("last", "int64", at)[by]
        windows, due = both("windows", "int64", np.ones(size, "int64"))[by], both("due", "int64", np.zeros(size, "int64"))[by]
        kind = pd.factorize(best)[0]  # null: -1
        other = np.r_[True, (mix[1:] != mix[:-1]) | (lacks[1:] != lacks[:-1])][: len(by)]
        starts = np.flatnonzero(other | np.r_[True, kind[1:] != kind[:-1]][: len(by)])
        if not len(starts):
            return
        ends = np.r_[starts[1:], len(by)] - 1
        is_open = np.r_[other[1:], True][ends]
        last = np.maximum.reduceat(np.where(last == NONE, -NONE, last), starts)
        came = fresh[ends]  # of an open run: whether its mix has windows in this batch
        due = np.where(came, np.maximum(np.where(last == -NONE, now, last // 1000 + wait), now + 1), due[starts])
        stay = is_open & (came | (due >= now))
        runs = [mix[starts], lacks[starts], best[starts], first[starts], np.where(last == -NONE, NONE, last), np.add.reduceat(windows, starts), np.maximum.reduceat(score, starts)]
        if stay.any():
            state.update(tuple(x[stay].tolist() for x in (*runs, due)))
            state.setTimeoutTimestamp(max(int(due[stay].min()), now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({c: x[~stay] for c, x in zip(names, runs, strict=True)})

    whole = lambda c: F.coalesce(c, F.lit(NONE))
    rows = stream.filter(F.col("score") >= floor).withWatermark("ts", delay)
    seq = whole(F.col(order).cast("long")) if order else F.lit(0).cast("long")
    rows = rows.select(
        F.pmod(F.xxhash64("mix_id"), F.lit(buckets)).alias("bucket"),
        F.coalesce(F.col("mix_id").cast("long"), F.lit(0).cast("long")).alias("mix_id"),
        F.col("mix_id").isNull().alias("lacks"),
        "best",
        F.col("score").cast("double").alias("score"),
        whole(F.unix_micros("ts")).alias("at"),
        seq.alias("seq"),
        "ts",
    )
    found = rows.groupBy("bucket").applyInPandasWithState(run, RUN, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: F.timestamp_micros(F.nullif(F.col(c), F.lit(NONE)))
    return found.select(F.when(~F.col("lacks"), F.col("mix_id")).alias("mix_id"), "best", time("first").alias("first_ts"), time("last").alias("last_ts"), "windows", "score")


def centroid_sums(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """genre_id, i, s, n: running sums of confirmed vectors; a foreachBatch step adds a batch (genre_id, vector) to them."""
    new = batch.select("genre_id", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x")).groupBy("genre_id", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    both = new if old is None else old.unionByName(new)
    return both.groupBy("genre_id", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


SUMS = "genre_id long, i int, s double, n long, batch long"


def keep_centroids(stream: DataFrame, store: str) -> DataStreamWriter:
    """A writer that keeps the running sums of a stream of confirmations (genre_id, vector) below store, a folder a batch.

    Batch k is made of the folder of batch k - 1 and replaces its own, so a batch that runs again after a failure comes to the same.
    The caller sets trigger and checkpoint and starts it.
    """

    def step(batch: DataFrame, k: int) -> None:
        old = batch.sparkSession.read.schema(SUMS).parquet(store).filter(F.col("batch") == k - 1).drop("batch") if k else None
        centroid_sums(old, batch).write.mode("overwrite").parquet(f"{store}/batch={k}")

    return stream.writeStream.foreachBatch(step)


def kept_centroids(spark: SparkSession, store: str) -> DataFrame:
    """genre_id, vector: unit centroids of the last batch below store."""
    sums = spark.read.schema(SUMS).parquet(store)
    last = sums.agg(F.max("batch").alias("batch"))  # one row
    means = sums.join(F.broadcast(last), "batch").select("genre_id", F.struct("i", (F.col("s") / F.col("n")).alias("m")).alias("c"))
    gathered = means.groupBy("genre_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return gathered.select("genre_id", l2_normalize(F.transform("c", lambda c: c["m"])).alias("vector"))
