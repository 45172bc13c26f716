"""Tracklists while the mixes play: windows matched batch by batch, runs from typed state that waits for late windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from crate.operators.mixes import matched

MATCHES = "mix_id long, window_id long, start timestamp, end timestamp, track_id long, score double"
RUNS = "mix_id long, track_id long, start timestamp, end timestamp, windows long, score double"
#: The state store that transformWithState needs; set it before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_RUN = "track_id long, start timestamp, end timestamp, windows long, score double"
_WAITING = "start timestamp, end timestamp, window_id long, track_id long, score double"


def keep_matches(stream: DataFrame, items: DataFrame, store: str, floor: float = 0.0) -> DataStreamWriter:
    """A writer that matches a stream of windows (mix_id, window_id, start, end, vector) with items (item_id, vector) into store, a folder a batch.

    Each batch is a similarity join of its own, so the items may be of any number. A batch that runs again replaces its folder.
    """

    def step(batch: DataFrame, k: int) -> None:
        windows = batch.select("mix_id", "window_id", "start", "end", "vector")
        rows = matched(windows, items, floor)
        rows.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in MATCHES.split(", "))).write.mode("overwrite").parquet(f"{store}/batch={k}")

    return stream.writeStream.foreachBatch(step)


def matches(spark: SparkSession, store: str) -> DataFrame:
    """What keep_matches() writes below store, as a stream."""
    return spark.readStream.schema(MATCHES).parquet(f"{store}/batch=*")


class Runs(StatefulProcessor):
    """State of a mix: the open run, and the windows that the watermark has not passed yet, in which late ones find their place."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _RUN)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None
        for batch in rows:
            if len(batch):
                self.waiting.appendList([tuple(r) for r in batch[["start", "end", "window_id", "track_id", "score"]].itertuples(index=False)])
                top = batch["start"].max()
                last = top if last is None else max(last, top)
        if last is not None:
            self.handle.registerTimer(_ms(last))
        yield self._settled(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._settled(key, timerValues)

    def _settled(self, key: tuple, timer_values) -> pd.DataFrame:
        """The runs that have ended: windows up to the watermark are put in order and counted, the others wait on."""
        now = timer_values.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted({(r[0], r[1], r[3], r[2], r[4]) for r in held if _ms(r[0]) <= now})
        run, out = (list(self.open.get()) if self.open.exists() else None), []
        for start, end, track, _, score in ready:
            if run and run[0] == track:
                run[2], run[3], run[4] = end, run[3] + 1, max(run[4], score)
            else:
                if run:
                    out.append((*key, *run))
                run = [track, start, end, 1, score]
        if len(ready):
            later = [r for r in held if _ms(r[0]) > now]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        else:
            later = held
        if run and not later and _ms(run[2]) + self.gap <= now:
            out.append((*key, *run))
            run = None
        if run:
            self.open.update(tuple(run))
            self.handle.registerTimer(max(_ms(run[2]) + self.gap, now + 1))
        elif self.open.exists():
            self.open.clear()
        return pd.DataFrame(out, columns=["mix_id", "track_id", "start", "end", "windows", "score"])

    def close(self) -> None:
        pass


def _ms(time) -> int:
    return int(pd.Timestamp(time).value // 1_000_000)


def tracklist(found: DataFrame, delay: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """mix_id, track_id, start, end, windows, score: runs of one best match, from a stream of MATCHES in any order within `delay`.

    A window is counted once the watermark has passed its start, in order of (start, end, track), so that the runs are those of the batch. A run is sent when
    another track follows, or when nothing has come for `gap` after its end. A window that is sent twice while it waits counts once.
    """
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = found.withWatermark("start", delay).select("mix_id", "window_id", "start", "end", "track_id", "score")
    return rows.groupBy("mix_id").transformWithStateInPandas(Runs(wait), RUNS, "append", "eventTime")


def written(found: DataFrame, out: str, **options) -> DataFrame:
    """The tracklist of what stands in the stream now, written below `out` and read: for jobs that run from time to time."""
    spark = found.sparkSession
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        run = tracklist(found, **options).writeStream.format("parquet").option("path", f"{out}/runs").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(STORE[0], before)
    return spark.read.schema(RUNS).parquet(f"{out}/runs")
