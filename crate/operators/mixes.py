"""Tracklists of mixes: the best match of each window, runs of equal best matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crate.operators.knn import top_k
from crate.storage import saved


def merged_runs(windows: DataFrame, floor: float = 0.0) -> DataFrame:
    """mix_id, run, best, first_seq, last_seq, score from windows (mix_id, seq, best, score).

    Windows below the floor are left out first, so they don't break a run.
    """
    order = Window.partitionBy("mix_id").orderBy("seq")
    kept = windows.filter(F.col("score") >= floor)
    changed = kept.withColumn("new", (~F.col("best").eqNullSafe(F.lag("best").over(order)) | (F.row_number().over(order) == 1)).cast("long"))
    runs = changed.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("mix_id", "run", "best").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("score").alias("score"))


def matched(windows: DataFrame, items: DataFrame, floor: float = 0.0) -> DataFrame:
    """The windows (mix_id, vector and others) less their vector, with track_id and score: the item (item_id, vector) most like each.

    Ties go to the smaller id. Windows without direction, null ones and those whose best match is below the floor are left out.
    """
    asked = saved(windows.filter(F.exists("vector", lambda x: x != 0)).withColumn("_window", F.monotonically_increasing_id()), "asked")
    found = top_k(asked, items, 1, query_id="_window", skip_same_id=False).filter(F.col("score") >= floor)
    return asked.drop("vector").join(found.select(F.col("query_id").alias("_window"), F.col("item_id").alias("track_id"), "score"), "_window").drop("_window")


def tracklist(windows: DataFrame, items: DataFrame, names: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """mix_id, run, track_id, start, end, windows, score, name: windows (mix_id, start, end, vector) as runs of one best match.

    A run lasts from its first window's start to its last one's end, its score is the best of its windows. Windows that matched() leaves out
    don't break a run; ties of start go by end, then track. names: item_id, name; the id where there is none.
    """
    order = Window.partitionBy("mix_id").orderBy("start", "end", "track_id")
    found = matched(windows.select("mix_id", "start", "end", "vector"), items, floor)
    new = F.coalesce((F.lag("track_id").over(order) != F.col("track_id")).cast("long"), F.lit(1))
    rows = found.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("end", F.struct("start", "end"))
    runs = rows.groupBy("mix_id", "run", "track_id").agg(F.min("start").alias("start"), last.alias("end"), F.count("*").alias("windows"), F.max("score").alias("score"))
    if names is not None:
        runs = runs.join(names.select(F.col("item_id").alias("track_id"), "name"), "track_id", "left")
    name = F.coalesce(F.col("name") if names is not None else F.lit(None), F.col("track_id").cast("string"))
    return runs.select("mix_id", "run", "track_id", "start", "end", "windows", "score", name.alias("name"))
