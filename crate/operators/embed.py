"""Cached embedding jobs: a function that is handed in turns windows of samples into vectors, for tracks that have none yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from crate.operators.classify import mean_vectors
from crate.sources.tables import worklist
from crate.storage import saved

VECTORS, WINDOWS, ERRORS = (
    "track_id long, vector array<double>, model string",
    "track_id long, window_id long, vector array<double>, model string",
    "track_id long, window_id long, error string, model string",
)


@dataclass(frozen=True)
class Model:
    """A name and what loads the model: called once in a worker, it gives a function of samples and their rate."""

    name: str
    load: Callable[[], Callable[[np.ndarray, int], np.ndarray]]


_registered: dict[str, Model] = {}
_loaded: dict[str, Callable] = {}  # of this worker


def register(name: str, load: Callable[[], Callable[[np.ndarray, int], np.ndarray]]) -> Model:
    """A model that jobs may name."""
    _registered[name] = Model(name, load)
    return _registered[name]


def model_of(model: Model | str) -> Model:
    return _registered[model] if isinstance(model, str) else model


def embedded_windows(windows: DataFrame, model: Model | str) -> DataFrame:
    """track_id, window_id, vector, error of windows (track_id, window_id, samples, rate): either a vector or why there is none.

    A window whose samples are null, for which the model raises, or whose vector is empty or not finite, has an error; the rows beside it
    don't. Batches come as Arrow, samples as views of them.
    """
    model = model_of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.name not in _loaded:
            _loaded[model.name] = model.load()
        embed = _loaded[model.name]
        for batch in batches:
            vectors, errors = [], []
            for samples, rate in zip(batch.column("samples"), batch.column("rate").to_pylist(), strict=True):
                vector, error = None, None
                try:
                    if not samples.is_valid:
                        raise ValueError("no samples")
                    found = np.asarray(embed(np.asarray(samples.values), rate), dtype=float).ravel()
                    if not len(found) or not np.isfinite(found).all():
                        raise ValueError("no finite vector")
                    vector = found
                except Exception as e:  # whatever a model raises is that window's error
                    error = str(e) or type(e).__name__
                vectors.append(vector)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("track_id"), batch.column("window_id"), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], ["track_id", "window_id", "vector", "error"])

    rows = windows.select(F.col("track_id").cast("long"), F.col("window_id").cast("long"), F.col("samples").cast("array<double>"), "rate")
    return rows.mapInArrow(run, "track_id long, window_id long, vector array<double>, error string")


def stored(spark: SparkSession, path: str, schema: str, model: str | None = None) -> DataFrame:
    """Rows of a table of the store, of one model if it is named; none where nothing has been written."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    return rows if model is None else rows.filter(F.col("model") == model)


def embed_job(windows: DataFrame, path: str, model: Model | str, labelled: DataFrame | None = None, force: bool = False) -> DataFrame:
    """track_id, error of the tracks that this run has worked on; vectors, windows of labelled tracks and errors go to tables below path.

    Work-list: tracks without a vector of this model and without an error (quarantine), or all with `force`, which replaces the model's
    partitions and no others. A track's vector is the unit mean of its windows; if any of them has an error, the track has none, and its
    errors are kept. `labelled` (track_id): whose windows' vectors are kept too. Vectors are computed once and written from a saved table.
    """
    spark, model = windows.sparkSession, model_of(model)
    done = stored(spark, f"{path}/vectors", VECTORS, model.name).select("track_id").unionByName(stored(spark, f"{path}/errors", ERRORS, model.name).select("track_id")).distinct()
    todo = worklist(windows, done, "track_id", force)
    found = saved(embedded_windows(todo, model).withColumn("model", F.lit(model.name)), "embedded")
    bad = found.filter("error is not null")
    good = found.join(bad.select("track_id").distinct(), "track_id", "left_anti")
    vectors = mean_vectors(good, "track_id").withColumn("model", F.lit(model.name))
    kept = good.join(labelled.select("track_id").distinct(), "track_id", "left_semi") if labelled is not None else good.limit(0)
    for name, rows in (("vectors", vectors), ("windows", kept.drop("error")), ("errors", bad.drop("vector"))):
        writer = rows.write.partitionBy("model").mode("overwrite" if force else "append")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")
    first = bad.groupBy("track_id").agg(F.min_by("error", "window_id").alias("error"))
    return found.select("track_id").distinct().join(first, "track_id", "left")
