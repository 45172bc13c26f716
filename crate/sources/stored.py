"""Stored tables in buckets of a key: a merge rewrites the buckets that it touches, a manifest swapped last makes it count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crate.sources import tables
from crate.storage import saved

#: Buckets of a table if not given: more let a small merge rewrite less, each is a folder.
BUCKETS = 64


class Clash(RuntimeError):
    """Another job has changed the table since this one read it: run the merge again."""


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Store df below path in buckets of the hash of `keys` (null is a key like others). An existing table is an error."""
    spark = df.sparkSession
    if _versions(spark, path):
        raise Clash(f"there is a table at {path}")
    at = _write(df, path, 1, keys, buckets)
    _swap(spark, path, {"version": 1, "keys": keys, "buckets": buckets, "schema": df.schema.json(), "at": at})


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last version, or of an earlier one that vacuum() has not taken."""
    return _rows(spark, path, _manifest(spark, path, version), None)


def lookup(spark: SparkSession, path: str, **key) -> DataFrame:
    """Rows of one key: only its bucket is read."""
    state = _manifest(spark, path)
    if sorted(key) != sorted(state["keys"]):
        raise ValueError(f"the table's key is {state['keys']}")
    schema = _schema(state)
    one = spark.createDataFrame([tuple(key[k] for k in state["keys"])], T.StructType([T.StructField(k, schema[k].dataType) for k in state["keys"]]))
    bucket = one.select(_bucket(state["keys"], state["buckets"])).first()[0]
    return tables.where(_rows(spark, path, state, [bucket]), **{k: F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()})


def change(spark: SparkSession, path: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the rows of the buckets that new's keys fall into by merge(their old rows, new); returns those buckets.

    merge must work key by key (upsert, patch, insert_or_ignore, append, or replace_group by columns that include the table's key). Files of other
    buckets stay as they are. The manifest comes last: a job that ends before leaves the old table, and files that vacuum() takes.
    """
    state = _manifest(spark, path)
    bucket, version = _bucket(state["keys"], state["buckets"]), state["version"] + 1
    new = saved(new, "incoming")
    touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # at most a row a bucket
    if not touched:
        return []
    rows = merge(_rows(spark, path, state, touched), new).select(*_schema(state).names)
    written = _write(rows, path, version, state["keys"], state["buckets"])
    kept = {b: at for b, at in state["at"].items() if int(b) not in touched}
    _swap(spark, path, {**state, "version": version, "at": kept | written})
    return touched


def upsert(spark: SparkSession, path: str, new: DataFrame, keep: list[str] = ()) -> list[int]:
    keys = _manifest(spark, path)["keys"]
    return change(spark, path, new, lambda old, more: tables.upsert(old, more, keys, keep))


def patch(spark: SparkSession, path: str, new: DataFrame) -> list[int]:
    keys = _manifest(spark, path)["keys"]
    return change(spark, path, new, lambda old, more: tables.patch(old, more, keys))


def insert_or_ignore(spark: SparkSession, path: str, new: DataFrame) -> list[int]:
    keys = _manifest(spark, path)["keys"]
    return change(spark, path, new, lambda old, more: tables.insert_or_ignore(old, more, keys))


def replace_group(spark: SparkSession, path: str, new: DataFrame) -> list[int]:
    """All rows that have the table's key of a new row are replaced: the key is the group."""
    keys = _manifest(spark, path)["keys"]
    return change(spark, path, new, lambda old, more: tables.replace_group(old, more, keys))


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete files and manifests that the last version doesn't use, while no merge runs; readers of earlier versions fail from then on."""
    state = _manifest(spark, path)
    fs, Path = _fs(spark, path)  # noqa: N806
    used = set(state["at"].values())
    for version in _versions(spark, path):
        if version != state["version"]:
            fs.delete(Path(f"{path}/manifest/{version}.json"), False)
    for folder in fs.listStatus(Path(f"{path}/data")):
        name = folder.getPath().getName()
        for part in fs.listStatus(folder.getPath()):
            if f"{name}/{part.getPath().getName()}" not in used:
                fs.delete(part.getPath(), True)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _schema(state: dict) -> T.StructType:
    return T.StructType.fromJson(json.loads(state["schema"]))


def _rows(spark: SparkSession, path: str, state: dict, buckets: list[int] | None) -> DataFrame:
    wanted = [at for b, at in state["at"].items() if buckets is None or int(b) in buckets]
    schema = _schema(state)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{at}" for at in wanted)) if wanted else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, version: int, keys: list[str], buckets: int) -> dict[str, str]:
    """Write rows by bucket to a folder of their own: the folder of each bucket. Spark splits the write of a bucket that is much larger than others."""
    parts, folder = rows.withColumn("_bucket", _bucket(keys, buckets)).hint("rebalance", "_bucket"), f"{version}-{uuid.uuid4().hex}"
    parts.write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
    fs, Path = _fs(rows.sparkSession, path)  # noqa: N806
    names = [f.getPath().getName() for f in fs.listStatus(Path(f"{path}/data/{folder}"))]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}


def _fs(spark: SparkSession, path: str):
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    return Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, Path = _fs(spark, path)  # noqa: N806
    folder = Path(f"{path}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    found = _versions(spark, path)
    if not found or (version or found[-1]) not in found:
        raise FileNotFoundError(f"no such table or version: {path}")
    return json.loads(spark.read.text(f"{path}/manifest/{version or found[-1]}.json", wholetext=True).first()[0])


def _swap(spark: SparkSession, path: str, state: dict) -> None:
    """Write the manifest aside, then give it its name, unless another job has taken that version."""
    fs, Path = _fs(spark, path)  # noqa: N806
    aside, target = Path(f"{path}/manifest/_{state['version']}"), Path(f"{path}/manifest/{state['version']}.json")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        raise Clash(f"version {state['version']} of {path} is there already")
