"""Keyed tables as DataFrames: merges, work-lists, integrity. Each function returns the table that replaces the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema(text: str) -> T.StructType:
    """Declared, never inferred: 'id long, path string'."""
    return T._parse_datatype_string(text)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """The row of new wins by key; of several new ones an arbitrary but single one. Columns in `keep` stay as they were."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    kept = [F.coalesce(F.max(F.when(F.col("_batch") == 0, F.col(c))).over(w), F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns]
    return both.select(*kept, F.row_number().over(w.orderBy(F.desc("_batch"))).alias("_n")).filter("_n = 1").drop("_n")


def patch(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge on null-safe keys: new values where there are any, else the old ones."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = o.join(n, on, "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def append(log: DataFrame, new: DataFrame, id_col: str = "event") -> DataFrame:
    """An append-only log with new events: what stands in it never changes; an event that it has already is not added again."""
    return log.unionByName(new.join(log.select(id_col), id_col, "left_anti").select(*log.columns))


def import_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """path, content_hash, state of listed files: `added` the first of a content that the library lacks, `seen` otherwise."""
    have = known.select("content_hash", F.lit(True).alias("_have")).distinct()
    nth = F.row_number().over(Window.partitionBy("content_hash").orderBy("path"))
    rows = paths.select("path", "content_hash", nth.alias("_n")).join(have, "content_hash", "left")
    return rows.select("path", "content_hash", F.when(F.col("_have").isNull() & (F.col("_n") == 1), "added").otherwise("seen").alias("state"))


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: n, and for each name how many rows its condition holds for."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def replace_group(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """All rows of the groups that new has are replaced."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def worklist(items: DataFrame, results: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items without a result, or all of them."""
    return items if force else items.join(results.select(key), key, "left_anti")


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows without the error column, and the rest for quarantine."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def cascade(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of parents that are still there."""
    return child.join(parents.select(key), key, "left_semi")


def set_null(child: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """References to parents that are gone become null."""
    p = parents.select(F.col(parent_key).alias("_p")).distinct()
    return child.join(p, F.col(key) == F.col("_p"), "left").withColumn(key, F.col("_p")).drop("_p").select(*child.columns)


def where(df: DataFrame, **equal) -> DataFrame:
    """Rows by optional conditions: an argument that is None is left out; a Column is taken as it is."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(value if isinstance(value, Column) else F.col(name) == value)
    return df


def page(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def write_space(df: DataFrame, path: str) -> None:
    """Vectors of several embedding spaces, a folder for each model: readers of one space read only its files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_space(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("model") == model)


AUDIO = ("mp3", "flac", "wav", "aiff", "aif", "m4a", "ogg")


def manifest(spark: SparkSession, root: str, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """path, content_hash, fmt, length of the files below root, by extension; unreadable files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    fmt = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("fmt", fmt).filter(F.col("fmt").isin(*extensions)).select("path", F.sha1("content").alias("content_hash"), "fmt", "length")


def write_dump(df: DataFrame, path: str) -> None:
    """The columns in their order, tab-separated, without a header or quotes: what read_dump() reads."""
    df.write.csv(path, sep="\t", nullValue="\\N", quote="", escapeQuotes=False)


def read_dump(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Tab-separated dump without a header; \\N is null."""
    return spark.read.csv(path, sep="\t", schema=columns, nullValue="\\N", quote="")
