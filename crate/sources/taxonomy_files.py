"""Taxonomy in JSON tiers, and graphs written and read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crate.storage import saved

NODE = "name string, description string, parents array<string>, children array<string>"


def read_tiers(spark: SparkSession, index: str, main: str, detailed: str) -> tuple[DataFrame, DataFrame]:
    """nodes (name, description) and edges (parent, child) of three tiers of JSON files, each `{"genres": [...]}`.

    The first description that isn't empty counts, by tier; names differ by case only once; a node isn't its own parent.
    """
    tiers = []
    for tier, path in enumerate((index, main, detailed)):
        found = spark.read.option("multiLine", True).option("recursiveFileLookup", "true").schema(f"genres array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>").json(path)
        tiers.append(found.select(F.explode("genres").alias("g")).select("g.*", F.lit(tier).alias("tier")).filter("name is not null"))
    rows = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    key = F.lower(F.trim("name"))
    order = Window.partitionBy(key).orderBy("tier", "name")
    first = F.first(F.when(F.length(F.trim("description")) > 0, F.col("description")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nodes = rows.select("name", first.alias("description"), F.row_number().over(order).alias("n")).filter("n = 1").drop("n")
    up = rows.select(F.explode("parents").alias("parent"), F.col("name").alias("child"))
    down = rows.select(F.col("name").alias("parent"), F.explode("children").alias("child"))
    edges = up.unionByName(down).filter(F.lower(F.trim("parent")) != F.lower(F.trim("child"))).distinct()
    return nodes, edges


def write_tier(genres: DataFrame, path: str, key: Column, width: int = 10_000) -> None:
    """Genres (name, description, parents, children) as JSON files of at most `width` each, dealt by the long column key (0, 1, 2, ..)."""
    rows = genres.groupBy(F.floor(key / width).alias("_file")).agg(F.collect_list(F.struct("name", "description", "parents", "children")).alias("genres"))
    rows.select("genres").write.option("maxRecordsPerFile", 1).json(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with n, from 1 in the order of the columns: sorted by ranges, each range's numbers go on from the sizes of those before it."""
    rows = saved(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row a range
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("n", F.col("_at") % (1 << 33) + F.col("_before") + 1).drop("_at", "_part", "_before")


def seeded(paths: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """genre_id, name, parent_id, level, path of the tree's paths (path array, name, depth, level) that existing (path) lacks.

    Ids go on from the greatest there is, by depth and path, so a second run adds nothing. A limit cuts after whole depths.
    """
    if limit is not None:
        sizes = paths.groupBy("depth").agg(F.count("*").alias("n"))
        whole = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("depth"))).filter(F.col("upto") <= limit)  # a row a depth
        paths = paths.join(F.broadcast(whole.select("depth")), "depth", "left_semi")
    text = F.array_join("path", " > ")
    fresh = paths.withColumn("path_text", text).join(existing.select(F.col("path").alias("path_text")), "path_text", "left_anti")
    last = existing.agg(F.coalesce(F.max("genre_id"), F.lit(0)).alias("last"))
    fresh = numbered(fresh, "depth", "path_text").crossJoin(F.broadcast(last)).withColumn("genre_id", F.col("n") + F.col("last"))
    known = existing.select(F.col("path").alias("parent_text"), F.col("genre_id").alias("parent_id")).unionByName(fresh.select(F.col("path_text").alias("parent_text"), F.col("genre_id").alias("parent_id")))
    parent = F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), " > ")
    return fresh.withColumn("parent_text", parent).join(known, "parent_text", "left").select("genre_id", "name", "parent_id", "level", F.col("path_text").alias("path"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
