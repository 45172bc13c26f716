"""Reviewable plans: where files go, what tags change, how to take it back. Plans are tables; nothing is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crate.functions import music
from crate.storage import saved


def unique_destinations(df: DataFrame, dest: str = "dest", order: str = "track_id") -> DataFrame:
    """Namesakes but the first get ' (1)', ' (2)' before the extension, again until no destination is there twice.

    That ends: a changed destination is longer, so the shortest that clash are settled for good in each round.
    """
    clash = True
    while clash:
        n = F.row_number().over(Window.partitionBy(dest).orderBy(order)) - 1
        parts = F.regexp_extract(F.col(dest), r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(F.col(dest), r"^(.*?)(\.[^./]*)?$", 2)
        df = df.withColumn("_n", n).withColumn(dest, F.when(F.col("_n") == 0, F.col(dest)).otherwise(F.concat(parts[0], F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), parts[1])))
        df = saved(df, "destinations")
        clash = not df.filter("_n > 0").isEmpty()
        df = df.drop("_n")
    return df


def plan(tracks: DataFrame, assignments: DataFrame, genres: DataFrame, root: str) -> DataFrame:
    """track_id, path, dest: root/major/sub/file for tracks with a genre of level subgenre; without a parent, major is Unknown."""
    p = genres.select(F.col("genre_id").alias("parent_id"), F.col("name").alias("_major"))
    rows = tracks.join(assignments.select("track_id", "genre_id"), "track_id").join(F.broadcast(genres.filter("level = 'subgenre'")), "genre_id").join(F.broadcast(p), "parent_id", "left")
    parts = [F.lit(root), music.sanitized(F.coalesce("_major", F.lit("Unknown"))), music.sanitized(F.col("name")), music.base_name(F.col("path"))]
    return unique_destinations(rows.select("track_id", "path", F.concat_ws("/", *parts).alias("dest")))


def tag_plan(assignments: DataFrame, genres: DataFrame, existing: DataFrame) -> DataFrame:
    """track_id, from_value, to_value, grouping, comment for assigned tracks that aren't rejected."""
    p = genres.select(F.col("genre_id").alias("parent_id"), F.col("name").alias("_major"))
    rows = assignments.filter("status <> 'rejected' and genre_id is not null").join(F.broadcast(genres), "genre_id").join(F.broadcast(p), "parent_id", "left").join(existing, "track_id", "left")
    return rows.select("track_id", F.col("genre").alias("from_value"), F.col("name").alias("to_value"), F.coalesce("_major", "name").alias("grouping"), F.concat(F.lit("confidence "), F.format_number("confidence", 2)).alias("comment"))


def playlist_name(name: Column) -> Column:
    """A folder name: letters, digits, underscores, hyphens and spaces; `Playlist` if nothing is left."""
    folder = music.sanitized(F.regexp_replace(name, r"[^\w\- ]+", ""))
    return F.when(folder == "_", "Playlist").otherwise(folder)


def playlist_plan(ordered: DataFrame, root: str) -> DataFrame:
    """playlist, track_id, dest: numbered copies in a folder for each playlist, from rows (playlist, track_id, path, position).

    Equal positions go by track_id; tracks without one come last.
    """
    n = F.row_number().over(Window.partitionBy("playlist").orderBy(F.asc_nulls_last("position"), "track_id"))
    digits = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return ordered.select("playlist", "track_id", F.concat_ws("/", F.lit(root), playlist_name(F.col("playlist")), F.concat(digits, F.lit(" - "), music.base_name(F.col("path")))).alias("dest"))


def vote_names(members: DataFrame) -> DataFrame:
    """cluster, major, genre: the commonest major of a cluster's tracks, then the commonest genre in it that isn't the major itself, or null.

    members: cluster, major, genre. Ties go to the first name.
    """
    of = lambda rows, *by: rows.groupBy("cluster", *by).agg(F.count("*").alias("n"))
    top = lambda rows, name: rows.withColumn("_k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), name))).filter("_k = 1")
    majors = top(of(members.filter("major is not null"), "major"), "major").select("cluster", "major")
    inside = members.join(majors, ["cluster", "major"]).filter("genre is not null and genre <> major")
    return majors.join(top(of(inside, "genre"), "genre").select("cluster", "genre"), "cluster", "left")


def running_names(groups: DataFrame) -> DataFrame:
    """cluster, name: `Major k` for groups (cluster, major, first_track; genre, if there is such a column) without a genre.

    k is one more than the names that the major has had before, in the order of first tracks: its numbered groups and its different genres.
    """
    rows = groups if "genre" in groups.columns else groups.withColumn("genre", F.lit(None).cast("string"))
    order = Window.partitionBy("major").orderBy("first_track", "cluster")
    again = F.row_number().over(Window.partitionBy("major", "genre").orderBy("first_track", "cluster")) > 1
    rows = rows.withColumn("new", (F.col("genre").isNull() | ~again).cast("long"))
    rows = rows.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("genre is null").select("cluster", F.concat_ws(" ", "major", F.col("k").cast("string")).alias("name"))


def by_sound(vectors: DataFrame, tags: DataFrame, groups: int = 14, space: DataFrame | None = None) -> DataFrame:
    """track_id, major, genre of a library in which no track has a genre of its own: groups by sound, named by the votes of their tracks' tags.

    vectors: track_id, vector; tags: track_id, genre, some a track; space: track_id, vector, if not the reduced space is to be taken. Groups without any vote are Electronic; those without a genre inside
    their major have the major and a number.
    """
    from crate.operators.groups import kmeans, reduced

    space = reduced(vectors.withColumnRenamed("track_id", "item_id")) if space is None else space.withColumnRenamed("track_id", "item_id")
    found = saved((kmeans(space, groups) if groups > 1 else space.select("item_id", F.lit(0).alias("cluster"))).withColumnRenamed("item_id", "track_id"), "sound")
    votes = found.join(tags, "track_id").select("cluster", music.major_of(F.col("genre")).alias("major"), music.clean_genre(F.col("genre")).alias("genre"))
    firsts = found.groupBy("cluster").agg(F.min("track_id").alias("first_track"))
    named = saved(firsts.join(vote_names(votes), "cluster", "left").withColumn("major", F.coalesce("major", F.lit("Electronic"))), "names")  # a row a group
    numbered = running_names(named.select("cluster", "major", "genre", "first_track"))
    return found.join(F.broadcast(named.select("cluster", "major", "genre")), "cluster").join(F.broadcast(numbered), "cluster", "left").select("track_id", "major", F.coalesce("genre", "name").alias("genre"))


def state(log: DataFrame) -> DataFrame:
    """The latest event of each action id: the log is append-only, a status change is a new row."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("event")))
    return log.withColumn("_n", n).filter("_n = 1").drop("_n")


def undo_plan(log: DataFrame, kind: str) -> DataFrame:
    """Done actions of a kind, newest first, with what takes them back."""
    done = state(log).filter((F.col("type") == kind) & (F.col("status") == "done"))
    return done.select("id", "track_id", F.col("to_value").alias("from_value"), F.col("from_value").alias("to_value")).orderBy(F.desc("id"))
