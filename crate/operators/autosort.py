"""A whole library sorted into families and genres at once: names, fill by sound, new genres with centroids, and the plan of moves."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crate.operators import classify, groups, metadata, organise
from crate.sources.taxonomy_files import numbered
from crate.storage import saved

#: Tags of sounds that name a genre.
TAG_GENRES = [
    "house music", "techno", "dubstep", "drum and bass", "ambient music", "trance music", "disco", "funk",
    "trip hop", "pop music", "hip hop music", "rock music", "jazz", "reggae", "soul music", "classical music",
]


class Sorted(NamedTuple):
    """What auto_sorted() makes."""

    placed: DataFrame  # track_id, genre (null: unsorted), major, confidence, via
    genres: DataFrame  # genre_id, name, parent_id, level
    assignments: DataFrame  # track_id, genre_id, confidence, status
    centroids: DataFrame  # genre_id, vector
    tree: DataFrame  # major, sub (null: the major's own row), n
    plan: DataFrame  # track_id, path, dest


def own_names(identities: DataFrame, tags: DataFrame) -> DataFrame:
    """track_id, genres: the names that a track is identified by, else those of its tags that name a genre. Both: track_id, genres."""
    told = identities.filter("size(genres) > 0").select("track_id", "genres")
    named = F.filter(F.transform("genres", F.lower), lambda g: g.isin(*TAG_GENRES))
    tagged = tags.join(told.select("track_id"), "track_id", "left_anti").select("track_id", named.alias("genres"))
    return told.unionByName(tagged.filter("size(genres) > 0"))


def auto_sorted(tracks: DataFrame, identities: DataFrame, tags: DataFrame, analysis: DataFrame, genres: DataFrame, labels: DataFrame, most: int = 14, least: float = 0.5, root: str = "/sorted", space: DataFrame | None = None) -> Sorted:
    """Every track that has a vector under one genre.

    tracks: track_id, path, vector; identities and tags: track_id, genres (likeliest first); analysis: track_id, bpm; genres: genre_id, name,
    parent_id, level; labels: genre_id, track_id, the examples given of genres. A track stands where it was given as an example of a
    subgenre, else under its own names where tempo allows; from these the others are filled by nearness in the reduced space (`space`:
    track_id, vector, where another one is to be taken), as metadata.organised() says. If no track has a genre of its own, at most
    `most` groups of sound are named by votes instead. Of the genres there were, those with examples and their parents stay, so that
    a second run gives the same; the others go, their ids aren't used again. Genres have the mean of their tracks' own vectors as
    centroid. Tracks without a vector get nothing; without tracks all tables but genres are empty.
    """
    vectors = saved(tracks.filter("vector is not null").select("track_id", "vector"), "vectors")
    names = saved(own_names(identities, tags).join(vectors.select("track_id"), "track_id", "left_semi"), "names")
    subs = labels.join(genres.filter("level = 'subgenre'").select("genre_id"), "genre_id", "left_semi").join(vectors.select("track_id"), "track_id", "left_semi")
    own = saved(metadata.labelled(metadata.own_genres(names, analysis), subs, genres), "own")
    if space is None:
        space = groups.reduced(vectors.withColumnRenamed("track_id", "item_id")).withColumnRenamed("item_id", "track_id")
    if own.filter("genre is not null").isEmpty():
        votes = names.select("track_id", F.explode("genres").alias("genre"))
        found = organise.by_sound(vectors, votes, most if vectors.count() > most else 1, space)
        sure = F.coalesce("confidence", F.lit(0.5)).alias("confidence")
        placed = found.join(own.select("track_id", "confidence"), "track_id", "left").select("track_id", "genre", "major", sure, F.lit("sound").alias("via"))
    else:
        placed = metadata.organised(own, space, analysis, least)
    placed = saved(placed, "placed")

    named = placed.select("track_id", "major", F.coalesce("genre", F.concat("major", F.lit(" - Unsorted"))).alias("name"), "confidence")
    taught = genres.join(labels.select("genre_id"), "genre_id", "left_semi")
    kept = genres.join(taught.select("genre_id").union(taught.select("parent_id")).distinct(), "genre_id", "left_semi").select("genre_id", "name", "parent_id", "level")
    last = genres.agg(F.coalesce(F.max("genre_id"), F.lit(0)).alias("_last"))
    none = F.lit(None).cast("long").alias("parent_id")
    above = with_names(kept, named.select(F.col("major").alias("name"), none, F.lit("genre").alias("level")), last)
    majors = above.filter("parent_id is null").groupBy(F.col("name").alias("major")).agg(F.min("genre_id").alias("parent_id"))
    below = saved(named.join(majors, "major"), "named")
    last = above.agg(F.max("genre_id").alias("_id")).crossJoin(last).select(F.greatest("_id", "_last").alias("_last"))
    after = with_names(above, below.select("name", "parent_id", F.lit("subgenre").alias("level")), last)
    ids = after.filter("parent_id is not null").groupBy("name", "parent_id").agg(F.min("genre_id").alias("genre_id"))
    assignments = saved(below.join(ids, ["name", "parent_id"]).select("track_id", "genre_id", "confidence", F.lit("suggested").alias("status")), "assignments")
    centroids = classify.mean_vectors(assignments.join(vectors, "track_id"), "genre_id")
    plan = organise.plan(tracks.select("track_id", "path"), assignments, after, root)
    return Sorted(placed, after, assignments, centroids, metadata.tree_of(placed), plan)


def with_names(genres: DataFrame, said: DataFrame, last: DataFrame) -> DataFrame:
    """genres with those said (name, parent_id, level) that their parent (null: none) lacks, ids after the last one (a row, _last), by name."""
    have = genres.select(F.col("name").alias("_n"), F.col("parent_id").alias("_p"))
    fresh = said.distinct().join(have, (F.col("name") == F.col("_n")) & F.col("parent_id").eqNullSafe(F.col("_p")), "left_anti")
    fresh = numbered(fresh, "name", "parent_id").crossJoin(F.broadcast(last))
    return saved(genres.unionByName(fresh.select((F.col("_last") + F.col("n")).cast("long").alias("genre_id"), "name", "parent_id", "level")), "genres")
