"""Sorting a whole library: names and tags, the reduced space, genres kept and made anew, groups by sound without any names."""

import numpy as np

from crate.operators import autosort

NAMES = "track_id long, genres array<string>"
GENRES = "genre_id long, name string, parent_id long, level string"


def library(spark, n=40, dims=65):
    """Two sounds beside a baseline that all tracks share, so that only the reduced space tells them apart."""
    rng = np.random.default_rng(4)
    base = 20 * rng.normal(size=dims)
    two = rng.normal(size=(2, dims))
    rows = [(i, f"/in/{i}/t.mp3", [float(x) for x in base + two[i % 2] + 0.05 * rng.normal(size=dims)]) for i in range(n)]
    return spark.createDataFrame([*rows, (99, "/in/99/t.mp3", None)], "track_id long, path string, vector array<double>")


def none(spark, schema):
    return spark.createDataFrame([], schema)


def test_names_before_tags(spark):
    told = spark.createDataFrame([(1, ["Deep House"]), (2, []), (3, None)], NAMES)
    tags = spark.createDataFrame([(1, ["Techno"]), (2, ["Electronic music", "Techno"]), (3, ["Dance music"]), (4, ["JAZZ", None]), (5, None)], NAMES)
    assert sorted((r.track_id, r.genres) for r in autosort.own_names(told, tags).collect()) == [(1, ["Deep House"]), (2, ["techno"]), (4, ["jazz"])]


def test_fill_in_the_reduced_space(spark):
    t = library(spark)
    told = spark.createDataFrame([(0, ["deep house"]), (1, ["minimal techno"]), (99, ["dubstep"])], NAMES)
    tempos = spark.createDataFrame([(i, 125.0) for i in range(40)], "track_id long, bpm double")
    genres = spark.createDataFrame([(1, "House", None, "genre"), (2, "Mine", 1, "subgenre"), (9, "Old", None, "genre")], GENRES)
    labels = spark.createDataFrame([(2, 4)], "genre_id long, track_id long")
    first = autosort.auto_sorted(t, told, none(spark, NAMES), tempos, genres, labels)
    placed = {r.track_id: r for r in first.placed.collect()}
    assert sorted(placed) == list(range(40)) and (placed[4].genre, placed[4].confidence) == ("Mine", 1.0)
    assert all(placed[i].genre == "Minimal Techno" for i in range(1, 40, 2)) and all(placed[i].major == "House" for i in range(0, 40, 2))
    made = {r.genre_id: (r.name, r.parent_id, r.level) for r in first.genres.collect()}
    assert made == {1: ("House", None, "genre"), 2: ("Mine", 1, "subgenre"), 10: ("Techno", None, "genre"), 11: ("Deep House", 1, "subgenre"), 12: ("Minimal Techno", 10, "subgenre")}
    vectors = {r.track_id: np.array(r.vector) for r in t.filter("vector is not null").collect()}
    of = {}
    for r in first.assignments.collect():
        of.setdefault(r.genre_id, []).append(vectors[r.track_id])
    centroids = {r.genre_id: np.array(r.vector) for r in first.centroids.collect()}
    assert centroids.keys() == of.keys()
    for k, vs in of.items():
        mean = np.mean(vs, 0)
        assert np.allclose(centroids[k], mean / np.linalg.norm(mean))
    dests = [r.dest for r in first.plan.collect()]
    assert len(set(dests)) == len(dests) == 40 and "/sorted/House/Mine/t.mp3" in dests
    again = autosort.auto_sorted(t, told, none(spark, NAMES), tempos, first.genres, labels)
    assert {r.track_id: (r.major, r.genre) for r in again.placed.collect()} == {k: (r.major, r.genre) for k, r in placed.items()}
    assert sorted(r.name for r in again.genres.collect()) == sorted(n for n, *_ in made.values())
    assert {r.genre_id for r in again.genres.collect()} == {1, 2, 13, 14, 15}


def test_groups_by_sound_without_genres(spark):
    t = library(spark)
    tags = spark.createDataFrame([(i, ["house music"] if i % 2 else ["techno"]) for i in range(0, 40, 3)], NAMES)
    tempos = none(spark, "track_id long, bpm double")
    found = autosort.auto_sorted(t, none(spark, NAMES), tags, tempos, none(spark, GENRES), none(spark, "genre_id long, track_id long"), most=2)
    placed = {r.track_id: (r.major, r.genre, r.confidence, r.via) for r in found.placed.collect()}
    assert placed[1] == ("House", "House 1", 0.5, "sound") and placed[0] == ("Techno", "Techno 1", 0.6, "sound") and len(placed) == 40
    assert {(r.major, r.sub, r.n) for r in found.tree.collect()} == {("House", None, 20), ("House", "House 1", 20), ("Techno", None, 20), ("Techno", "Techno 1", 20)}
    few = autosort.auto_sorted(t.filter("track_id < 2"), none(spark, NAMES), none(spark, NAMES), tempos, none(spark, GENRES), none(spark, "genre_id long, track_id long"))
    assert {(r.track_id, r.major, r.genre) for r in few.placed.collect()} == {(0, "Electronic", "Electronic 1"), (1, "Electronic", "Electronic 1")}
    nothing = autosort.auto_sorted(t.filter("track_id = 99"), none(spark, NAMES), tags, tempos, none(spark, GENRES), none(spark, "genre_id long, track_id long"))
    assert [x.count() for x in nothing] == [0] * 6
