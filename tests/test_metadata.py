import json

from pyspark.sql import functions as F

from crate.functions import names
from crate.operators import metadata, taxonomy, understanding
from crate.sources import taxonomy_files

CLASSES = ["Guitar", "Singing", "Male singing", "Female singing", "Cowbell", "Drum kit"]


def analysis(spark):
    return spark.createDataFrame([(1, 124.0, "C maj", 0.7), (2, 126.0, "C maj", 0.72), (3, None, None, None)], "track_id long, bpm double, music_key string, energy double")


def records(spark):
    tags = [(1, [0.5, 0.4, 0.0, 0.3, 0.0, 0.2]), (2, [0.6, 0.05, 0.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.3, 0.3, 0.2, 0.9, 0.0])]
    return understanding.records(spark.createDataFrame(tags, "track_id long, probs array<double>"), analysis(spark), CLASSES)


def test_records(spark):
    got = {r.track_id: r for r in records(spark).collect()}
    assert [i.name for i in got[1].instruments] == ["Guitar", "Drum kit"] and got[1].vocal.gender == "female"
    assert got[2].vocal.kind == "instrumental" and got[2].vocal.gender == "unknown"
    assert got[1].caption.endswith("high-energy female vocal track at 124 BPM in C maj. Prominent guitar, drum kit.")
    assert "mid-energy male vocal track." in got[3].caption and got[3].tags[0] == "male vocal" and "Cowbell" in got[3].tags


def test_explain(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "track_id long, vector array<double>")
    s = spark.createDataFrame([(1, [1.0] * 16), (2, [1.0] * 16)], "track_id long, vector array<double>")
    pairs = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    r = understanding.explain(pairs, records(spark), analysis(spark), v, s).first()
    assert r.score == 0.995 and {"instruments: guitar", "tempo ~125 BPM", "key 8B", "energy ~71%"} <= set(r.shared)
    assert {"first has drum kit", "vocal vs instrumental"} <= set(r.different) and {b.match for b in r.bands} == {1.0}


def test_labels(spark):
    q = spark.createDataFrame([(1, "songs with cowbells"), (2, "guitar"), (3, "xylophone solo"), (4, "Female Singing")], "query_id long, text string")
    got = {r.query_id: r.label for r in understanding.matched_label(q, CLASSES).collect()}
    assert got == {1: "Cowbell", 2: "Guitar", 3: None, 4: "Female singing"}


def test_recordings(spark):
    text = json.dumps({"id": "m1", "title": "Around", "first-release-date": "1997-01-01", "genres": [{"name": "House", "count": 5}], "artist-credit": [{"name": "Duo"}], "releases": [{"country": "FR", "release-group": {"genres": [{"name": "house", "count": 1}, {"name": "Disco", "count": 2}]}}]})
    df = spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "track_id long, js string")
    got = {r.track_id: r.r for r in df.select("track_id", metadata.flat_recording(F.col("js")).alias("r")).collect()}
    assert (got[1].mbid, got[1].artist, got[1].year, got[1].genres, got[1].area) == ("m1", "Duo", 1997, ["house", "disco"], "FR")
    assert got[2].genres == [] and got[2].year is None


def test_waterfall(spark):
    schema = "track_id long, artist string, title string, year int, area string, genres array<string>"
    t = spark.createDataFrame([(1,), (2,), (3,)], "track_id long")
    a = spark.createDataFrame([(1, "A", "t", None, None, [])], schema)
    b = spark.createDataFrame([(1, "B", "u", 1999, None, ["house"])], schema)
    c = spark.createDataFrame([(1, "C", "v", 2000, "DE", ["rock"]), (2, None, None, None, None, ["jazz"])], schema)
    got = {r.track_id: tuple(r) for r in metadata.waterfall(t, a, b, c).collect()}
    assert got == {1: (1, "A", "t", 1999, "DE", ["house"], "styles"), 2: (2, None, None, None, None, ["jazz"], "text")}


def test_dump_graph_and_related(spark):
    genre = spark.createDataFrame([(1, "House"), (2, "Deep House"), (3, "Techno")], "id long, name string")
    kinds = spark.createDataFrame([(1, "genre", "genre", "subgenre"), (2, "genre", "genre", "fusion of"), (3, "genre", "artist", "x")], "id long, e0 string, e1 string, name string")
    link = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id long, type_id long")
    ends = spark.createDataFrame([(10, 1, 2), (11, 3, 1), (12, 1, 3)], "link_id long, from_id long, to_id long")
    edges = metadata.graph_of_dump(genre, kinds, link, ends)
    assert sorted(map(tuple, edges.collect())) == [("deep house", "house", "subgenre"), ("house", "techno", "fusion")]
    seeds = spark.createDataFrame([("deep house",)], "seed string")
    assert [(r.name, r.weight) for r in taxonomy.related(seeds, edges).orderBy("rank").collect()] == [("house", 1.0), ("techno", 0.35)]


def test_gates(spark):
    p = spark.createDataFrame([(1, "Deep House", 0.9), (2, "Nu Disco", 0.3), (3, "", 0.9), (4, "Techno", 0.9)], "track_id long, genre string, confidence double")
    known = spark.createDataFrame([(4, ["x"])], "track_id long, genres array<string>")
    assert [r.track_id for r in metadata.accepted_proposals(p, known, analysis(spark)).collect()] == [1]
    order = spark.createDataFrame([(1, 1, 5, "r" * 200), (1, 2, 5, "x"), (1, 3, 9, "x"), (1, 4, 6, "y")], "request_id long, position long, track_id long, reason string")
    got = metadata.accepted_order(order, spark.createDataFrame([(5,), (6,)], "track_id long")).orderBy("position").collect()
    assert [(r.position, r.track_id, len(r.reason)) for r in got] == [(1, 5, 140), (2, 6, 1)]


def test_matches_and_styles(spark):
    rec = "array<struct<id:string>>"
    df = spark.sql(f"select array(struct(0.9D as score, cast(array() as {rec}) as recordings), struct(0.7D as score, cast(array(struct('a')) as {rec}) as recordings), struct(0.5D as score, cast(array(struct('b')) as {rec}) as recordings)) as r, array(struct('electronic' as style, 0.6D as p), struct('deep house' as style, 0.3D as p)) as s")
    assert df.select(names.best_match(F.col("r"))).first()[0].score == 0.7
    assert df.select(names.picked_style(F.col("s"), metadata.UMBRELLAS)).first()[0] == "deep house"


def test_families(spark):
    own = metadata.own_genres(spark.createDataFrame([(1, ["Electronic", "Deep House"]), (2, ["Nu Disco"]), (3, ["Ambient"])], "track_id long, genres array<string>"), analysis(spark))
    assert {r.track_id: r.major for r in own.collect()} == {1: "House", 2: "Disco", 3: "Ambient"}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (9, [0.1, 1.0]), (8, [-0.1, -1.0])], "track_id long, vector array<double>")
    placed = metadata.filled_from_anchors(own, v, analysis(spark))
    got = {r.track_id: (r.major, r.via) for r in placed.collect()}
    assert got[9] == ("Disco", "similar") and 8 not in got and got[1] == ("House", "own")
    assert {(r.major, r.sub, r.n) for r in metadata.tree_of(placed).collect()} >= {("Disco", None, 2), ("Disco", "Nu Disco", 2)}


def test_anchors_are_gated_before_the_best_is_taken(spark):
    # 25 copies at another tempo are nearer to 100 than the one anchor that fits; 101 is House and prefers it; 102 is near nothing.
    own = [(i, "acid techno", "Techno") for i in range(25)] + [(30, "deep house", "House"), (31, "minimal techno", "Techno"), (101, "house", "House")]
    own = spark.createDataFrame(own, "track_id long, genre string, major string")
    vectors = [(i, [1.0, 0.0, 0.0]) for i in range(25)] + [(30, [1.0, 0.5, 0.0]), (31, [1.0, 0.2, 0.0]), (100, [1.0, 0.1, 0.0]), (101, [1.0, 0.1, 0.0]), (102, [0.0, 0.1, 1.0])]
    tempos = spark.createDataFrame([(i, 160.0) for i in range(25)] + [(30, 122.0), (31, None), (100, 120.0), (101, 120.0), (102, 120.0)], "track_id long, bpm double")
    got = {r.track_id: (r.genre, r.major, r.via) for r in metadata.organised(own, spark.createDataFrame(vectors, "track_id long, vector array<double>"), tempos).collect()}
    assert len(got) == 30 and got[100] == ("minimal techno", "Techno", "similar") and got[101] == ("deep house", "House", "similar")
    assert got[102] == (None, "House", "unsorted") and got[30] == ("deep house", "House", "own")


def test_tiers_and_seeding(spark, tmp_path):
    write = lambda name, genres: (tmp_path / name).write_text(json.dumps({"genres": genres}))
    write("index.json", [{"name": "Electronic", "description": ""}, {"name": "Blues"}])
    write("main.json", [{"name": "Electronic", "description": "wide", "children": ["House", "Techno", "Electronic"]}])
    write("detailed.json", [{"name": "House", "parents": ["Electronic"], "children": ["Acid"]}, {"name": "Techno", "children": ["Acid"]}, {"name": "Acid"}])
    nodes, edges = taxonomy_files.read_tiers(spark, *[str(tmp_path / f"{n}.json") for n in ("index", "main", "detailed")])
    assert {r.name: r.description for r in nodes.collect()}["Electronic"] == "wide" and edges.count() == 4
    tree = taxonomy.unfold(nodes.select("name"), edges)
    none = spark.createDataFrame([], "genre_id long, path string")
    first = taxonomy_files.seeded(tree, none)
    rows = {r.path: r for r in first.collect()}
    assert len(rows) == 6 and rows["Electronic > House > Acid"].parent_id == rows["Electronic > House"].genre_id and rows["Blues"].parent_id is None
    assert taxonomy_files.seeded(tree, first).count() == 0 and taxonomy_files.seeded(tree, none, limit=4).count() == 4


def test_own_genres_and_labels(spark):
    said = [(1, ["Techno", "Minimal Techno"]), (2, ["Country", "House"]), (3, ["electronic"]), (4, None), (5, ["Disco"]), (6, ["Deep House"])]
    tempos = spark.createDataFrame([(1, 130.0), (5, 150.0), (6, 121.0)], "track_id long, bpm double")
    own = metadata.own_genres(spark.createDataFrame(said, "track_id long, genres array<string>"), tempos)
    got = {r.track_id: (r.genre, r.major, r.confidence) for r in own.collect()}
    assert got == {1: ("Minimal Techno", "Techno", 0.85), 2: (None, "House", 0.6), 6: ("Deep House", "House", 0.85)}  # most names are electronic
    genres = spark.createDataFrame([(1, "Mine", None), (2, "Odd House", None), (3, "Own", 1)], "genre_id long, name string, parent_id long")
    labels = spark.createDataFrame([(2, 6), (3, 9)], "genre_id long, track_id long")
    got = {r.track_id: (r.genre, r.major, r.confidence) for r in metadata.labelled(own, labels, genres).collect()}
    assert got[6] == ("Odd House", "House", 1.0) and got[9] == ("Own", "Mine", 1.0) and got[1][2] == 0.85 and len(got) == 4


def test_merge_in_passes(spark):
    rows = [(1, "House", None, "genre"), (2, "house ", None, "genre"), (3, "Deep", 1, "subgenre"), (4, "deep", 2, "subgenre"), (5, "HOUSE", 1, "subgenre"), (6, "Dub", 5, "subgenre"), (7, "Techno", None, "genre"), (8, "Deep", 7, "subgenre"), (9, "Tool", 4, "subgenre"), (10, None, None, "genre")]
    genres = spark.createDataFrame(rows, "genre_id long, name string, parent_id long, level string")
    held = spark.createDataFrame([(2, 1), (8, 2), (8, 3), (3, 1)], "genre_id long, track_id long")
    examples = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (8, 5)], "genre_id long, track_id long")
    left, mapping = taxonomy.merge_all(genres, held, examples)
    # 2 has more examples than 1; its own child 4 stays before 3; 5 is named like its parent; 8 has more than 4.
    assert {(r.drop, r.keep) for r in mapping.collect()} == {(1, 2), (3, 8), (4, 8), (5, 2)}
    assert {(r.genre_id, r.parent_id) for r in left.collect()} == {(2, None), (6, 2), (7, None), (8, 7), (9, 8), (10, None)}
    assert {tuple(r) for r in taxonomy.moved(examples, mapping).distinct().collect()} == {(2, 1), (2, 2), (8, 5)}
    left, mapping = taxonomy.merge_all(genres.limit(0), held, examples)
    assert left.count() == 0 and mapping.count() == 0


def test_merge_leaves_no_namesakes(spark):
    import random

    deal = random.Random(5)
    rows = [(i, f"n{deal.randrange(9)}", deal.randrange(1, i) if i > 3 else None, "genre" if i < 4 else "subgenre") for i in range(1, 41)]
    genres = spark.createDataFrame(rows, "genre_id long, name string, parent_id long, level string")
    none = spark.createDataFrame([], "genre_id long, track_id long")
    left, mapping = (x.collect() for x in taxonomy.merge_all(genres, none, none))
    name = {r[0]: r[1] for r in rows}
    kept = {r.genre_id for r in left}
    assert len({r.name for r in left}) == len(left) and {r.keep for r in mapping} <= kept and not kept & {r.drop for r in mapping}
    assert all(name[r.drop] == name[r.keep] for r in mapping) and len(left) + len(mapping) == 40
    assert all(r.parent_id is None or r.parent_id in kept and name[r.parent_id] != r.name for r in left)


def test_search_and_view(spark):
    q = spark.createDataFrame([(1, "guitars"), (2, "misty"), (3, "nothing known")], "query_id long, text string")
    tags = spark.createDataFrame([(1, [0.5, 0.4, 0.0, 0.3, 0.0, 0.2]), (2, [0.6]), (3, None)], "track_id long, probs array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "track_id long, vector array<double>")
    prompts = spark.createDataFrame([(2, [0.0, 2.0]), (2, [0.0, 1.0]), (2, None)], "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): (r.track_id, r.score, r.method) for r in understanding.search(q, tags, CLASSES, prompts, v, 2).collect()}
    assert got == {(1, 1): (2, 0.6, "tags"), (1, 2): (1, 0.5, "tags"), (2, 1): (2, 1.0, "text"), (2, 2): (1, -1.0, "text")}
    assert understanding.search(q, tags, CLASSES, prompts, v, threshold=0.55).count() == 2
    stored = spark.createDataFrame([(1, "", 0.5, True), (2, "en", 0.5, None)], "track_id long, language string, language_conf double, deep_done boolean")
    seen = {r.track_id: r for r in understanding.view_of(tags, analysis(spark), CLASSES, stored).collect()}
    assert set(seen) == {1, 2} and seen[1].language is None and seen[1].deep_done and seen[2].language == "en" and not seen[2].deep_done


def test_artists_and_examples(spark):
    from crate.operators import classify

    r = spark.createDataFrame([(1, 7, ["a", "b", "a"], None), (2, 7, [], "FR"), (3, None, None, None)], "track_id long, artist_id long, genres array<string>, area string")
    a = spark.createDataFrame([(7, ["x", "x"], "DE")], "artist_id long, genres array<string>, area string")
    assert {(x.track_id, tuple(x.genres), x.area) for x in metadata.with_artists(r, a).collect()} == {(1, ("a", "b"), "DE"), (2, ("x",), "FR"), (3, (), None)}
    schema = "genre_id long, name string, parent_id long, level string"
    genres = spark.createDataFrame([(4, "Old", None, "genre")], schema)
    wanted = spark.createDataFrame([("Old", None, "genre", 1), ("New", 4, "subgenre", 2), ("New", 4, "subgenre", 3), ("Old", 4, "subgenre", 1)], "name string, parent_id long, level string, track_id long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0])], "track_id long, vector array<double>")
    centroids = spark.createDataFrame([(4, [0.0, 1.0]), (9, [1.0, 1.0])], "genre_id long, vector array<double>")
    after, taught, means = classify.by_example(wanted, genres, spark.createDataFrame([(4, 2)], "genre_id long, track_id long"), centroids, v)
    assert {(x.genre_id, x.name, x.parent_id) for x in after.collect()} == {(4, "Old", None), (5, "New", 4), (6, "Old", 4)}
    assert {tuple(x) for x in taught.collect()} == {(4, 1), (4, 2), (5, 2), (5, 3), (6, 1)}
    assert {x.genre_id: [round(y, 3) for y in x.vector] for x in means.collect()} == {4: [0.707, 0.707], 5: [0.0, 1.0], 6: [1.0, 0.0], 9: [1.0, 1.0]}


def test_dumps_graphs_and_spaces(spark, tmp_path):
    from crate.sources import tables

    (tmp_path / "genre.tsv").write_text('1\tHouse\t\\N\n2\t"odd\tx\n')
    got = tables.read_dump(spark, str(tmp_path / "genre.tsv"), "id long, name string, note string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "House", None), (2, '"odd', "x")]
    v = spark.createDataFrame([(1, "clap", [1.0]), (2, "muq", [2.0])], "track_id long, model string, vector array<double>")
    tables.write_space(v, str(tmp_path / "space"))
    tables.write_space(spark.createDataFrame([(3, "muq", [3.0])], v.schema), str(tmp_path / "space"))
    assert [r.track_id for r in tables.read_space(spark, str(tmp_path / "space"), "muq").collect()] == [3]
    assert [r.track_id for r in tables.read_space(spark, str(tmp_path / "space"), "clap").collect()] == [1]
    nodes, edges = v.select("track_id"), v.select("track_id", "model")
    taxonomy_files.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert [x.count() for x in taxonomy_files.read_graph(spark, str(tmp_path / "graph"))] == [2, 2]


def test_merges_send_no_tables_to_the_driver(spark):
    from crate.storage import saved

    g = saved(spark.createDataFrame([(1, "a", None, "genre", False), (2, "a", 1, "genre", False), (3, "b", 1, "genre", False)], "genre_id long, name string, parent_id long, level string, _late boolean"), "genres")
    held = saved(spark.createDataFrame([(1, 2)], "genre_id long, n long"), "held")
    mapping = saved(spark.createDataFrame([(4, 1)], "drop long, keep long"), "merge")
    ranked = taxonomy._ranked(g, taxonomy.moved(held, mapping), held.select("genre_id"))
    for df in (ranked, taxonomy._same_place(ranked), taxonomy._like_parent(ranked), taxonomy._same_name(ranked)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
