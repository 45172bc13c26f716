import math
import random

from pyspark.sql import functions as F

from crate.functions import music, names, requests
from crate.operators import knn, mixes, organise, signal, taxonomy, walks
from crate.sources import tables, taxonomy_files


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return df.select(column).first()[0]


def test_keys(spark):
    label = lambda k: one(spark, music.wheel_label(music.wheel_position(F.col("k"))), k=k)
    assert [label(k) for k in ("A min", "C major", "Bb maj", "H maj", "A")] == ["8A", "8B", "6B", None, None]
    far = lambda a, b: one(spark, music.harmonic_distance(music.wheel_position(F.col("a")), music.wheel_position(F.col("b"))), a=a, b=b)
    assert far("A min", "C maj") == 0 and far("A min", "E min") == 0 and far("A min", "x") == 0.5 and far("A min", "Eb min") == 1.0


def test_names(spark):
    pick = lambda t, a: tuple(one(spark, names.artist_title(F.col("t"), F.col("a"), F.lit("/x/y.mp3")), t=t, a=a))
    assert pick("GTG Premiere | Sterac (NL) - Rotary [DELSIN 1].mp3", "") == ("Sterac", "Rotary")
    assert pick("A1. Enoch (SA) - Sun (Extended Mix)", "") == ("Enoch", "Sun")
    assert pick("Alone", "Big Records") == (None, "Alone") and pick("Alone", "Ann (UK)") == ("Ann", "Alone")
    assert one(spark, music.sanitized(F.col("n")), n='a/b: "c"...') == "a_b_ _c_" and one(spark, music.sanitized(F.col("n")), n=" . ") == "_"
    assert one(spark, music.title_case(F.col("n")), n="o'neil drum-and bass") == "O'Neil Drum-And Bass"
    assert one(spark, music.major_of(F.col("n")), n="Garage House") == "House"
    assert one(spark, music.tempo_plausible(F.col("g"), F.col("b")), g="Nu Disco", b=166.0) is False
    assert one(spark, music.tempo_plausible(F.col("g"), F.col("b")), g="Drum and Bass", b=87.0) is True


def test_requests(spark):
    df = spark.createDataFrame([(1, "start slow, build to peak then slow down, 10 tracks"), (2, "warm chilled sunset"), (3, "deep house 122 bpm"), (4, "techno 128 to 120 bpm"), (5, None)], "request_id long, text string")
    got = {r.request_id: r for r in requests.parsed(df).collect()}
    assert (got[1].shape, got[1].length, got[1].energies[0], max(got[1].energies)) == ("rise-then-fall", 10, 0.2, 0.72)
    assert got[2].shape == "low" and got[3].genres == ["house", "deep house"] and got[3].bpm_lo == got[3].bpm_hi == 122
    assert (got[4].bpm_lo, got[4].bpm_hi) == (120, 128) and got[5].shape == "default" and got[5].length is None


def test_set_along_the_arc(spark):
    energies = [0.1, 0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9]
    none = "cast(null as string)"
    t = spark.createDataFrame([(i, e, 118.0 + 2 * i, "A min") for i, e in enumerate(energies)], "track_id long, energy double, bpm double, music_key string")
    t = t.selectExpr("*", f"{none} as genre", f"{none} as vocal", f"{none} as gender", "cast(null as array<string>) as moods", "cast(null as array<string>) as instruments")
    wishes = spark.createDataFrame([(1, "start slow, build up to peak, then wind down"), (2, "steady female vocal")], "request_id long, text string")
    got = {}
    for r in walks.build_sets(wishes, t, default_length=6).orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append(r.track_id)
    assert all(len(v) == len(set(v)) == 6 for v in got.values())
    assert max(got[1], key=lambda i: energies[i]) in got[1][2:4]


def test_sets_look_at_every_candidate(spark):
    rng = random.Random(2)
    notes, moods = ["A min", "E min", "C maj", "Eb min", None], ["warm", "deep", "euphoric"]
    rows = [(i, rng.randrange(1000) / 1000 if i % 9 else None, rng.choice([None, 118.0, 121.5, 124.0]), rng.choice(notes), rng.choice(["Deep House", "Techno", None]), rng.choice(["vocal", "instrumental", "uncertain", None]), rng.choice(["female", "male", None]), rng.sample(moods, 2), ["Piano"] if i % 4 == 0 else None) for i in range(700)]
    t = spark.createDataFrame(rows, "track_id long, energy double, bpm double, music_key string, genre string, vocal string, gender string, moods array<string>, instruments array<string>")
    texts = [(1, "start slow and deep, build up to peak, then wind down"), (2, "punchy energetic female vocal, 6 tracks"), (3, "steady groovy instrumental with piano"), (4, "warm euphoric deep house, 9 tracks")]
    wishes = spark.createDataFrame(texts, "request_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in notes if a for b in notes], "a string, b string")
    far = {(r.a, r.b): r.d for r in pairs.select("a", "b", music.harmonic_distance(music.wheel_position(F.col("a")), music.wheel_position(F.col("b"))).alias("d")).collect()}
    got, targets = {}, {}
    for r in walks.build_sets(wishes, t, 8).orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append(r.track_id)
        targets.setdefault(r.request_id, []).append(r.target)
    assert {k: len(v) for k, v in got.items()} == {1: 8, 2: 6, 3: 8, 4: 9}
    for p in requests.parsed(wishes).collect():
        pool = [r for r in rows if not p.genres or (r[4] and any(g in r[4].lower() or r[4].lower() in g for g in p.genres))]
        if p.gender:
            pool = [r for r in pool if r[6] == p.gender]
        elif p.vocal:
            pool = [r for r in pool if r[5] in (p.vocal, "uncertain")]
        wanted, used, bpm, note = [*p.moods, *p.instruments], [], None, None
        for target in targets[p.request_id]:
            hits = lambda r: sum(w in [*r[7], *(r[8] or [])] for w in wanted) / len(wanted) if wanted else 0.0
            gap = lambda r: round(abs((0.5 if r[1] is None else r[1]) - target) + 1e-9, 3)
            best = min((r for r in pool if r[0] not in used), key=lambda r: (gap(r), -round(hits(r), 3), round(far[note, r[3]], 3) if note else 0.0, abs(r[2] - bpm) if r[2] is not None and bpm is not None else 0.0, r[0]))  # noqa: B023
            used.append(best[0])
            bpm, note = bpm if best[2] is None else best[2], best[3] or note
        assert got[p.request_id] == used, p.text


def test_sets_open_few_cells(spark, monkeypatch):
    """A third of all tracks in one cell, dealt to parts; the cells that a step opens hold the nearest track left; what is no track; no tracks."""
    monkeypatch.setattr(walks, "PART_ROWS", 7)
    rng = random.Random(5)
    rows = [(i, None if i % 3 == 0 else float("nan") if i % 50 == 1 else rng.choice([-0.4, 0.0, 1.0, 3.25, rng.random(), rng.randrange(40) / 40]), 120.0 + i % 5, rng.choice(["A min", "D maj"])) for i in range(400)]
    rows += [(None, 0.5, 120.0, "A min")]
    t = spark.createDataFrame(rows, "track_id long, energy double, bpm double, music_key string")
    t = t.selectExpr("*", "cast(null as string) as genre", "cast(null as string) as vocal", "cast(null as string) as gender", "cast(null as array<string>) as moods", "cast(null as array<string>) as instruments")
    wishes = spark.createDataFrame([(1, "steady, 30 tracks"), (2, "start slow, build up to peak, then wind down, 40 tracks"), (3, "steady, 30 tracks"), (4, "techno, 500 tracks")], "request_id long, text string")
    energy = {r[0]: 0.5 if r[1] is None or r[1] != r[1] else r[1] for r in rows if r[0] is not None}
    got = {}
    for r in walks.build_sets(wishes.filter("request_id < 4"), t).orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append((r.track_id, r.target))
    assert got[1] == got[3] and [len(got[k]) for k in (1, 2)] == [30, 40]
    for took in got.values():
        left = dict(energy)
        for track, target in took:
            assert round(abs(left[track] - target) + 1e-9, 3) == min(round(abs(e - target) + 1e-9, 3) for e in left.values())
            del left[track]
    few = walks.build_sets(wishes, t.limit(0))
    assert few.count() == 0 and few.columns == ["request_id", "position", "track_id", "target"]
    assert walks.build_sets(wishes.filter("request_id = 4"), t.filter("track_id < 9")).count() == 9


def test_a_text_is_read_once_however_many_wishes_have_it(spark, monkeypatch):
    """And the class of a track is worked out once for those of equal genre, voice and gender; null texts, genres and voices keep their rows."""
    read, real, saved, kept = [], requests.parsed, walks.saved, {}
    monkeypatch.setattr(requests, "parsed", lambda w, *a: read.append(w.count()) or real(w, *a))
    monkeypatch.setattr(walks, "saved", lambda df, tag: kept.setdefault(tag, saved(df, tag)) if tag == "kinds" else saved(df, tag))
    t = spark.range(90).selectExpr("id as track_id", "id / 90 as energy", "120D as bpm", "'A min' as music_key", "case id % 3 when 0 then 'Tech House' when 1 then 'Techno' end as genre", "case when id % 2 = 0 then 'vocal' end as vocal", "cast(null as string) as gender", "cast(null as array<string>) as moods", "cast(null as array<string>) as instruments")
    wishes = spark.range(300).selectExpr("id as request_id", "case id % 3 when 0 then 'tech house, 4 tracks' when 1 then 'steady vocal, 5 tracks' end as text")
    got = {}
    for r in walks.build_sets(wishes, t, 3).orderBy("request_id", "position").collect():
        got.setdefault(r.request_id, []).append(r.track_id)
    assert [len(got[i]) for i in range(300)] == [4, 5, 3] * 100 and all(got[i] == got[i % 3] for i in range(300))
    assert all(i % 3 == 0 for i in got[0]) and all(i % 2 == 0 for i in got[1])
    assert read == [3] and kept["kinds"].count() == 6


def test_radio(spark):
    rows = [(i, [1.0, 0.02 * i, 0.0, 0.0]) for i in range(3)] + [(3 + i, [0.0, 0.0, 1.0, 0.02 * i]) for i in range(3)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    got = [r.item_id for r in walks.radio(spark.createDataFrame([(0,), (99,)], "seed long"), items, 6).orderBy("position").collect()]
    assert got[0] == 0 and set(got[:3]) == {0, 1, 2} and sorted(got) == list(range(6))


def test_rounds_of_a_walk_share_what_is_known_of_the_items(spark, monkeypatch):
    """Cells are made and judged once for all rounds, whether they are used or not; walks are those of all pairs."""
    rng = random.Random(3)
    rows = [(i, [10.0 * (j == i % 6) + rng.random() for j in range(6)]) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(4)
    seeds = spark.createDataFrame([(i,) for i in range(0, 300, 60)], "seed long")
    walk = lambda: sorted(map(tuple, walks.radio(seeds, items, 4).collect()))
    want, made, real = walk(), [], knn.celled
    assert len(want) == 20
    monkeypatch.setattr(knn, "CELLS_FROM", 100)
    monkeypatch.setattr(knn, "celled", lambda *a: made.append(1) or real(*a))
    for share in (1.0, -1.0):
        monkeypatch.setattr(knn, "SHARE", share)
        assert walk() == want and len(made) == 1
        made.clear()


def test_even_sample_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1, float(i), i) for i in range(11)] + [(2, 0.0, 99)], "g long, e double, i long")
    got = walks.even_sample(df, "e", 5, "g").collect()
    assert sorted(r.i for r in got if r.g == 1) == sorted({round(k * 10 / 4) for k in range(5)}) and [r.i for r in got if r.g == 2] == [99]


def test_runs(spark):
    w = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.1), (1, 3, "a", 0.8), (1, 4, "b", 0.9), (1, 5, "a", 0.9)], "mix_id long, seq long, best string, score double")
    got = [(r.best, r.first_seq, r.last_seq) for r in mixes.merged_runs(w, 0.5).orderBy("run").collect()]
    assert got == [("a", 1, 3), ("b", 4, 4), ("a", 5, 5)]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", "new"), (2, "b", "done")], "id long, path string, status string")
    new = spark.createDataFrame([(1, "x", "new"), (2, None, "new"), (3, "c", "new")], "id long, path string, status string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(old, new.filter("path is not null or id = 2"), ["id"], keep=["status"])) == [(1, "x", "new"), (2, None, "done"), (3, "c", "new")]
    assert rows(tables.patch(old, new.select("id", "path"), ["id"])) == [(1, "x", "new"), (2, "b", "done"), (3, "c", None)]
    assert rows(tables.worklist(new, old, "id")) == [(3, "c", "new")] and tables.insert_or_ignore(old, new, ["id"]).count() == 3
    assert tables.replace_group(old, new.filter("id = 1"), ["id"]).count() == 2
    assert [r.id for r in tables.set_null(old.withColumn("ref", F.col("id")), spark.createDataFrame([(1,)], "pid long"), "ref", "pid").filter("ref is null").collect()] == [2]
    assert tables.where(old, status="done", path=None).count() == 1 and tables.page(old, "id", 1, 1).first().id == 2


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.MP3").write_bytes(b"abc")
    (tmp_path / "two.txt").write_bytes(b"abc")
    got = tables.manifest(spark, str(tmp_path)).collect()
    assert [(r.fmt, r.content_hash) for r in got] == [("mp3", "a9993e364706816aba3e25717850c26c9cd0d89d")]


def test_trees(spark):
    g = spark.createDataFrame([(1, "Electronic", None, "genre"), (2, "House", 1, "subgenre"), (3, "Acid", 2, "subgenre"), (4, " house", 1, "subgenre"), (5, "Acid", 4, "subgenre")], "genre_id long, name string, parent_id long, level string")
    up = sorted((r.genre_id, r.depth, r.ancestor_id) for r in taxonomy.ancestors(g).filter("genre_id = 3").collect())
    assert up == [(3, 1, 2), (3, 2, 1)]
    deep = spark.createDataFrame([(i, f"g{i}", i - 1 if i else None) for i in range(301)] + [(1001, "a", 1002), (1002, "b", 1003), (1003, "c", 1001), (1004, "d", 1001), (1005, "e", 1005), (1006, "f", 77_777)], "genre_id long, name string, parent_id long")
    got = {(r.genre_id, r.ancestor_id): r.depth for r in taxonomy.ancestors(deep).collect()}
    want = {(i, j): i - j for i in range(301) for j in range(i)}
    want |= {(1001, 1002): 1, (1001, 1003): 2, (1002, 1003): 1, (1002, 1001): 2, (1003, 1001): 1, (1003, 1002): 2, (1004, 1001): 1, (1004, 1002): 2, (1004, 1003): 3}
    assert got == want
    assert taxonomy.ancestors(deep.limit(0)).count() == 0
    uses = spark.createDataFrame([(4, 9), (3, 1)], "genre_id long, uses long")
    assert sorted(map(tuple, taxonomy.merge_duplicates(g, uses).collect())) == [(2, 4), (5, 3)]
    nodes = spark.createDataFrame([("e",), ("h",), ("t",), ("a",)], "name string")
    edges = spark.createDataFrame([("e", "h"), ("e", "t"), ("h", "a"), ("t", "a"), ("a", "h"), ("e", "e")], "parent string, child string")
    assert sorted("/".join(r.path) for r in taxonomy.unfold(nodes, edges).collect()) == ["e", "e/h", "e/h/a", "e/t", "e/t/a", "e/t/a/h"]


def test_plans(spark):
    t = spark.createDataFrame([(1, "/l/x.mp3"), (2, "/m/x.mp3"), (3, "/l/y.mp3")], "track_id long, path string")
    a = spark.createDataFrame([(1, 11), (2, 11), (3, 1)], "track_id long, genre_id long")
    g = spark.createDataFrame([(1, "Rock", None, "genre"), (11, "A/B", 1, "subgenre")], "genre_id long, name string, parent_id long, level string")
    assert [r.dest for r in organise.plan(t, a, g, "/r").orderBy("track_id").collect()] == ["/r/Rock/A_B/x.mp3", "/r/Rock/A_B/x (1).mp3"]
    log = spark.createDataFrame([(1, 1, "move", 5, "a", "b", "done"), (2, 1, "move", 6, "c", "d", "done"), (1, 2, "move", 5, "a", "b", "undone")], "id long, event long, type string, track_id long, from_value string, to_value string, status string")
    assert [tuple(r) for r in organise.undo_plan(log, "move").collect()] == [(2, 6, "d", "c")]


def test_tones(spark):
    sr, n = 8000, 2048
    tone = lambda f: [math.sin(2 * math.pi * f * i / sr) for i in range(sr)]
    pcm = spark.createDataFrame([(1, tone(440.0)), (2, [])], "track_id long, samples array<double>")
    frames = signal.stft(pcm, n, 512)
    assert frames.filter("track_id = 1").count() == 1 + (sr - n) // 512 and frames.filter("track_id = 2").count() == 1
    chroma = {r.track_id: r.chroma for r in signal.chroma(frames, signal.bin_pitches(n, sr)).collect()}
    assert max(range(12), key=lambda k: chroma[1][k]) == 9  # A
    got = {r.track_id: r for r in signal.analysis(frames, pcm.select("track_id", signal.loudness(F.col("samples")).alias("energy")), n, 512, sr).collect()}
    assert got[2].energy == 0 and got[2].bpm == 0 and got[2].music_key is None and 0.9 < got[1].energy < 1


def test_pulse_tempo(spark):
    env = spark.createDataFrame([(1, i, (1.0 if i % 20 == 0 else 0.0) - 0.05) for i in range(400)], "track_id long, frame_idx long, env double")
    got = signal.tempo(env, frames_per_sec=40.0).first()
    assert got.bpm == 120.0 and got.strength > 0.8 and got.regularity > 0.8


def test_a_dump_is_read_as_it_was_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a \"b\" c"), (2, None), (3, "x\\y")], "id long, name string")
    tables.write_dump(rows, str(tmp_path / "d"))
    assert sorted(map(tuple, tables.read_dump(spark, str(tmp_path / "d"), "id long, name string").collect())) == sorted(map(tuple, rows.collect()))


def test_tiers_are_read_as_they_were_written(spark, tmp_path):
    kind = "k long, name string, description string, parents array<string>, children array<string>"
    tier = spark.createDataFrame([(k, f"g{k}", None if k % 2 else "d", [f"g{k // 2}"], []) for k in range(1, 250)], kind)
    empty = tier.limit(0)
    for name, df in (("a", empty), ("b", tier), ("c", empty)):
        taxonomy_files.write_tier(df, str(tmp_path / name), F.col("k"))
    nodes, edges = taxonomy_files.read_tiers(spark, *[str(tmp_path / n) for n in "abc"])
    assert {(r.name, r.description) for r in nodes.collect()} == {(f"g{k}", None if k % 2 else "d") for k in range(1, 250)}
    assert edges.count() == 249


def test_playlist_ties_go_by_track(spark):
    rows = [("p", t, f"/a/{t}.mp3", 1.0) for t in (9, 4, 7, 1)] + [("p", 3, "/a/3.mp3", None), ("p", 8, "/a/8.mp3", 0.5)]
    df = spark.createDataFrame(rows, "playlist string, track_id long, path string, position double")
    got = {r.track_id: r.dest.split("/")[-1] for r in organise.playlist_plan(df, "/lists").collect()}
    assert got == {8: "001 - 8.mp3", 1: "002 - 1.mp3", 4: "003 - 4.mp3", 7: "004 - 7.mp3", 9: "005 - 9.mp3", 3: "006 - 3.mp3"}


def test_requests_of_one_file_are_read_by_several_tasks(spark):
    rows = spark.range(400).coalesce(1).select(F.col("id").alias("request_id"), F.concat(F.lit("Deep House for 2 hours "), F.col("id").cast("string")).alias("text"))
    got = requests.parsed(rows)
    assert got.columns[:2] == ["request_id", "text"] and "_low" not in got.columns
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {tuple(r.genres) for r in got.select("genres").collect()} == {("house", "deep house")}


def test_tiers_take_few_files(spark, tmp_path):
    rows = spark.range(25_000).selectExpr("id as k", "concat('g', id) as name", "'' as description", "array('up') as parents", "array() as children")
    taxonomy_files.write_tier(rows, str(tmp_path / "t"), F.col("k"))
    assert len(list((tmp_path / "t").glob("*.json"))) == 3  # 250 before
