"""Registered queries on readable records, identities and automatic grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.operators import autosort, metadata, understanding
from crate.plans.library import A, ANALYSIS, MOOD_ROWS, T, TRACKS, view
from crate.plans.vectors import tracks

QUERIES: dict = {}
SQL: dict[str, str] = {}

CLASSES = ["Guitar", "Piano", "Synthesizer", "Drum kit", "Violin, fiddle", "Singing", "Male singing", "Female singing", "Choir", "Cowbell"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).filter("vector is not null")
    return t.select(F.col("item_id").alias("track_id"), F.transform(F.slice("vector", 1, len(CLASSES)), F.abs).alias("probs"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.records(tags(spark, sf_dir), view(spark, sf_dir, ANALYSIS), CLASSES)


_INSTRUMENT_ROWS = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(CLASSES) if n in understanding.INSTRUMENTS)
RECORD = f"""g as (select vec_id as track_id, list_transform(embedding[1:10]::DOUBLE[], lambda y: abs(y)) as p from embeddings where embedding is not null),
c(k, name) as (values {_INSTRUMENT_ROWS}), i as (select track_id, name, p[k] as p, row_number() over (partition by track_id order by p[k] desc, name) as n from g, c where p[k] >= 0.12),
il as (select track_id, string_agg(name, ', ' order by n) filter (n <= 3) as top, count(*) filter (n <= 10) as n_instruments from i group by 1),
v as (select track_id, greatest(p[6], p[7], p[8], p[9]) as sung, p[7] as male, p[8] as female from g),
w as (select track_id, case when sung >= 0.2 then 'vocal' when sung < 0.1 then 'instrumental' else 'uncertain' end as kind, case when sung < 0.1 or greatest(male, female) < 0.12 then 'unknown' when female > male then 'female' else 'male' end as gender from v)"""


@query(f"""with {RECORD}, {MOOD_ROWS}, a as {A}, b as (select track_id, mood from r where rank = 1),
x as (select w.track_id, kind, gender, coalesce(n_instruments, 0) as n_instruments, top, mood, bpm, music_key, coalesce(energy, 0.5) as energy, case when kind = 'instrumental' then 'instrumental' when gender <> 'unknown' then concat(gender, ' vocal') else 'vocal' end as voice from w left join il using (track_id) join a using (track_id) join b using (track_id))
select track_id, kind, gender, n_instruments, concat(upper(mood[1]), mood[2:], ', ', case when energy > 0.66 then 'high-energy' when energy < 0.4 then 'mellow' else 'mid-energy' end, ' ', voice, ' track at ', round_even(bpm, 0)::bigint::varchar, ' BPM in ', music_key, '.', case when top is null then '' else concat(' Prominent ', lower(top), '.') end) as caption from x""")
def understanding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).join(view(spark, sf_dir, ANALYSIS).select("track_id"), "track_id", "left_semi")
    return r.select("track_id", F.col("vocal.kind").alias("kind"), F.col("vocal.gender").alias("gender"), F.size("instruments").cast("long").alias("n_instruments"), "caption")


@query(f"""with {RECORD}, s as (select a.track_id as a_id, b.track_id as b_id, a.kind as ak, b.kind as bk, a.gender as ag, b.gender as bg from w a join w b on b.track_id = a.track_id + 1),
x as (select vec_id, embedding::DOUBLE[] as e from embeddings where embedding is not null), t as {A},
j as (select s.*, round(list_cosine_similarity(x.e, y.e), 3) + 0.0 as score, abs(p.bpm - q.bpm) <= 4 as near_tempo, abs(p.energy - q.energy) <= 0.12 as near_energy from s join x on x.vec_id = a_id join x y on y.vec_id = b_id left join t p on p.track_id = a_id left join t q on q.track_id = b_id)
select a_id, b_id, score, coalesce(near_tempo, false) as near_tempo, coalesce(near_energy, false) as near_energy, ak = bk as same_voice, ag <> 'unknown' and ag = bg as same_gender from j""")
def explain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tracks(spark, sf_dir).filter("vector is not null").select(F.col("item_id").alias("track_id"), "vector")
    spectra = v.select("track_id", F.transform(F.slice("vector", 1, 16), F.abs).alias("vector"))
    pairs = v.select(F.col("track_id").alias("a_id"), (F.col("track_id") + 1).alias("b_id"))
    found = understanding.explain(pairs, records(spark, sf_dir), view(spark, sf_dir, ANALYSIS), v, spectra)
    has = lambda start: F.exists("shared", lambda s: s.startswith(start))
    voice = F.exists("shared", lambda s: s.isin("vocal", "instrumental", "uncertain"))
    gender = F.exists("shared", lambda s: s.isin("male vocal", "female vocal"))
    return found.filter("score is not null").select("a_id", "b_id", "score", has("tempo").alias("near_tempo"), has("energy").alias("near_energy"), voice.alias("same_voice"), gender.alias("same_gender"))


@query(f"""with q(query_id, text) as (values (1, 'songs with cowbells'), (2, 'piano'), (3, 'female singing'), (4, 'zzz')), g as (select vec_id as track_id, abs(embedding[c.k]::DOUBLE) as p, q.query_id, c.label from embeddings, (values (1, 10, 'Cowbell'), (2, 2, 'Piano'), (3, 8, 'Female singing')) c(query_id, k, label) join q using (query_id) where embedding is not null),
r as (select *, row_number() over (partition by query_id order by round(p, 6) desc, track_id) as rank from g) select query_id, label, track_id, round(p, 6) as p, rank from r where rank <= 10""")
def search_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute search: queries that name a class rank tracks by its probability."""
    from pyspark.sql import Window

    q = spark.sql("select * from values (1, 'songs with cowbells'), (2, 'piano'), (3, 'female singing'), (4, 'zzz') as t(query_id, text)")
    m = understanding.matched_label(q, CLASSES).filter("class_idx is not null")
    rows = tags(spark, sf_dir).crossJoin(F.broadcast(m)).select("query_id", "label", "track_id", F.round(F.get("probs", F.col("class_idx")), 6).alias("p"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "track_id"))).filter("rank <= 10")


def _source(k: int) -> str:
    return f"select p_partkey as track_id, case when p_partkey % {k + 3} = 0 then concat('artist', p_size) end as artist, p_name as title, case when p_partkey % 7 = 0 then {1990 + k} end as year, cast(null as string) as area, case when p_partkey % {k + 2} = 0 then 'g{k}' end as genre from {{part}} where p_partkey % 11 <> 0"


@query(f"""with t as (select track_id from {T}), f as ({_source(0).format(part='part')}), s as ({_source(1).format(part='part')}), x as ({_source(2).format(part='part')}),
j as (select t.track_id, coalesce(f.artist, s.artist, x.artist, '') as artist, coalesce(f.year, s.year, x.year, 0) as year, coalesce(f.genre, s.genre, x.genre, '') as genre, case when f.genre is not null then 'fingerprint' when s.genre is not null then 'styles' when x.genre is not null then 'text' else '' end as source from t left join f using (track_id) left join s using (track_id) left join x using (track_id))
select * from j where genre <> '' or artist <> ''""")
def waterfall_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: view(spark, sf_dir, _source(k)).withColumn("genres", F.when(F.col("genre").isNotNull(), F.array("genre"))).drop("genre")
    r = metadata.waterfall(view(spark, sf_dir, TRACKS), of(0), of(1), of(2))
    return r.select("track_id", F.coalesce("artist", F.lit("")).alias("artist"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(F.get("genres", F.lit(0)), F.lit("")).alias("genre"), F.coalesce("source", F.lit("")).alias("source"))


_NAMES = ("deep house", "minimal techno", "ambient", "nu disco", "drum and bass", "polka", "uk garage", "electronic", "trance", "dubstep")
#: What each name stands for (style, family, tempo, umbrella), said anew for SQL.
_MEANS = """(0, 'Deep House', 'House', 115, 126, false), (1, 'Minimal Techno', 'Techno', 125, 134, false), (2, 'Ambient', 'Ambient', 0, 110, false), (3, 'Nu Disco', 'Disco', 110, 126, false),
(4, 'Drum And Bass', 'Drum And Bass', 160, 180, false), (5, 'Polka', 'Polka', null, null, false), (6, 'Uk Garage', 'Garage', 128, 138, false), (7, 'Electronic', 'Electronic', null, null, true), (8, 'Trance', 'Trance', 130, 145, false), (9, 'Dubstep', 'Dubstep', 135, 150, false)"""
_ORGANISED = f"""n(k, style, major, lo, hi, umbrella) as (values {_MEANS}), x as (select vec_id as track_id, label, embedding::DOUBLE[] as e from embeddings where embedding is not null), a as {A},
l as (select track_id, 0 as i, label % 10 as k from x where track_id % 3 = 0 and label is not null union all select track_id, 1, (label + 3) % 10 from x where track_id % 3 = 0 and label is not null),
s as (select * from (select l.*, n.*, bool_and(umbrella) over (partition by track_id) as vague from l join n using (k)) where vague or not umbrella),
fam as (select avg(case when major in ('Polka', 'Electronic') then 0.0 else 1.0 end) >= 0.6 as gate from s),
ok as (select s.*, s.style = s.major as broad from s cross join fam left join a using (track_id) where (not gate or major not in ('Polka', 'Electronic')) and (bpm is null or lo is null or bpm between lo - 4 and hi + 4 or bpm / 2 between lo - 4 and hi + 4 or bpm * 2 between lo - 4 and hi + 4)),
named as (select * from (select *, row_number() over (partition by track_id order by broad, i) as nth from ok) where nth = 1),
taught as (select track_id, 'My Sound' as genre, 'House' as major from x where track_id % 50 = 7),
own as (select track_id, case when not broad then style end as genre, major, case when broad then 0.6 else 0.85 end::double as confidence from named where track_id not in (select track_id from taught) union all select *, 1.0 from taught),
v as (select x.track_id, e, bpm, genre, major, confidence from x left join a using (track_id) left join own using (track_id)), anchors as (select * from v where genre is not null),
p as (select t.track_id, t.major as own_major, c.track_id as anchor, c.genre, c.major, round(list_cosine_similarity(t.e, c.e), 6) as score, coalesce(abs(t.bpm - c.bpm) <= 14, true) as near from v t, anchors c where t.genre is null),
f as (select * from (select *, row_number() over (partition by track_id order by coalesce(own_major = major, false) desc, score desc, anchor) as nth from p where near and score >= 0.2) where nth = 1),
r as (select * from (select *, row_number() over (partition by track_id order by score desc, anchor) as nth from p where track_id not in (select track_id from f)) where nth = 1),
placed as (select track_id, genre, major, confidence, 'own' as via from anchors union all select track_id, genre, major, score, 'similar' from f union all select track_id, '', coalesce(own_major, major), score, 'unsorted' from r)"""


def _organised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).filter("vector is not null").select(F.col("item_id").alias("track_id"), "vector", "genre_id")
    names = F.array(*[F.lit(x) for x in _NAMES])
    said = lambda k: F.get(names, (F.col("genre_id") + k).cast("int") % 10)
    own = t.filter("track_id % 3 = 0 and genre_id is not null").select("track_id", F.array(said(0), said(3)).alias("genres"))
    a = view(spark, sf_dir, ANALYSIS)
    genres = spark.sql("select * from values (1L, 'House', null), (2L, 'My Sound', 1L) as t(genre_id, name, parent_id)")
    taught = t.filter("track_id % 50 = 7").select(F.lit(2).cast("long").alias("genre_id"), "track_id")
    return metadata.organised(metadata.labelled(metadata.own_genres(own, a), taught, genres), t.select("track_id", "vector"), a, least=0.2)


@query(f"with {_ORGANISED} select track_id, genre, major, round(confidence, 6) as confidence, via from placed")
def auto_organize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by family and genre: as taught, their own where tempo allows, else that of the most similar track of a like tempo, else unsorted."""
    found = _organised(spark, sf_dir)
    return found.select("track_id", F.coalesce("genre", F.lit("")).alias("genre"), "major", F.round("confidence", 6).alias("confidence"), "via")


@query(f"""with {_ORGANISED}, b as (select major, case when genre = '' then concat(major, ' - Unsorted') else genre end as sub from placed)
select major, sub, count(*) as n from b group by all union all select major, '', count(*) from b group by all""")
def genre_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tree_of(_organised(spark, sf_dir)).select("major", F.coalesce("sub", F.lit("")).alias("sub"), "n")


#: The same with tags on a third of the tracks, each genre named by its own words.
_TAGGED = _ORGANISED.replace(_MEANS, _MEANS + ", (10, 'House', 'House', 118, 130, false), (11, 'Techno', 'Techno', 125, 140, false), (12, 'Ambient', 'Ambient', 0, 110, false), (13, 'Disco', 'Disco', 108, 130, false)").replace(
    "l as (",
    "l as (select track_id, 0 as i, case track_id % 5 when 0 then 10 when 1 then 11 else 12 end as k from x where track_id % 3 = 1 and track_id % 5 in (0, 1, 3) union all select track_id, 1, 13 from x where track_id % 3 = 1 and track_id % 5 = 3 union all ",
)
_SUBS = "b as (select track_id, major, case when genre = '' then concat(major, ' - Unsorted') else genre end as sub, confidence from placed)"


def _sorted(spark: SparkSession, sf_dir: str, own_space: bool) -> autosort.Sorted:
    t = tracks(spark, sf_dir).filter("vector is not null").select(F.col("item_id").alias("track_id"), "vector", "genre_id", F.concat(F.lit("/in/"), F.col("item_id").cast("string"), F.lit("/"), (F.col("item_id") % 50).cast("string"), F.lit(".mp3")).alias("path"))
    names = F.array(*[F.lit(x) for x in _NAMES])
    said = lambda k: F.get(names, (F.col("genre_id") + k).cast("int") % 10)
    identities = t.filter("track_id % 3 = 0 and genre_id is not null").select("track_id", F.array(said(0), said(3)).alias("genres"))
    k, words = F.col("track_id") % 5, lambda *w: F.array(*[F.lit(x) for x in w])
    heard = F.when(k == 0, words("Music", "House music", "Electronic music")).when(k == 1, words("Techno")).when(k == 2, words("Dance music")).when(k == 3, words("Ambient music", "Disco")).otherwise(words())
    tags = t.filter("track_id % 3 < 2").select("track_id", F.when((F.col("track_id") % 3 == 1) | F.col("genre_id").isNotNull(), heard).alias("genres"))
    genres = spark.sql("select * from values (1L, 'House', null, 'genre'), (2L, 'My Sound', 1L, 'subgenre'), (7L, 'Forgotten', 1L, 'subgenre') as t(genre_id, name, parent_id, level)")
    taught = t.filter("track_id % 50 = 7").select(F.lit(2).cast("long").alias("genre_id"), "track_id")
    return autosort.auto_sorted(t.select("track_id", "path", "vector"), identities, tags, view(spark, sf_dir, ANALYSIS), genres, taught, least=0.2, root="/r", space=t.select("track_id", "vector") if own_space else None)


def _by_name(found: autosort.Sorted, rows: DataFrame) -> DataFrame:
    """rows with major and sub, the names of their genre and its parent."""
    parents = found.genres.select(F.col("genre_id").alias("parent_id"), F.col("name").alias("major"))
    return rows.join(found.genres.select("genre_id", F.col("name").alias("sub"), "parent_id").join(parents, "parent_id").drop("parent_id"), "genre_id")


@query(f"""with {_TAGGED}, {_SUBS}, d as (select *, row_number() over (partition by major, sub, track_id % 50 order by track_id) - 1 as n from b)
select track_id, major, sub, round(confidence, 6) as confidence, concat('/r/', major, '/', sub, '/', track_id % 50, case when n > 0 then concat(' (', n, ')') else '' end, '.mp3') as dest from d""")
def sorted_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre and destination of every track, filled by the vectors as they come."""
    found = _sorted(spark, sf_dir, True)
    rows = _by_name(found, found.assignments).join(found.plan, "track_id")
    return rows.select("track_id", "major", "sub", F.round("confidence", 6).alias("confidence"), "dest")


@query(f"""with {_TAGGED}, {_SUBS}, m as (select major, sub, i - 1 as i, avg(e[i]) as m from b join x using (track_id), range(1, 65) r(i) group by all)
select major, sub, i, round(m / sqrt(sum(m * m) over (partition by major, sub)), 6) as x from m""")
def sorted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the genres that sorting makes."""
    found = _sorted(spark, sf_dir, True)
    rows = _by_name(found, found.centroids).select("major", "sub", F.posexplode("vector").alias("i", "x"))
    return rows.select("major", "sub", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query()
def sorted_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre and destination of every track, filled by nearness in the reduced space."""
    found = _sorted(spark, sf_dir, False)
    return _by_name(found, found.assignments).join(found.plan, "track_id").select("track_id", "major", "sub", "confidence", "dest")
