"""Registered queries over a library: keys, moods, names, reviews, merges, genres and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crate.functions import music

QUERIES: dict = {}
SQL: dict[str, str] = {}

TRACKS = "select p_partkey as track_id, concat('/lib/', p_brand, '/', p_name, '.mp3') as path, p_name as title from {part}"
ANALYSIS = """select p_partkey as track_id, 90 + cast((p_partkey * 37) % 9000 as double) / 100 as bpm,
cast((p_partkey * 7919) % 1000 as double) / 1000 as energy, cast((p_partkey * 104729) % 1000 as double) / 1000 as danceability,
concat(case p_partkey % 12 when 0 then 'C' when 1 then 'C#' when 2 then 'D' when 3 then 'Eb' when 4 then 'E' when 5 then 'F' when 6 then 'F#' when 7 then 'G' when 8 then 'Ab' when 9 then 'A' when 10 then 'Bb' else 'B' end,
case when cast(floor(p_partkey / 12.0) as bigint) % 2 = 0 then ' maj' else ' min' end) as music_key from {part}"""
GENRES = """select cast(r_regionkey + 1 as bigint) as genre_id, r_name as name, cast(null as bigint) as parent_id, 'genre' as level from {region}
union all select cast(100 + n_nationkey as bigint), n_name, cast(n_regionkey + 1 as bigint), 'subgenre' from {nation}"""
ASSIGNMENTS = """select c_custkey as track_id, cast(100 + c_nationkey as bigint) as genre_id, abs(c_acctbal) / cast(10000 as double) as confidence,
case c_mktsegment when 'HOUSEHOLD' then 'confirmed' when 'MACHINERY' then 'rejected' else 'suggested' end as status from {customer}"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = [n for n in ("part", "region", "nation", "customer", "documents", "events") if f"{{{n}}}" in text]
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(text: str) -> str:
    return text.format(part="part", region="region", nation="nation", customer="customer", documents="documents", events="events")


A, G, S, T = (f"({duck(x)})" for x in (ANALYSIS, GENRES, ASSIGNMENTS, TRACKS))


def _wheel_sql(key: str) -> str:
    """Number on the wheel: seven steps of twelve for each semitone of the key, or of the relative major of a minor one."""
    notes = " ".join(f"when '{note}' then {semitone}" for note, semitone in music.SEMITONES.items())
    return f"(7 * (case lower(split_part({key}, ' ', 1)) {notes} end + case lower(split_part({key}, ' ', 2)) when 'maj' then 0 else 3 end) + 7) % 12 + 1"


@query(f"""with k as (select track_id, {_wheel_sql('music_key')} as n, case when music_key like '%maj' then 'B' else 'A' end as ring from {A}),
d as (select a.track_id, a.n, a.ring, b.n as n2, b.ring as ring2, least((a.n - b.n + 12) % 12, (b.n - a.n + 12) % 12) as apart from k a left join k b on b.track_id = a.track_id + 5)
select track_id, concat(n::varchar, ring) as label, round(case when n2 is null then 0.5 when apart = 0 or (ring = ring2 and apart = 1) then 0.0 else least(1.0, apart / 6.0 + case when ring = ring2 then 0.0 else 0.25 end) end, 6)::double as distance from d""")
def camelot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each track's key on the wheel, and how far the key of the track five places on is from it."""
    a = view(spark, sf_dir, ANALYSIS).select("track_id", music.wheel_position(F.col("music_key")).alias("c"))
    b = a.select((F.col("track_id") - 5).alias("track_id"), F.col("c").alias("c2"))
    return a.join(b, "track_id", "left").select("track_id", music.wheel_label(F.col("c")).alias("label"), F.round(music.harmonic_distance(F.col("c"), F.col("c2")), 6).alias("distance"))


_MOODS_SQL = ", ".join(f"('{n}', {v}, {a})" for n, v, a in music.MOODS)
MOOD_ROWS = f"""m(mood, mv, ma) as (values {_MOODS_SQL}),
p as (select track_id, greatest(0.0, least(1.0, 0.5 + case when music_key like '%maj%' then 0.15 else -0.1 end + (energy - 0.5) * 0.3))::double as v, greatest(0.0, least(1.0, energy + (bpm - 105.0) / 560.0))::double as a from {A}),
s as (select track_id, mood, greatest(0.0, 1.0 - sqrt(pow(v - mv, 2) + pow(a - ma, 2)) / 0.65) as score from p, m),
r as (select *, row_number() over (partition by track_id order by score desc, mood desc) as rank from s)"""


@query(f"with {MOOD_ROWS} select track_id, rank, mood, round(score, 3) as score from r where (rank <= 4 and score >= 0.34) or rank = 1")
def named_moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ANALYSIS)
    moods = music.named_moods(music.valence(F.col("energy"), F.col("music_key")), F.col("energy"), F.col("bpm"))
    return a.select("track_id", F.posexplode(moods).alias("i", "m")).select("track_id", (F.col("i") + 1).cast("long").alias("rank"), "m.mood", "m.score")


_TEMPO_SQL = " ".join(f"when contains(g, '{w}') then " + " or ".join(f"b{k} between {lo - 4} and {hi + 4}" for k in "123") for w, (lo, hi) in music.GENRE_TEMPO.items())
_STYLES = ["Deep House", "Hard Techno", "Nu Disco", "Ambient", "Drum and Bass", "Polka", "Uk Garage", "Trance"]
_STYLE_SQL = "case track_id % 8 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_STYLES)) + " end"


@query(f"""with t as (select track_id, {_STYLE_SQL} as genre, lower({_STYLE_SQL}) as g, bpm as b1, bpm / 2 as b2, bpm * 2 as b3 from {A})
select track_id, genre, case {_TEMPO_SQL} else true end as plausible from t""")
def bpm_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, ANALYSIS).withColumn("genre", F.expr(_STYLE_SQL))
    return t.select("track_id", "genre", music.tempo_plausible(F.col("genre"), F.col("bpm")).alias("plausible"))


@query(f"select track_id, bpm_class, median(bpm) over (partition by bpm_class) as med, round(exp(-pow(least(abs(bpm - med), abs(bpm / 2 - med), abs(bpm * 2 - med)) / 12, 2)), 9) as affinity from (select *, track_id % 7 as bpm_class from {A})")
def tempo_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ANALYSIS).withColumn("bpm_class", F.expr("track_id % 7"))
    med = a.groupBy("bpm_class").agg(F.expr("percentile(bpm, 0.5)").alias("med"))
    return a.join(F.broadcast(med), "bpm_class").select("track_id", "bpm_class", "med", F.round(music.tempo_affinity(F.col("bpm"), F.col("med")), 9).alias("affinity"))


@query(r"""with t as (select p_partkey as track_id, concat(p_name, case p_partkey % 4 when 0 then ': a/b?. ' when 1 then ' <x|y>' when 2 then '...' else '' end) as name from part),
c as (select *, regexp_replace(translate(name, '\/:*?"<>|', '_________'), '[ .]+$', '') as d from t) select track_id, case when length(d) > 0 then d else '_' end as safe from c""")
def sanitize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select p_partkey as track_id, concat(p_name, case p_partkey % 4 when 0 then ': a/b?. ' when 1 then ' <x|y>' when 2 then '...' else '' end) as name from {part}"
    return view(spark, sf_dir, text).select("track_id", music.sanitized(F.col("name")).alias("safe"))


@query(f"""select a.track_id, g.genre_id, g.name, p.name as parent, case when p.name is null then g.name else concat(p.name, ' / ', g.name) end as label, round(a.confidence, 6) as confidence
from {S} a join {G} g using (genre_id) left join {G} p on p.genre_id = g.parent_id where a.status <> 'rejected'""")
def genre_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments with the names of their genres and parents."""
    g = view(spark, sf_dir, GENRES)
    p = g.select(F.col("genre_id").alias("parent_id"), F.col("name").alias("parent"))
    rows = view(spark, sf_dir, ASSIGNMENTS).filter("status <> 'rejected'").join(F.broadcast(g), "genre_id").join(F.broadcast(p), "parent_id", "left")
    return rows.select("track_id", "genre_id", "name", "parent", F.coalesce(F.concat("parent", F.lit(" / "), "name"), "name").alias("label"), F.round("confidence", 6).alias("confidence"))


@query(f"select track_id, genre_id, round(confidence, 6) as confidence from {S} where status = 'suggested' order by {S}.confidence, track_id limit 20".replace(f"{S}.confidence", "confidence"))
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, ASSIGNMENTS).filter("status = 'suggested'").withColumn("confidence", F.round("confidence", 6))
    return s.select("track_id", "genre_id", "confidence").orderBy("confidence", "track_id").limit(20)


@query(f"""with u as (select track_id, genre_id, 1 as pri from {S} where status = 'confirmed' union all select p_partkey, 100 + p_partkey % 25, 0 from part),
r as (select *, row_number() over (partition by track_id order by pri desc, genre_id) as n from u) select track_id, genre_id from r where n = 1""")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of tracks: exemplars, overridden by confirmed assignments."""
    confirmed = view(spark, sf_dir, ASSIGNMENTS).filter("status = 'confirmed'").select("track_id", "genre_id", F.lit(1).alias("pri"))
    by_example = view(spark, sf_dir, "select p_partkey as track_id, 100 + p_partkey % 25 as genre_id, 0 as pri from {part}")
    n = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("pri"), "genre_id"))
    return confirmed.unionByName(by_example).withColumn("n", n).filter("n = 1").select("track_id", "genre_id")


@query(f"select track_id from {T} where track_id not in (select track_id from {S} where status <> 'suggested')")
def worklist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that still lack a decision."""
    done = view(spark, sf_dir, ASSIGNMENTS).filter("status <> 'suggested'").select("track_id")
    return view(spark, sf_dir, TRACKS).select("track_id").join(done, "track_id", "left_anti")


@query("""with m as (select doc_id as track_id, sha1(coalesce(text, '')) as content_hash, concat('/lib/', source, '/', doc_id::varchar, '.txt') as path from documents),
r as (select *, min(track_id) over (partition by content_hash) as id, row_number() over (partition by content_hash order by track_id desc) as n from m) select id as track_id, content_hash, path from r where n = 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest upsert by content hash: the first id stays, the path of the latest row wins."""
    m = view(spark, sf_dir, "select doc_id as track_id, sha1(coalesce(text, '')) as content_hash, concat('/lib/', source, '/', cast(doc_id as string), '.txt') as path from {documents}")
    return m.groupBy("content_hash").agg(F.min("track_id").alias("track_id"), F.max_by("path", "track_id").alias("path"))


@query(f"""with old as (select track_id, bpm, music_key from {A}), new as (select c_custkey as track_id, case when c_custkey % 2 = 0 then 100.0 + c_custkey % 40 end as bpm, case when c_custkey % 3 = 0 then 'A min' end as music_key from customer)
select coalesce(n.track_id, o.track_id) as track_id, round(coalesce(n.bpm, o.bpm), 6)::double as bpm, coalesce(n.music_key, o.music_key) as music_key from old o full join new n on n.track_id = o.track_id""")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge that keeps old values where the new row has none."""
    from crate.sources.tables import patch

    old = view(spark, sf_dir, ANALYSIS).select("track_id", "bpm", "music_key")
    new = view(spark, sf_dir, "select c_custkey as track_id, case when c_custkey % 2 = 0 then cast(100 + c_custkey % 40 as double) end as bpm, case when c_custkey % 3 = 0 then 'A min' end as music_key from {customer}")
    return patch(old, new, ["track_id"]).withColumn("bpm", F.round("bpm", 6))


@query("""with w as (select user_id as mix_id, event_type as best, value as score, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events),
k as (select * from w where score >= 20), c as (select *, case when lag(best) over (partition by mix_id order by seq) is distinct from best then 1 else 0 end as new from k),
i as (select *, sum(new) over (partition by mix_id order by seq) as run from c) select mix_id, run::bigint as run, best, min(seq) as first_seq, max(seq) as last_seq, round(max(score), 6) as score from i group by mix_id, run, best""")
def mix_tracklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a mix with their best matches, merged to runs; windows below the floor don't break a run."""
    from crate.operators.mixes import merged_runs

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    w = e.select(F.col("user_id").alias("mix_id"), F.col("event_type").alias("best"), F.col("value").alias("score"), seq.alias("seq"))
    return merged_runs(w, floor=20.0).withColumn("score", F.round("score", 6))


#: A genre tree that grows with the customers: each node's parent has a quarter of its number.
TREE = "select cast(c_custkey as bigint) as genre_id, concat('Style ', cast(c_custkey as {text})) as name, cast(nullif(floor(c_custkey / 4.0), 0) as bigint) as parent_id from {customer}"
R = f"({TREE.format(text='varchar', customer='customer')})"


@query(f"""with recursive t as (select genre_id, name, parent_id, 0 as depth, genre_id as start from {R} union all select g.genre_id, g.name, g.parent_id, t.depth + 1, t.start from t join {R} g on g.genre_id = t.parent_id)
select start as genre_id, genre_id as ancestor_id, name, depth from t where depth > 0""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crate.operators.taxonomy import ancestors as chain

    return chain(view(spark, sf_dir, TREE.replace("{text}", "string")))


@query(f"""with a as (select track_id, genre_id from {S} where status <> 'rejected'), g as {G}, t as {T},
d as (select t.track_id, concat('/music/', regexp_replace(translate(coalesce(p.name, 'Unknown'), '\\/:*?"<>|', '_________'), '[ .]+$', ''), '/', regexp_replace(translate(g.name, '\\/:*?"<>|', '_________'), '[ .]+$', ''), '/', t.title, '.mp3') as dest from t join a using (track_id) join g using (genre_id) left join g p on p.genre_id = g.parent_id where g.level = 'subgenre'),
r as (select *, row_number() over (partition by dest order by track_id) as n from d) select track_id, case when n = 1 then dest else concat(left(dest, length(dest) - 4), ' (', (n - 1)::varchar, ').mp3') end as dest from r""")
def organize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crate.operators.organise import plan

    s = view(spark, sf_dir, ASSIGNMENTS).filter("status <> 'rejected'")
    return plan(view(spark, sf_dir, TRACKS), s, view(spark, sf_dir, GENRES), "/music").select("track_id", "dest")


@query(f"""with s as (select lower(trim(n.name)) as name, count(*) as uses, min(a.track_id) as first_track from {S} a join {G} n using (genre_id) group by 1 having count(*) >= 3) select name, uses, first_track from s where name not in (select lower(r_name) from region)""")
def seed_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names used by at least three tracks that aren't genres yet."""
    named = view(spark, sf_dir, ASSIGNMENTS).join(F.broadcast(view(spark, sf_dir, GENRES)), "genre_id").withColumn("name", F.lower(F.trim("name")))
    known = view(spark, sf_dir, "select lower(r_name) as name from {region}")
    return named.groupBy("name").agg(F.count("*").alias("uses"), F.min("track_id").alias("first_track")).filter("uses >= 3").join(known, "name", "left_anti")
