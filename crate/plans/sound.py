"""Registered queries on frames, walks, sets, groups and streams. Frames are made of the embeddings: 50 vectors a track."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.functions import music, names, requests
from crate.functions import vectors as fv
from crate.operators import groups, signal, taxonomy, walks
from crate.plans.library import A, ANALYSIS, G, GENRES, T, TRACKS, _wheel_sql, view
from crate.plans.vectors import tracks
from crate.storage import saved, shared_dir
from crate.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).filter("vector is not null")
    return t.select(F.expr("item_id div 50").alias("track_id"), F.expr("item_id % 50").alias("frame_idx"), F.transform("vector", F.abs).alias("mag"))


FR = "f as (select vec_id // 50 as track_id, vec_id % 50 as frame_idx, list_transform(embedding::DOUBLE[], lambda y: abs(y)) as mag from embeddings where embedding is not null)"
ENV = f"""{FR}, b as (select track_id, frame_idx, i, ln(1 + mag[i]) as m, lag(ln(1 + mag[i])) over (partition by track_id, i order by frame_idx) as p from f, range(1, 65) t(i)),
x as (select track_id, frame_idx, sum(greatest(coalesce(m - p, 0), 0)) as flux from b group by all), env as (select track_id, frame_idx, flux - avg(flux) over (partition by track_id) as env from x)"""


@query(f"with {ENV} select track_id, frame_idx, round(env, 6) as env from env")
def flux_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.onsets(frames(spark, sf_dir)).withColumn("env", F.round("env", 6))


@query(f"""with {ENV}, p as (select track_id, sum(env * env) as p0 from env group by 1)
select a.track_id, l.lag, round(sum(a.env * b.env) / any_value(p0), 6) as ac from env a, range(1, 13) l(lag), env b, p where b.track_id = a.track_id and b.frame_idx = a.frame_idx + l.lag and p.track_id = a.track_id group by all""")
def tempo_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = saved(signal.onsets(frames(spark, sf_dir)), "env")
    return signal.lag_products(env, list(range(1, 13))).select("track_id", F.col("lag").cast("long").alias("lag"), F.round("ac", 6).alias("ac"))


_PROFILES = ", ".join(f"({t}, {m}, {i}, {p[(i - t) % 12]})" for t in range(12) for m, p in ((0, signal.MAJOR_PROFILE), (1, signal.MINOR_PROFILE)) for i in range(12))
_PITCH_LIST = "[" + ", ".join(f"'{p}'" for p in signal.PITCHES) + "]"


@query(f"""with {FR}, k(tonic, mi, pc, w) as (values {_PROFILES}), c as (select track_id, (i - 2) % 12 as pc, avg(mag[i]) as x from f, range(2, 65) t(i) group by track_id, i),
s as (select track_id, pc, sum(x) as x from c group by all), r as (select track_id, tonic, mi, round(corr(x, w), 9) as score from s join k using (pc) group by all),
b as (select *, row_number() over (partition by track_id order by score desc, tonic, mi) as n from r)
select track_id, concat(({_PITCH_LIST})[tonic + 1], case when mi = 1 then ' min' else ' maj' end) as music_key, round(score, 6) as score from b where n = 1""")
def key_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pitch = [None, *[i % 12 for i in range(63)]]
    return signal.key_estimate(signal.chroma(frames(spark, sf_dir), pitch)).withColumn("score", F.round("score", 6))


_BAND_SQL = f"{FR}, e as (select track_id, frame_idx, (i - 1) // 11 as band, sum(mag[i]) as e from f, range(1, 65) t(i) group by all)"
_BANDS = [i // 11 for i in range(64)]


@query(f"""with {_BAND_SQL}, s as (select *, e / (sum(e) over (partition by track_id, frame_idx) + 1e-9) as share, e / (max(e) over (partition by track_id, band) + 1e-9) as en from e),
d as (select *, abs(en - lag(en) over (partition by track_id, band order by frame_idx)) as d from s) select track_id, band, round(avg(share), 4) as share, round(avg(d), 4) as flux, round(stddev_pop(en), 4) as dynamics from d group by track_id, band""")
def groove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.groove(signal.band_sums(frames(spark, sf_dir), _BANDS)).withColumn("band", F.col("band").cast("long"))


@query(f"with {_BAND_SQL}, m as (select track_id, band, sqrt(avg(e)) as r from e group by all) select track_id, band, round(r / sqrt(sum(r * r) over (partition by track_id)), 4) as level from m")
def band_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.band_profile(signal.band_sums(frames(spark, sf_dir), _BANDS)).withColumn("band", F.col("band").cast("long"))


@query(f"""with {_BAND_SQL}, l as (select *, max(frame_idx) over (partition by track_id) + 1 as last from e), b as (select track_id, case when last <= 10 then frame_idx else floor(((frame_idx + 1) * 10 - 1) / last) end::bigint as bin, band, avg(e) as x from l group by all)
select track_id, bin, band, round(sqrt(x / max(x) over (partition by track_id)), 4) as level from b""")
def waveform_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.timeline(signal.band_sums(frames(spark, sf_dir), _BANDS), 10)
    return found.withColumn("bin", F.col("bin").cast("long")).withColumn("band", F.col("band").cast("long"))


TAGS = "w as (select vec_id // 50 as track_id, unnest(list_transform(range(1, 65, 8), lambda k: (list_position(embedding[k : k + 7], list_max(embedding[k : k + 7])) - 1)::bigint + k)) as word from embeddings where embedding is not null)"


@query(f"""with {TAGS}, t as (select track_id, word, count(*) as n from w group by all), f as (select word, count(*) as df from t group by 1), c as (select count(distinct track_id) as nn from t),
s as (select track_id, word, n / sum(n) over (partition by track_id) * (ln((nn + 1) / (df + 1)) + 1) as x from t join f using (word), c)
select track_id, word, round(x / sqrt(sum(x * x) over (partition by track_id)), 6) as weight from s""")
def word_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag of audio words: the word of each eight entries is the place of the greatest."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding is not null").select(F.expr("vec_id div 50").alias("track_id"), "embedding")
    word = F.transform(F.sequence(F.lit(1), F.lit(57), F.lit(8)), lambda k: (F.array_position(F.slice("embedding", k, 8), F.array_max(F.slice("embedding", k, 8))) - 1 + k).cast("long"))
    return groups.tfidf(t.select("track_id", F.explode(word).alias("word"))).withColumn("weight", F.round("weight", 6))


@query()
def kmeans_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.kmeans(groups.pca(tracks(spark, sf_dir), 16, unit=True), 10)


@query()
def project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.pca(tracks(spark, sf_dir), 2).select("item_id", F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[1], 6).alias("y"))


@query("""with recursive u as (select vec_id, list_transform(embedding::DOUBLE[], lambda y: y / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z)))) as v from embeddings where embedding is not null),
d as (select a.vec_id as q, b.vec_id as i, round(list_sum(list_transform(range(1, 65), lambda j: a.v[j] * b.v[j])), 6) as score from u a, u b where a.vec_id <> b.vec_id),
r as materialized (select * from (select *, row_number() over (partition by q order by score desc, i) as rank from d) where rank <= 10), core as (select q, 1 - score as core from r where rank = 5), eps as (select quantile_disc(core, 0.75) as eps from core),
e as materialized (select r.q as a, r.i as b from r join core x on x.q = r.q join core y on y.q = r.i, eps where greatest(1 - score, x.core, y.core) <= eps), s as materialized (select a, b from e union select b, a from e),
c as (select distinct a as item, a as other from s union select c.item, s.b from c join s on s.a = c.other), l as (select item, min(other) as label from c group by 1), n as (select label from l group by 1 having count(*) >= 5)
select u.vec_id as item_id, coalesce(n.label, -1) as cluster from u left join l on l.item = u.vec_id left join n using (label)""")
def density_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each track, named by its least track; -1 is noise."""
    found = groups.density_groups(tracks(spark, sf_dir).filter("vector is not null"), min_size=5)
    return found.select("item_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


@query()
def clustered_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the collection with the genre whose centroid is nearest to most of their tracks."""
    from crate.operators import classify

    t = tracks(spark, sf_dir).filter("vector is not null")
    found = saved(groups.clustered(t, min_size=5), "clusters").filter("cluster is not null")
    scores = classify.centroid_scores(t, classify.mean_vectors(t.filter("genre_id is not null"), "genre_id"))
    nearest = scores.groupBy("item_id").agg(F.max(F.struct("score", (-F.col("genre_id")).alias("o"))).alias("b")).select("item_id", (-F.col("b.o")).alias("genre_id"))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"), F.min("item_id").alias("first_track"))
    return sizes.join(classify.vote(found.join(nearest, "item_id"), "cluster", "genre_id"), "cluster").select("first_track", "n", "genre_id", "votes")


@query()
def learned_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    labels = t.filter("item_id % 5 <> 0 and genre_id is not null").select("item_id", F.col("genre_id").alias("label"))
    return groups.shrunk_lda(t, labels).select("item_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query()
def propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for tracks without one: the nearest prototype in the learned space, times how well its tempo fits."""
    from crate.operators import classify

    t = tracks(spark, sf_dir).filter("vector is not null")
    labels = t.filter("item_id % 5 <> 0 and genre_id is not null").select("item_id", F.col("genre_id").alias("label"))
    space = saved(groups.shrunk_lda(t, labels), "learned")
    bpm = view(spark, sf_dir, ANALYSIS).select(F.col("track_id").alias("item_id"), "bpm")
    medians = bpm.join(labels, "item_id").groupBy(F.col("label").alias("genre_id")).agg(F.expr("percentile(bpm, 0.5)").alias("median"))
    protos = classify.mean_vectors(space.join(labels.withColumnRenamed("label", "genre_id"), "item_id"), "genre_id")
    scores = classify.centroid_scores(space.join(labels, "item_id", "left_anti"), protos).join(bpm, "item_id", "left").join(F.broadcast(medians), "genre_id", "left")
    fit = (F.col("score") + 1) / 2 * music.tempo_affinity(F.col("bpm"), F.col("median"))
    best = scores.groupBy("item_id").agg(F.max(F.struct(F.round(fit, 6).alias("confidence"), (-F.col("genre_id")).alias("o"))).alias("b"))
    return best.select("item_id", (-F.col("b.o")).alias("genre_id"), "b.confidence")


@query("""with recursive x as (select vec_id, embedding::DOUBLE[] as e from embeddings where embedding is not null), p as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 6) as score from x a, x b where a.vec_id <> b.vec_id),
w as (select vec_id as seed, 0 as position, vec_id as item_id, [vec_id] as played from x where vec_id % 100 = 0
union all select seed, position + 1, arg_min(b, [-score, b::double]), list_append(any_value(played), arg_min(b, [-score, b::double])) from w join p on a = item_id where position < 5 and not list_contains(played, b) group by seed, position)
select seed, position, item_id from w""")
def radio_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).filter("vector is not null")
    return walks.radio(t.filter("item_id % 100 = 0").select(F.col("item_id").alias("seed")), t, 6)


WISHES = "select r_regionkey as request_id, concat(case r_regionkey when 0 then 'start slow and deep, build up to peak, then wind down' when 1 then 'warm chilled sunset session' when 2 then 'build to 124-128 bpm tech house, 6 tracks' when 3 then 'punchy energetic female vocal' else 'steady groovy instrumental with piano' end, ' for ', lower(r_name)) as text from {region}"


SENTENCES = WISHES.replace("r_regionkey", "c_custkey").replace("case c_custkey", "case c_custkey % 5").replace("lower(r_name)", "lower(c_name)").replace("{region}", "{customer}")


@query("""with w as (select c_custkey as request_id, case c_custkey % 5 when 0 then 'rise-then-fall' when 1 then 'low' when 2 then 'build' when 3 then 'build' else 'mid' end as shape, case c_custkey % 5 when 2 then 124 else -1 end as bpm_lo, case c_custkey % 5 when 2 then 128 else -1 end as bpm_hi,
case c_custkey % 5 when 2 then 6 else -1 end as length, case c_custkey % 5 when 3 then 'vocal' when 4 then 'instrumental' else '' end as vocal, case c_custkey % 5 when 3 then 'female' else '' end as gender, case c_custkey % 5 when 2 then 'house,tech house' else '' end as genres,
case c_custkey % 5 when 0 then 'deep' when 1 then 'warm' when 3 then 'energetic' when 4 then 'groovy' else '' end as moods, case c_custkey % 5 when 4 then 'Piano' else '' end as instruments from customer) select * from w""")
def parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests.parsed(view(spark, sf_dir, SENTENCES))
    number, word = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c), lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return r.select("request_id", "shape", number("bpm_lo"), number("bpm_hi"), number("length"), word("vocal"), word("gender"), *[F.concat_ws(",", c).alias(c) for c in ("genres", "moods", "instruments")])


@query("""with a as (select p_partkey as track_id, 1 + p_partkey % 20 as n, [0.2, 0.46, 0.72, 0.72, 0.46, 0.2] as arc from part), t as (select track_id, n, i, arc, case when n = 1 then 3.0 else i * 5.0 / (n - 1) end as pos from a, range(0, 20) r(i) where i < n)
select track_id, i as position, round(arc[floor(pos)::int + 1] * (1 - (pos - floor(pos))) + arc[least(floor(pos)::int + 1, 5) + 1] * (pos - floor(pos)), 4)::double as target from t""")
def resample_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "select p_partkey as track_id, cast(1 + p_partkey % 20 as int) as n, array(0.2D, 0.46D, 0.72D, 0.72D, 0.46D, 0.2D) as arc from {part}")
    return a.select("track_id", F.posexplode(requests.resampled(F.col("arc"), F.col("n"))).alias("i", "target")).select("track_id", F.col("i").cast("long").alias("position"), "target")


@query()
def set_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets from all tracks. Those with a vector have a record (voice, moods, instruments) and, where labelled, a genre."""
    from crate.plans.records import records

    names = F.array(*[F.lit(x) for x in ("deep house", "minimal techno", "ambient", "nu disco", "drum and bass", "tech house", "uk garage", "electronic", "trance", "dubstep")])
    genre = tracks(spark, sf_dir).select(F.col("item_id").alias("track_id"), F.get(names, F.col("genre_id").cast("int")).alias("genre"))
    named = lambda c, x: F.transform(c, lambda i: i[x]).alias(c)
    r = records(spark, sf_dir).select("track_id", F.col("vocal.kind").alias("vocal"), F.col("vocal.gender").alias("gender"), named("moods", "mood"), named("instruments", "name"))
    a = view(spark, sf_dir, ANALYSIS).select("track_id", "energy", "bpm", "music_key").join(genre, "track_id", "left").join(r, "track_id", "left")
    return walks.build_sets(view(spark, sf_dir, WISHES), a, default_length=8)


#: A wish for each customer, of five kinds and some lengths, and what tracks are like beside their analysis.
ASKED = "select c_custkey as request_id, concat(case c_custkey % 5 when 0 then 'start slow and deep, build up to peak, then wind down' when 1 then 'warm chilled sunset trance session' when 2 then 'build to 124-128 bpm tech house, 6 tracks' when 3 then 'punchy energetic female vocal' else 'steady groovy instrumental with piano' end, ', ', 3 + c_custkey % 4, ' tracks') as text from {customer}"
LIKE = """select p_partkey as track_id, case p_partkey % 7 when 0 then 'Deep House' when 1 then 'Tech House' when 2 then 'Techno' when 3 then 'Ambient' when 4 then 'House' end as genre,
case p_partkey % 4 when 0 then 'vocal' when 1 then 'instrumental' when 2 then 'uncertain' end as vocal, case p_partkey % 8 when 0 then 'female' when 4 then 'male' end as gender,
case p_partkey % 3 when 0 then 'warm' when 1 then 'deep' else 'groovy' end as mood, case p_partkey % 5 when 0 then 'energetic' else 'dark' end as mood2, case when p_partkey % 6 = 0 then 'Piano' end as instrument from {part}"""


@query(f"""with recursive t as (select track_id, energy, bpm, {_wheel_sql('music_key')} as n, music_key like '%maj' as ring, lower(genre) as genre, vocal, gender, [mood, mood2, instrument] as has from {A} join ({LIKE.format(part='part')}) using (track_id)),
k(kind, wanted, arc) as (values (0, ['deep'], [0.2, 0.46, 0.72, 0.72, 0.46, 0.2]::double[]), (1, ['warm'], [0.2, 0.2, 0.2, 0.2, 0.2, 0.2]), (2, []::varchar[], [0.5, 0.57, 0.64, 0.71, 0.78, 0.85]), (3, ['energetic'], [0.5, 0.57, 0.64, 0.71, 0.78, 0.85]), (4, ['groovy', 'Piano'], [0.5, 0.5, 0.5, 0.5, 0.5, 0.5])),
c as (select kind, track_id, energy, bpm, n, ring, case when len(wanted) = 0 then 0.0 else round(-len(list_intersect(wanted, has))::double / len(wanted), 3) end as hits from k, t where case kind when 2 then genre like '%house%' when 3 then gender = 'female' when 4 then vocal in ('instrumental', 'uncertain') else true end),
w as (select c_custkey as request_id, c_custkey % 5 as kind, case c_custkey % 5 when 2 then 6 else 3 + c_custkey % 4 end as want from customer),
p as (select distinct kind, want from w), m as (select kind, want, i, i * 5.0::double / (want - 1) as pos from p, range(0, 6) r(i) where i < want),
g as (select kind, want, i, round(arc[floor(pos)::int + 1] * (1 - (pos - floor(pos))) + arc[least(floor(pos)::int + 1, 5) + 1] * (pos - floor(pos)), 4) as target from m join k using (kind)),
s as (select kind, want, -1::bigint as position, null::bigint as track_id, null::double as target, []::bigint[] as used, null::double as bpm, null::bigint as n, null::boolean as ring from p
union all select kind, want, position, track_id, target, list_append(used, track_id), bpm, n, ring from (
select s.kind, s.want, g.i as position, c.track_id, g.target, s.used, c.bpm, c.n, c.ring, row_number() over (partition by s.kind, s.want order by round(abs(c.energy - g.target), 3), c.hits,
case when s.n is null then 0.0 when s.n = c.n or (s.ring = c.ring and least((s.n - c.n + 12) % 12, (c.n - s.n + 12) % 12) = 1) then 0.0 else round(least(1.0::double, least((s.n - c.n + 12) % 12, (c.n - s.n + 12) % 12) / 6.0::double + case when s.ring = c.ring then 0.0 else 0.25 end), 3) end, coalesce(abs(c.bpm - s.bpm), 0.0), c.track_id) as nth
from s join g on g.kind = s.kind and g.want = s.want and g.i = s.position + 1 join c on c.kind = s.kind where not list_contains(s.used, c.track_id)) where nth = 1)
select request_id, position, track_id, target from w join s using (kind, want) where position >= 0""")
def set_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set for each customer's wish, from all parts as tracks; a wish for a genre that no track has is free of it."""
    like = view(spark, sf_dir, LIKE)
    like = like.select("track_id", "genre", "vocal", "gender", F.array("mood", "mood2").alias("moods"), F.array_compact(F.array("instrument")).alias("instruments"))
    t = view(spark, sf_dir, ANALYSIS).select("track_id", "energy", "bpm", "music_key").join(like.hint("merge"), "track_id")
    return walks.build_sets(view(spark, sf_dir, ASKED), t).withColumn("position", F.col("position").cast("long"))


@query(r"""with p as (select page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) as cells from pages),
c as (select page_id, i, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(cells[i], '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')), 200) as t from p, range(1, 400) r(i) where i <= len(cells)),
d as (select page_id, t, min(i) as i from c where length(t) >= 12 group by all), n as (select *, row_number() over (partition by page_id order by i) as nth from d) select page_id, nth, t as snippet from n where nth <= 6""")
def page_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.posexplode(names.snippets(F.col("html"))).alias("i", "snippet")).select("page_id", (F.col("i") + 1).cast("long").alias("nth"), "snippet")


_MESSY = "case p_partkey % 5 when 0 then concat('Label Premiere: ', p_brand, ' - ', p_name, ' (Club Mix)') when 1 then concat('A1. ', p_brand, ' (NL) - ', p_name, ' [CAT', '01]') when 2 then concat(p_name, ' Free Download.mp3') when 3 then concat('12 - ', p_brand, ' – ', p_name) else p_name end"
_ARTIST = "case p_partkey % 3 when 0 then 'Some Records' when 1 then concat(p_type, ' (UK)') else '' end"


@query(f"""with m as (select p_partkey, p_brand, p_name, p_type, p_partkey % 5 as k, p_partkey % 3 as j from part)
select p_partkey as track_id, case when k in (0, 1, 3) then p_brand when j = 1 and not p_type ilike '%promo%' then p_type else '' end as artist, p_name as title from m""")
def parse_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, f"select p_partkey as track_id, {_MESSY} as title, {_ARTIST} as artist, concat('/lib/', p_name, '.mp3') as path from {{part}}")
    found = names.artist_title(F.col("title"), F.col("artist"), F.col("path"))
    return t.select("track_id", found.alias("f")).select("track_id", F.coalesce("f.artist", F.lit("")).alias("artist"), "f.title")


#: A graph that grows with the customers: the node of a quarter of one's number is above it, and some are linked sideways.
EDGES = "select concat('g', cast(c_custkey as {text})) as src, concat('g', cast(cast(floor(c_custkey / 4.0) as bigint) as {text})) as dst, 'subgenre' as rel from {customer} where c_custkey >= 4 union all select concat('g', cast(c_custkey as {text})), concat('g', cast(c_custkey + 3 as {text})), case when c_custkey % 10 = 0 then 'fusion' else 'influence' end from {customer} where c_custkey % 5 = 0"
EDGES_SQL, EDGES = EDGES.format(text="varchar", customer="customer"), EDGES.replace("{text}", "string")
#: Every tenth node.
SEEDS = "select concat('g', cast(c_custkey as {text})) as seed from {customer} where c_custkey % 10 = 0"


@query(f"""with e as ({EDGES_SQL}), w as (select src, dst, case rel when 'subgenre' then 1.0 when 'fusion' then 0.7 when 'influence' then 0.5 else 0.4 end as w from e),
b as (select src, dst, max(w) as w from (select * from w union all select dst, src, w from w) group by all), o as (select seed, dst as name, w from ({SEEDS.format(text='varchar', customer='customer')}) join b on src = seed),
t as (select seed, name, w from o union all select o.seed, b.dst, b.w * 0.5 from o join b on b.src = o.name where b.dst <> o.seed), m as (select seed, name, max(w)::double as weight from t group by all),
r as (select *, row_number() over (partition by seed order by weight desc, name) as rank from m) select * from r where rank <= 25""")
def related_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = view(spark, sf_dir, SEEDS.replace("{text}", "string"))
    return taxonomy.related(seeds, view(spark, sf_dir, EDGES), 25)


@query(f"""with recursive e as ({EDGES_SQL}), h as (select dst as parent, src as child from e where rel <> 'influence'), n as (select parent as name from h union select child from h),
t as (select [name] as path, name, 0 as depth from n where name not in (select child from h) union all select list_append(path, child), child, depth + 1 from t join h on parent = name where not list_contains(path, child) and depth < 16)
select array_to_string(path, ' > ') as path, name, depth, case when depth = 0 then 'genre' else 'subgenre' end as level from t""")
def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, EDGES).filter("rel <> 'influence'").select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    nodes = links.select(F.col("parent").alias("name")).union(links.select("child")).distinct()
    return taxonomy.unfold(nodes, links).withColumn("path", F.array_join("path", " > "))


@query("""with g as (select c_custkey as genre_id, nullif(c_custkey % 7, 0) as parent_id, c_custkey % 40 as name, c_custkey < 8 as top, c_nationkey as uses from customer),
r as (select genre_id, first_value(genre_id) over (partition by parent_id, name order by top desc, uses desc, genre_id) as keep from g) select genre_id as "drop", keep from r where keep <> genre_id""")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select cast(c_custkey as bigint) as genre_id, concat(' Name ', cast(c_custkey % 40 as string)) as name, cast(nullif(c_custkey % 7, 0) as bigint) as parent_id, case when c_custkey < 8 then 'genre' else 'subgenre' end as level, c_nationkey as uses from {customer}"
    g = view(spark, sf_dir, text)
    return taxonomy.merge_duplicates(g.drop("uses"), g.select("genre_id", "uses"))


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream: counts by hour and type. A last row far ahead passes the watermark over the real ones."""
    return _streamed(spark, sf_dir, lambda s: streams.activity(s)).withColumn("total", F.round("total", 4)).filter("event_type <> '-'")


@query("""with w as (select user_id as mix_id, event_type as best, value as score, ts, event_id from events where value >= 20), c as (select *, case when lag(best) over (partition by mix_id order by ts, event_id) is distinct from best then 1 else 0 end as new from w),
i as (select *, sum(new) over (partition by mix_id order by ts, event_id) as run from c) select mix_id, best, min(ts) as first_ts, max(ts) as last_ts, count(*) as windows, round(max(score), 6) as score from i group by mix_id, run, best""")
def stream_tracklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of mix windows: runs of one best match, from state."""
    shaped = lambda s: s.select(F.col("user_id").alias("mix_id"), F.col("event_type").alias("best"), F.col("value").alias("score"), "ts", "event_id")
    return _streamed(spark, sf_dir, lambda s: streams.tracklist(shaped(s), floor=20.0, gap="30 days", order="event_id"), "event_id").filter("best <> '-'").withColumn("score", F.round("score", 6))


def _streamed(spark: SparkSession, sf_dir: str, f, *more: str) -> DataFrame:
    """f over the events as a file stream, run to its end; its rows are written to a table and read again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), *more)
    base = saved(events, "stream").inputFiles()[0].rsplit("/", 1)[0]
    late = events.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit("-").alias("event_type"), F.lit(1e9).alias("value"), "ts", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in more])
    out = f"{shared_dir(spark)}/stream-{tempfile.mktemp(dir='')[1:]}"
    for last in (None, late):
        if last is not None:
            last.write.mode("append").parquet(base)
        run = f(spark.readStream.schema(events.schema).parquet(base)).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
