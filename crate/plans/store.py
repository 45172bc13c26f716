"""Registered queries on keyed tables, listings, windows, names and pooled vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.functions import music, names, requests
from crate.functions import vectors as fv
from crate.operators import classify, metadata, organise, signal, taxonomy
from crate.plans.library import A, ANALYSIS, ASSIGNMENTS, G, GENRES, R, S, T, TRACKS, TREE, view
from crate.plans.sound import EDGES, EDGES_SQL
from crate.plans.vectors import tracks
from crate.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FILES = "select doc_id, concat('/lib/', source, '/', cast(doc_id as string), '.txt') as path, sha1(text) as content_hash from {documents} where text is not null"
F_SQL = "(select doc_id, concat('/lib/', source, '/', doc_id, '.txt') as path, sha1(text) as content_hash from documents where text is not null)"


@query(f"""with f as {F_SQL}, r as (select *, row_number() over (partition by content_hash order by path) as n from f)
select path, content_hash, case when n = 1 and content_hash not in (select content_hash from f where doc_id % 3 = 0) then 'added' else 'seen' end as state from r""")
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files against a library that has a third of them: copies of a content are added once."""
    f = view(spark, sf_dir, FILES)
    return tables.import_paths(f, f.filter("doc_id % 3 = 0"))


@query("""select o_orderkey as event, o_custkey as track_id, o_orderpriority as type from orders where o_orderkey % 2 = 0
union all select o_orderkey, -o_custkey, 'undo' from orders where o_orderkey % 3 = 0 and o_orderkey % 2 <> 0""")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    log = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("track_id"), F.col("o_orderpriority").alias("type"))
    new = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("event"), (-F.col("o_custkey")).alias("track_id"), F.lit("undo").alias("type"))
    return tables.append(log, new)


@query(f"""select track_id, title, 'old' as origin from {T} where track_id % 3 = 0 union all select track_id, upper(title), 'new' from {T} where track_id % 2 = 0 and track_id % 3 <> 0""")
def insert_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows enter where their key is free."""
    t = view(spark, sf_dir, TRACKS)
    old = t.filter("track_id % 3 = 0").select("track_id", "title", F.lit("old").alias("origin"))
    return tables.insert_or_ignore(old, t.filter("track_id % 2 = 0").select("track_id", F.upper("title").alias("title"), F.lit("new").alias("origin")), ["track_id"])


@query("""select case when text is null or length(text) < 200 then 'short' else '' end as error, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and characters that pass, and those set aside with their error."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("error", F.when(F.col("text").isNull() | (F.length("text") < 200), "short"))
    good, bad = tables.split_errors(d)
    rows = good.select(F.lit("").alias("error"), "n_chars").unionByName(bad.select("error", "n_chars"))
    return rows.groupBy("error").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment <> 'MACHINERY')")
def cascade_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is still there."""
    left = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.cascade(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), left, "o_custkey")


@query(f"select track_id, path from {T} order by track_id limit 50 offset 100")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page(view(spark, sf_dir, TRACKS).select("track_id", "path"), "track_id", 50, 100)


@query(f"""select count(*) as n, count(*) filter (bpm > 120) as fast, count(*) filter (energy is not null and energy > 0.5) as loud, count(distinct music_key) as keys, round(avg(bpm), 6) as mean_bpm from {A}""")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, ANALYSIS)
    more = a.agg(F.count_distinct("music_key").alias("keys"), F.round(F.avg("bpm"), 6).alias("mean_bpm"))
    return tables.counts(a, fast=F.col("bpm") > 120, loud=F.col("energy") > 0.5).crossJoin(F.broadcast(more))  # a row either side


@query(f"""select g.genre_id, g.name, g.level, g.genre_id in (select genre_id from {S} where status = 'confirmed') as has_centroid from {G} g join (select distinct genre_id from {S}) using (genre_id) where g.level = 'subgenre' and lower(g.name) like '%1%'""")
def genre_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subgenres in use by part of the name, and whether they have a confirmed example."""
    used = view(spark, sf_dir, ASSIGNMENTS)
    g = view(spark, sf_dir, GENRES).join(used.select("genre_id").distinct(), "genre_id", "left_semi")
    return taxonomy.listing(g, used.filter("status = 'confirmed'"), "subgenre", "1")


@query(f"""with e as (select distinct src, dst from ({EDGES_SQL}) where rel = 'subgenre'), n as (select src as name from e union select dst from e)
select name, array_to_string(list_sort((select coalesce(list(dst), []) from e where src = name)), ',') as parents, array_to_string(list_sort((select coalesce(list(src), []) from e where dst = name)), ',') as children from n""")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taxonomy.neighbours(view(spark, sf_dir, EDGES))
    return found.select("name", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query("""with g as (select c_custkey as genre_id, concat(case when c_custkey % 2 = 0 then 'name ' else 'Name ' end, c_custkey % 3) as name, c_custkey // 4 as parent_id from customer)
select c.genre_id, c.parent_id from g c join g p on p.genre_id = c.parent_id where lower(c.name) = lower(p.name)""")
def named_like_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select cast(c_custkey as bigint) as genre_id, concat(case when c_custkey % 2 = 0 then 'name ' else 'Name ' end, cast(c_custkey % 3 as string)) as name, cast(floor(c_custkey / 4.0) as bigint) as parent_id from {customer}"
    return taxonomy.named_like_parent(view(spark, sf_dir, text))


@query("""with n as (select lower(trim(o_orderpriority)) || o_custkey % 50 as name, o_custkey % 7 as genre_id, count(*) as n from orders group by all), r as (select *, row_number() over (partition by name order by n desc, genre_id) as k from n) select name, genre_id from r where k = 1""")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit(" "), F.upper(F.trim("o_orderpriority")), (F.col("o_custkey") % 50).cast("string"))
    return taxonomy.canonical_ids(o.select(name.alias("name"), (F.col("o_custkey") % 7).alias("genre_id")))


_PLAYLISTS = "(select concat('Mix: ', c_mktsegment, '/', c_nationkey) as playlist, c_custkey as track_id, concat('/lib/a/', c_name, '.mp3') as path, c_acctbal as position from customer)"


@query(f"""with r as (select *, row_number() over (partition by playlist order by position) as n from {_PLAYLISTS})
select playlist, track_id, concat('/lists/', regexp_replace(playlist, '[^\\w\\- ]+', '', 'g'), '/', case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end, ' - ', split_part(path, '/', 4)) as dest from r""")
def playlist_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.concat(F.lit("Mix: "), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))
    rows = c.select(name.alias("playlist"), F.col("c_custkey").alias("track_id"), F.concat(F.lit("/lib/a/"), "c_name", F.lit(".mp3")).alias("path"), F.col("c_acctbal").alias("position"))
    return organise.playlist_plan(rows, "/lists")


_MEMBERS = "select o_custkey % 200 as cluster, nullif(o_orderpriority, '5-LOW') as major, case when o_orderkey % 3 = 0 then o_orderpriority else concat(o_orderpriority, ' ', o_orderkey % 4) end as genre from orders"


@query(f"""with m as ({_MEMBERS}), a as (select cluster, major, count(*) as n from m where major is not null group by all), j as (select * from (select *, row_number() over (partition by cluster order by n desc, major) as k from a) where k = 1),
g as (select m.cluster, m.genre, count(*) as n from m join j using (cluster, major) where genre <> major group by all), t as (select * from (select *, row_number() over (partition by cluster order by n desc, genre) as k from g) where k = 1)
select j.cluster, j.major, coalesce(t.genre, '') as genre from j left join t using (cluster)""")
def vote_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    genre = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat_ws(" ", "o_orderpriority", (F.col("o_orderkey") % 4).cast("string")))
    rows = o.select((F.col("o_custkey") % 200).alias("cluster"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("major"), genre.alias("genre"))
    return organise.vote_names(rows).withColumn("genre", F.coalesce("genre", F.lit("")))


@query("select c_custkey as cluster, concat(c_mktsegment, ' ', row_number() over (partition by c_mktsegment order by c_custkey * 7919 % 10007, c_custkey)) as name from customer")
def running_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return organise.running_names(c.select(F.col("c_custkey").alias("cluster"), F.col("c_mktsegment").alias("major"), (F.col("c_custkey") * 7919 % 10007).alias("first_track")))


_LENGTHS = "(select p_partkey as track_id, (p_partkey * 37 % 9000) / 10.0 as duration from part)"


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "select p_partkey as track_id, cast(p_partkey * 37 % 9000 as double) / 10 as duration from {part}")


@query(f"""with t as (select *, greatest(1, ceil(duration / 10)::int) as n from {_LENGTHS} where duration > 0), w as (select track_id, duration, n, i, case when n <= 24 then i else round(i * (n - 1) / 23.0)::int end as pick from t, range(0, 24) r(i) where i < least(n, 24))
select track_id, i as nth, round(greatest(0.0, least(pick * 10.0, duration - 10)), 6)::double as start, round(greatest(0.0, least(pick * 10.0, duration - 10)) + 10, 6)::double as "end" from w""")
def windows_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.even_windows(lengths(spark, sf_dir), 10.0)


@query(f"""with t as (select *, least(120, greatest(1, floor((duration - 4) / 5)::int + 1)) as n from {_LENGTHS} where duration > 0) select track_id, i as nth, (i * 5.0)::double as start, least(i * 5.0 + 10, duration)::double as "end" from t, range(0, 120) r(i) where i < n""")
def windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.windows(lengths(spark, sf_dir), 10.0, 5.0).withColumn("nth", F.col("nth").cast("long"))


@query(f"""select track_id, i as nth, round(duration * p, 6)::double as start, round(duration * p + 30, 6)::double as "end" from {_LENGTHS}, (values (0, 0.15), (1, 0.425), (2, 0.7)) v(i, p) where duration > 0""")
def windows_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.excerpts(lengths(spark, sf_dir)).withColumn("nth", F.col("nth").cast("int"))


@query("""with p as (select vec_id as track_id, i, abs(embedding[i]::double) as p from embeddings, range(1, 65) r(i) where embedding is not null), r as (select *, row_number() over (partition by track_id order by p desc, i) as n from p where p >= 0.08)
select track_id, n as nth, concat('class_', i - 1) as tag, round(p, 3) as p from r where n <= 10""")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest classes of each track, absolute components taken as probabilities."""
    t = tracks(spark, sf_dir).filter("vector is not null")
    found = music.top_tags(F.transform("vector", F.abs), F.array(*[F.lit(f"class_{i}") for i in range(64)]))
    return t.select(F.col("item_id").alias("track_id"), F.posexplode(found).alias("nth", "t")).select("track_id", (F.col("nth") + 1).cast("long").alias("nth"), "t.tag", "t.p")


@query("""with x as (select label::bigint as genre_id, i, max(embedding[i]::double) as m from embeddings, range(1, 65) r(i) where embedding is not null group by all) select genre_id, i as position, round(m, 6) as value from x""")
def elementwise_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value at each position of a genre's vectors."""
    found = classify.elementwise_max(tracks(spark, sf_dir), "genre_id")
    return found.select("genre_id", F.posexplode("vector").alias("i", "m")).select("genre_id", (F.col("i") + 1).cast("long").alias("position"), F.round("m", 6).alias("value"))


@query("""with w as (select vec_id % 100 as track_id, vec_id % 3 as layer, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) where embedding is not null group by all)
select track_id, i as position, round(sum(m * [1.0, 2.0, 0.5][layer + 1]) / sum([1.0, 2.0, 0.5][layer + 1]), 6)::double as value from w group by track_id, i""")
def layer_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors taken as time steps of three layers of a hundred tracks: means over time, weighted means over layers."""
    states = tracks(spark, sf_dir).select((F.col("item_id") % 100).alias("track_id"), (F.col("item_id") % 3).alias("layer"), "vector")
    found = classify.layer_pool(states, [1.0, 2.0, 0.5])
    return found.select("track_id", F.posexplode("vector").alias("i", "x")).select("track_id", (F.col("i") + 1).cast("long").alias("position"), F.round("x", 6).alias("value"))


@query("""with u as (select vec_id, embedding[i]::double as x, i from embeddings, range(1, 65) r(i) where embedding is not null), c as (select vec_id // 10 as query_id, i, avg(x) as x from u group by all),
d as (select c.query_id, u.vec_id as item_id, sum(c.x * u.x) / nullif(sqrt(sum(c.x * c.x)) * sqrt(sum(u.x * u.x)), 0) as s from c join u using (i) where c.query_id % 10 = 0 and u.vec_id <> c.query_id group by all),
r as (select query_id, item_id, round(coalesce(s, 0), 6) as score, row_number() over (partition by query_id order by round(coalesce(s, 0), 6) desc, item_id) as rank from d) select query_id, item_id, score, rank from r where rank <= 5""")
def identify_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of ten windows each, pooled, and the tracks nearest to them."""
    t = tracks(spark, sf_dir).filter("vector is not null")
    windows = t.select(F.floor(F.col("item_id") / 10).alias("query_id"), "vector").filter("query_id % 10 = 0")
    return classify.identified(windows, t.select("item_id", "vector"), 5).select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""with s as (select p_partkey as track_id, 100 + p_partkey % 25 as genre_id, (p_partkey % 100) / 100.0 as confidence from part), f as (select * from s where track_id not in (select track_id from {S} where status = 'confirmed'))
select track_id, genre_id, confidence::double as confidence, 'suggested' as status from f union all select track_id, genre_id, confidence, status from {S} where track_id not in (select track_id from f)""")
def persisted_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select p_partkey as track_id, cast(100 + p_partkey % 25 + r as bigint) as genre_id, cast(p_partkey % 100 as double) / 100 - r as confidence, r as rank from {part} lateral view explode(array(0, 1)) as r"
    return classify.persisted(view(spark, sf_dir, text), view(spark, sf_dir, ASSIGNMENTS))


@query(f"""select track_id, [coalesce(energy, 0.5), coalesce(danceability, 0.5), coalesce(least(1.0, bpm / 200), 0.6)][1] as energy, round(least(1.0, bpm / 200), 6)::double as tempo from {A}""")
def meta_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fv.meta_vector(F.col("energy"), F.col("danceability"), F.col("bpm"))
    return view(spark, sf_dir, ANALYSIS).select("track_id", F.get(v, F.lit(0)).alias("energy"), F.round(F.get(v, F.lit(2)), 6).alias("tempo"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then greatest(1, round((o_custkey % 9 + 1) * 60 / 3.7)::int) when 1 then greatest(1, round((o_custkey % 90 + 5) / 3.7)::int) when 2 then greatest(1, round((1.5 * 60 + 20) / 3.7)::int) else 12 end as tracks from orders""")
def duration_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks fill the time that a sentence names."""
    text = """select o_orderkey, case o_orderkey % 4 when 0 then concat('a set of ', cast(o_custkey % 9 + 1 as string), ' hours') when 1 then concat(cast(o_custkey % 90 + 5 as string), ' minutes please') when 2 then '1.5 hours and 20 minutes' else 'as you like' end as low from {orders}"""
    rows = spark.sql(text, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return rows.select("o_orderkey", requests.duration_tracks(F.col("low"), F.lit(3.7)).alias("tracks"))


@query("""select o_orderkey, case o_orderkey % 5 when 0 then 'subgenre' when 1 then 'fusion' when 2 then 'influence' when 3 then 'related' else lower(o_orderpriority) end as rel from orders""")
def relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select o_orderkey, case o_orderkey % 5 when 0 then 'is Subgenre of' when 1 then 'Fusion genre' when 2 then 'was influenced by' when 3 then '' else o_orderpriority end as name from {orders}"
    return spark.sql(text, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).select("o_orderkey", music.relation(F.col("name")).alias("rel"))


_HITS = "select o_orderkey, o_orderkey % 10 / cast(10 as double) as a, o_custkey % 10 / cast(10 as double) as b from {orders}"


@query("""select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then -1.0 when o_orderkey % 3 = 0 then (o_custkey % 10) / 10.0 when o_orderkey % 2 = 0 then (o_orderkey % 10) / 10.0 else greatest((o_orderkey % 10) / 10.0, (o_custkey % 10) / 10.0) end::double as score from orders""")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score among matches that carry a recording; -1 where none does."""
    rows = spark.sql(_HITS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    has = lambda c: F.when(c, F.array(F.lit("rec"))).otherwise(F.array().cast("array<string>"))
    one = lambda s, c: F.struct(F.col(s).alias("score"), has(c).alias("recordings"))
    found = names.best_match(F.array(one("a", F.col("o_orderkey") % 3 != 0), one("b", F.col("o_orderkey") % 2 != 0)))
    return rows.select("o_orderkey", F.coalesce(found["score"], F.lit(-1.0)).alias("score"))


@query(f"""with w as (select lower(name) as name from {R} union select lower(title) from {T}) select name from w""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of genres and tracks, each once."""
    a, b = view(spark, sf_dir, TREE.replace("{text}", "string")), view(spark, sf_dir, TRACKS)
    return a.select(F.lower("name").alias("name")).union(b.select(F.lower("title"))).distinct()


@query("""with g as (select case when p_partkey % 3 = 0 then 'Deep House' else p_type end as g from part) select avg(case when g = 'Deep House' then 1.0 else 0.0 end)::double as share, avg(case when g = 'Deep House' then 1.0 else 0.0 end) >= 0.6 as is_family from g""")
def family_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "select p_partkey as track_id, array(case when p_partkey % 3 = 0 then 'Deep House' else p_type end) as genres from {part}")
    return metadata.family_share(rows, ["house"])


@query("""select c_custkey as artist_id, case c_custkey % 3 when 0 then c_name when 1 then c_mktsegment else '' end as region from customer""")
def artist_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an artist began, else where they are."""
    text = "select c_custkey as artist_id, case c_custkey % 3 when 0 then c_name end as begin_area, case c_custkey % 3 when 2 then null else c_mktsegment end as area from {customer}"
    return view(spark, sf_dir, text).select("artist_id", F.coalesce(metadata.artist_region(F.col("begin_area"), F.col("area")), F.lit("")).alias("region"))


@query(f"""select track_id, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') as stem from {T}""")
def path_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRACKS).select("track_id", music.stem(F.col("path")).alias("stem"))
