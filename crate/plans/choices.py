"""Registered queries on merges in passes, attribute search, views of records, pools for sets, genres by example and artists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.functions import music
from crate.operators import classify, metadata, taxonomy, understanding, walks
from crate.plans.library import A, ANALYSIS, view
from crate.plans.records import CLASSES, RECORD, tags
from crate.plans.vectors import tracks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).filter("vector is not null").select(F.col("item_id").alias("track_id"), "vector", "genre_id")


@query()
def merge_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate genres of a tree that grows with the customers, merged in all three passes, weighed by orders and examples."""
    text = "select cast(c_custkey as bigint) as genre_id, concat(' Name ', cast(c_custkey % 40 as string)) as name, cast(nullif(cast(floor(c_custkey / 6.0) as bigint), 0) as bigint) as parent_id, case when c_custkey < 6 then 'genre' else 'subgenre' end as level from {customer}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("genre_id"), F.col("o_orderkey").alias("track_id"))
    return taxonomy.merge_all(view(spark, sf_dir, text), orders, orders.filter("track_id % 5 = 0"))[1]


@query("""with q(query_id, label, k) as (values (1, 'Cowbell', 10), (2, 'Piano', 2)), e as (select vec_id, embedding::DOUBLE[] as e from embeddings where embedding is not null),
a as (select query_id, 'tags' as method, label, vec_id as track_id, round(abs(e[k]), 6) as score from e, q),
u as (select vec_id, vec_id // 3 + 3 as query_id, list_transform(e, lambda y: y) as v from e where vec_id < 6), m as (select query_id, i, avg(v[i]) as x from u, range(1, 65) r(i) group by all),
d as (select query_id, vec_id as track_id, sum(x * e[i]) / (sqrt(sum(x * x)) * sqrt(sum(e[i] * e[i]))) as c from m, e group by all),
z as (select query_id, 'text', '', track_id, round((c - avg(c) over (partition by query_id)) / stddev_pop(c) over (partition by query_id), 6) from d),
r as (select *, row_number() over (partition by query_id order by score desc, track_id) as rank from (select * from a union all select * from z)) select query_id, method, label, track_id, score, rank from r where rank <= 20""")
def search_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four searches over all tracks: two name a class, two are sought by the mean of three prompts' vectors."""
    q = spark.sql("select * from values (1, 'cowbells'), (2, 'piano'), (3, 'dusty'), (4, 'wobbly') as t(query_id, text)")
    t = _vectors(spark, sf_dir)
    prompts = t.filter("track_id < 6").select(F.floor(F.col("track_id") / 3 + 3).cast("int").alias("query_id"), "vector")
    found = understanding.search(q, tags(spark, sf_dir), CLASSES, prompts, t.select("track_id", "vector"), 20)
    return found.select("query_id", "method", F.coalesce("label", F.lit("")).alias("label"), "track_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""with {RECORD}, t as (select track_id, count(*) as n from (select track_id, unnest(p) as x from g) where x >= 0.08 group by 1)
select w.track_id, kind, least(coalesce(n, 0), 10) as n_tags, case when w.track_id % 4 = 0 then 'en' else '' end as language, w.track_id % 2 = 0 and w.track_id <> 6 as deep_done from w left join t using (track_id)""")
def understanding_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their top tags and what a deeper pass has stored."""
    stored = tracks(spark, sf_dir).filter("item_id % 2 = 0 and item_id <> 6").select(F.col("item_id").alias("track_id"), F.when(F.col("item_id") % 4 == 0, "en").otherwise("").alias("language"), F.lit(0.9).alias("language_conf"), F.lit(True).alias("deep_done"))
    v = understanding.view_of(tags(spark, sf_dir), view(spark, sf_dir, ANALYSIS), CLASSES, stored)
    return v.select("track_id", F.col("vocal.kind").alias("kind"), F.size("top_tags").cast("long").alias("n_tags"), F.coalesce("language", F.lit("")).alias("language"), "deep_done")


@query("""select p_partkey as track_id, case when p_partkey % 3 = 0 then p_brand when c_custkey is null then '' else concat_ws(',', c_mktsegment, 'x') end as genres, case when p_partkey % 4 = 0 then 'DE' else coalesce(c_nationkey::varchar, '') end as area
from part left join customer on c_custkey = p_partkey % 700""")
def artist_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres and areas of recordings, those of their artists where there are none."""
    r = view(spark, sf_dir, "select p_partkey as track_id, p_partkey % 700 as artist_id, case p_partkey % 3 when 0 then array(p_brand, p_brand) when 1 then array() end as genres, case when p_partkey % 4 = 0 then 'DE' end as area from {part}")
    a = view(spark, sf_dir, "select c_custkey as artist_id, array(c_mktsegment, 'x') as genres, cast(c_nationkey as string) as area from {customer}")
    found = metadata.with_artists(r, a)
    return found.select("track_id", F.concat_ws(",", "genres").alias("genres"), F.coalesce("area", F.lit("")).alias("area"))


_RANGES = ", ".join(f"({i}, '{word}', {lo}, {hi})" for i, (word, (lo, hi)) in enumerate(music.GROUPING_TEMPO.items()))


@query(f"""with k(i, word, lo, hi) as (values {_RANGES}), t as (select track_id, bpm, concat(case track_id % 4 when 0 then 'Minimal ' when 1 then 'UK ' when 2 then 'Afro ' else '' end, case track_id % 5 when 0 then 'Techno' when 1 then 'Garage' when 2 then 'House' when 3 then 'Polka' else 'Hardcore' end) as genre from {A}),
m as (select track_id, genre, bpm, min_by(lo, i) as lo, min_by(hi, i) as hi from t left join k on contains(lower(genre), word) group by all)
select track_id, genre, lo is null or bpm between lo - 4 and hi + 4 or bpm / 2 between lo - 4 and hi + 4 or bpm * 2 between lo - 4 and hi + 4 as fits from m""")
def grouping_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a track's tempo suits a genre by the table that automatic grouping goes by."""
    n = F.col("track_id")
    kind = F.when(n % 4 == 0, "Minimal ").when(n % 4 == 1, "UK ").when(n % 4 == 2, "Afro ").otherwise("")
    base = F.when(n % 5 == 0, "Techno").when(n % 5 == 1, "Garage").when(n % 5 == 2, "House").when(n % 5 == 3, "Polka").otherwise("Hardcore")
    t = view(spark, sf_dir, ANALYSIS).withColumn("genre", F.concat(kind, base))
    return t.select("track_id", "genre", music.tempo_plausible(F.col("genre"), F.col("bpm"), music.GROUPING_TEMPO).alias("fits"))


@query(f"""with c as (select r_regionkey as request_id, track_id, case track_id % 11 when 0 then 'Deep House' when 1 then 'Techno' else '' end as genre, energy, case r_regionkey when 0 then 'house' when 1 then 'techno' when 2 then 'polka' else '' end as wish from {A}, region),
i as (select *, wish <> '' and contains(genre.lower(), wish) as fits from c), n as (select *, count(*) filter (fits) over (partition by request_id) >= 20 as enough from i), k as (select * from n where fits or not enough),
o as (select *, row_number() over (partition by request_id order by energy, track_id) - 1 as i, count(*) over (partition by request_id) as m from k)
select request_id, track_id from o where m <= 80 or i in (select round_even(j * (o.m - 1) / 79.0, 0)::bigint from range(0, 80) r(j))""")
def set_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighty tracks for each of five wishes, evenly along energy, of the genre where enough are."""
    wish = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("request_id"), F.when(F.col("r_regionkey") == 0, F.array(F.lit("House"))).when(F.col("r_regionkey") == 1, F.array(F.lit("techno"))).when(F.col("r_regionkey") == 2, F.array(F.lit("polka"))).otherwise(F.array().cast("array<string>")).alias("genres"), F.lit(10).alias("want"))
    n = F.col("track_id") % 11
    t = view(spark, sf_dir, ANALYSIS).select("track_id", "energy", F.when(n == 0, "Deep House").when(n == 1, "Techno").otherwise("").alias("genre"))
    rows = t.withColumn("request_id", F.explode(F.array(*[F.lit(i) for i in range(5)])))  # a copy for each of the five
    return walks.set_pool(rows, wish).select(F.col("request_id").cast(wish.schema["request_id"].dataType).alias("request_id"), "track_id")


@query("""with w as (select concat('mine ', vec_id % 50) as name, case when vec_id % 50 < 10 then 1 end as parent_id, vec_id from embeddings where embedding is not null and label is not null and vec_id % 2 = 0),
g as (select label::bigint as genre_id, concat('mine ', label * 10 + 5) as name, null as parent_id from embeddings where label is not null group by all),
s as (select w.name, w.parent_id, min(g.genre_id) as old from w left join g on g.name = w.name and w.parent_id is null group by w.name, w.parent_id),
i as (select name, coalesce(old, (select max(genre_id) from g) + row_number() over (partition by old is null order by name)) as genre_id from s),
x as (select genre_id, vec_id from i join w using (name) union select label, vec_id from embeddings where label is not null and vec_id % 9 = 0)
select genre_id, count(*) as examples, coalesce((select max(i.name) from i where i.genre_id = x.genre_id), '') as name from x group by genre_id""")
def genres_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examples genres have once some were made of examples; names of those made or taught."""
    t = _vectors(spark, sf_dir).filter("genre_id is not null")
    even = t.filter("track_id % 2 = 0")
    k = F.col("track_id") % 50
    wanted = even.select(F.concat(F.lit("mine "), k.cast("string")).alias("name"), F.when(k < 10, F.lit(1)).cast("long").alias("parent_id"), F.lit("subgenre").alias("level"), "track_id")
    genres = t.select("genre_id").distinct().select("genre_id", F.concat(F.lit("mine "), (F.col("genre_id") * 10 + 5).cast("string")).alias("name"), F.lit(None).cast("long").alias("parent_id"), F.lit("genre").alias("level"))
    old = t.filter("track_id % 9 = 0").select("genre_id", "track_id")
    after, taught, _ = classify.by_example(wanted, genres, old, classify.mean_vectors(t.join(old.select("track_id"), "track_id", "left_semi"), "genre_id"), t.select("track_id", "vector"))
    named = wanted.select("name").distinct().join(after.select("name", "genre_id"), "name").select("genre_id", "name")
    return taught.groupBy("genre_id").agg(F.count("*").alias("examples")).join(named, "genre_id", "left").select("genre_id", "examples", F.coalesce("name", F.lit("")).alias("name"))
