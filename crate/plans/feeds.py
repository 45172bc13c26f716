"""Registered queries on files written and read, recordings, confirmations, frames and streams of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.operators import classify, metadata, pcm, signal
from crate.plans.library import view
from crate.plans.sound import EDGES, EDGES_SQL, _streamed
from crate.plans.vectors import tracks
from crate.sources import tables, taxonomy_files
from crate.storage import saved, scratch
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


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).filter("vector is not null").select(F.col("item_id").alias("track_id"), "vector", "genre_id")


@query("""with c as (select c_custkey as k, c_mktsegment as seg from customer)
select 'node' as kind, case when k % 3 = 0 or k % 2 = 1 then concat('Genre ', k) else concat('genre ', k) end as a, case when k % 2 = 0 then seg else concat('deep ', k) end as b from c
union all select 'edge', concat('Genre ', k // 10), concat('genre ', k) from c where k % 2 = 0 and k > 0 union all select 'edge', concat('Genre ', k), concat('Genre ', k + 1000000) from c""")
def json_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy of the customers in three tiers of JSON files, written and read: nodes with descriptions, edges."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"), "c_mktsegment")
    none, number = F.array().cast("array<string>"), F.col("k").cast("string")
    upper, lower = F.concat(F.lit("Genre "), number), F.concat(F.lit("genre "), number)
    above = F.array(F.concat(F.lit("Genre "), F.floor(F.col("k") / 10).cast("string")))
    below = F.array(F.concat(F.lit("Genre "), (F.col("k") + 1_000_000).cast("string")))
    index = c.filter("k % 3 = 0").select("k", upper.alias("name"), F.lit("").alias("description"), none.alias("parents"), none.alias("children"))
    main = c.filter("k % 2 = 0").select("k", lower.alias("name"), F.col("c_mktsegment").alias("description"), above.alias("parents"), none.alias("children"))
    detailed = c.select("k", upper.alias("name"), F.concat(F.lit("deep "), number).alias("description"), F.array(lower).alias("parents"), below.alias("children"))
    base = scratch(spark, "tiers")
    for name, tier in (("index", index), ("main", main), ("detailed", detailed)):
        taxonomy_files.write_tier(tier, f"{base}/{name}", F.col("k"))
    nodes, edges = taxonomy_files.read_tiers(spark, f"{base}/index", f"{base}/main", f"{base}/detailed")
    return nodes.select(F.lit("node").alias("kind"), F.col("name").alias("a"), F.col("description").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("parent").alias("a"), F.col("child").alias("b")))


@query("""select distinct lower(b.c_name) as src, lower(a.c_name) as dst, case o_orderkey % 5 when 0 then 'subgenre' when 1 then 'fusion' when 2 then 'influence' else 'other' end as rel
from orders join customer a on a.c_custkey = o_custkey join customer b on b.c_custkey = o_custkey // 2 + 1 where o_orderkey % 5 <> 4""")
def dump_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables of a dump, written tab-separated and read by place: links between genres; those to artists are left out."""
    base = scratch(spark, "dump")
    kinds = "select r_regionkey as id, 'genre' as e0, case when r_regionkey = 4 then 'artist' else 'genre' end as e1, case r_regionkey when 0 then 'is Subgenre of' when 1 then 'Fusion genre' when 2 then 'was influenced by' else 'Other' end as name from {region}"
    tables.write_dump(view(spark, sf_dir, "select c_custkey as id, c_name as name from {customer}"), f"{base}/genre")
    tables.write_dump(view(spark, sf_dir, kinds), f"{base}/link_type")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tables.write_dump(o.select("o_orderkey", (F.col("o_orderkey") % 5).alias("type")), f"{base}/link")
    tables.write_dump(o.select("o_orderkey", "o_custkey", F.expr("o_custkey div 2 + 1")), f"{base}/ends")
    read = lambda name, columns: tables.read_dump(spark, f"{base}/{name}", columns)
    return metadata.graph_of_dump(read("genre", "id long, name string"), read("link_type", "id long, e0 string, e1 string, name string"), read("link", "id long, type_id long"), read("ends", "link_id long, from_id long, to_id long"))


@query(f"""with e as ({EDGES_SQL}), n as (select src as name from e union select dst from e) select name, count(e.dst) as n_out from n left join e on e.src = n.name group by name""")
def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges go out of each node of a graph that was written and read again."""
    e, path = view(spark, sf_dir, EDGES), scratch(spark, "graph")
    taxonomy_files.write_graph(e.select(F.col("src").alias("name")).union(e.select("dst")).distinct(), e, path)
    nodes, edges = taxonomy_files.read_graph(spark, path)
    return nodes.join(edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n_out"))


@query("select vec_id as track_id, round(embedding[1]::double, 6) as first from embeddings where embedding is not null and vec_id % 3 = 1")
def one_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of three embedding spaces that lie in a folder each; readers of one read only its files."""
    path = scratch(spark, "space")
    tables.write_space(_vectors(spark, sf_dir).select("track_id", F.concat(F.lit("m"), (F.col("track_id") % 3).cast("string")).alias("model"), "vector"), path)
    return tables.read_space(spark, path, "m1").select("track_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"))


@query("""with p as (select p_partkey as k, p_name, p_brand, p_type from part) select k as track_id, concat('r', k) as mbid, p_name as title, case when k % 4 = 0 then '' else p_brand end as artist,
case when k % 11 = 0 then -1 else 1950 + k % 70 end as year, concat('deep house,', lower(p_type)) as genres, case when k % 3 = 0 then p_type else 'DE' end as area from p""")
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records of recordings' JSON: own and group genres, year, first artist, country or the first event's area."""
    text = """select p_partkey as track_id, to_json(named_struct('id', concat('r', p_partkey), 'title', p_name, 'first-release-date', if(p_partkey % 11 = 0, '', concat(1950 + p_partkey % 70, '-01-02')),
'genres', array(named_struct('name', 'Deep House', 'count', 2), named_struct('name', 'deep house', 'count', 1)), 'artist-credit', if(p_partkey % 4 = 0, cast(array() as array<struct<name:string>>), array(named_struct('name', p_brand))),
'releases', array(named_struct('country', if(p_partkey % 3 = 0, null, 'DE'), 'release-events', array(named_struct('area', named_struct('name', p_type))), 'release-group', named_struct('genres', array(named_struct('name', p_type, 'count', 1))))))) as js from {part}"""
    r = view(spark, sf_dir, text).select("track_id", metadata.flat_recording(F.col("js")).alias("r"))
    return r.select("track_id", "r.mbid", "r.title", F.coalesce("r.artist", F.lit("")).alias("artist"), F.coalesce("r.year", F.lit(-1)).cast("long").alias("year"), F.concat_ws(",", "r.genres").alias("genres"), "r.area")


@query("""with p as (select o_custkey as request_id, o_orderkey as place, o_orderkey % 40 as track_id, repeat(o_orderpriority, 30) as reason from orders where o_orderkey % 40 in (select p_partkey from part where p_partkey % 2 = 0)),
k as (select *, row_number() over (partition by request_id, track_id order by place) as n from p) select request_id, row_number() over (partition by request_id order by place) as position, track_id, left(reason, 140) as reason from k where n = 1""")
def play_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed orders of play, one a customer: unknown and repeated tracks go, reasons are cut."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    proposed = o.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("position"), (F.col("o_orderkey") % 40).alias("track_id"), F.repeat("o_orderpriority", F.lit(30)).alias("reason"))
    found = metadata.accepted_order(proposed, view(spark, sf_dir, "select p_partkey as track_id from {part} where p_partkey % 2 = 0"))
    return found.withColumn("position", F.col("position").cast("long"))


@query("""with e as (select vec_id, label::bigint as label, embedding::DOUBLE[] as v from embeddings where embedding is not null and label is not null), c as (select vec_id, label + 1 as genre_id from e where vec_id % 7 = 0 and label < 5),
x as (select label as genre_id, vec_id from e where vec_id % 5 = 0 union select genre_id, vec_id from c), m as (select x.genre_id, i, avg(v[i]) as m from x join e using (vec_id), range(1, 65) r(i) group by all),
d as (select genre_id, round(max(m) filter (i = 1) / sqrt(sum(m * m)), 6) as first from m group by 1), a as (select coalesce(c.genre_id, e.label) as genre_id, count(*) as n, count(c.genre_id) as manual from e left join c using (vec_id) group by 1)
select genre_id, n, manual, (select count(*) from x where x.genre_id = d.genre_id) as examples, first from d join a using (genre_id)""")
def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres after a batch of confirmations: assignments, those by hand, examples, and where the centroid has come to."""
    t = _vectors(spark, sf_dir).filter("genre_id is not null")
    auto = t.select("track_id", "genre_id", F.lit(0.5).alias("confidence"), F.lit("centroid").alias("method"), F.lit("suggested").alias("status"))
    old = t.filter("track_id % 5 = 0")
    now = t.filter("track_id % 7 = 0 and genre_id < 5").select("track_id", (F.col("genre_id") + 1).alias("genre_id"))
    decided, taught, centroids = classify.confirm(now, auto, old.select("genre_id", "track_id"), classify.mean_vectors(old, "genre_id"), t.select("track_id", "vector"))
    n = decided.groupBy("genre_id").agg(F.count("*").alias("n"), F.count_if(F.col("method") == "manual").alias("manual"))
    examples = taught.groupBy("genre_id").agg(F.count("*").alias("examples"))
    return n.join(examples, "genre_id").join(centroids.select("genre_id", F.round(F.get("vector", F.lit(0)), 6).alias("first")), "genre_id")


@query("""with e as (select vec_id, embedding::DOUBLE[] as v from embeddings where embedding is not null), s as (select vec_id, v, concat('sound ', vec_id) as name from e where vec_id % 50 = 0),
d as (select s.name, e.vec_id // 3 as track_id, max(round(list_sum(list_transform(range(1, 65), lambda i: s.v[i] * e.v[i])) / sqrt(list_sum(list_transform(s.v, lambda y: y * y))) / sqrt(list_sum(list_transform(e.v, lambda y: y * y))), 6)) as score from s, e group by all)
select name, track_id from (select name, track_id, row_number() over (partition by name order by score desc, track_id) as n from d) where n <= 8 union select name, vec_id // 3 from s""")
def genres_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres made of marked sounds: each has the sound's own track and the eight tracks with the most similar windows."""
    w = _vectors(spark, sf_dir).select(F.expr("track_id div 3").alias("track_id"), "vector", F.col("track_id").alias("window_id"))
    named = F.concat(F.lit("sound "), F.col("window_id").cast("string"))
    segments = w.filter("window_id % 50 = 0").select("track_id", named.alias("name"), F.lit(None).cast("long").alias("parent_id"), F.lit("subgenre").alias("level"), "vector")
    none = spark.createDataFrame([], "genre_id long, name string, parent_id long, level string, track_id long, vector array<double>")
    after, taught, _ = classify.by_segment(segments, w, none.select("genre_id", "name", "parent_id", "level"), none.select("genre_id", "track_id"), none.select("genre_id", "vector"), classify.mean_vectors(w, "track_id"))
    return taught.join(after.select("genre_id", "name"), "genre_id").select("name", "track_id")


@query("""with e as (select vec_id as track_id, embedding::DOUBLE[] as x from embeddings where embedding is not null),
c as (select track_id, f, k, x[f * 16 + n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / 31)) as y, 2 * pi() * k * n / 32 as a from e, range(0, 3) f(f), range(0, 17) k(k), range(0, 32) n(n))
select track_id, f as frame_idx, k as bin, round(sqrt(pow(sum(y * cos(a)), 2) + pow(sum(y * sin(a)), 2)), 5) as mag from c group by all""")
def stft_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of windowed frames of 32 samples, 16 apart; vectors stand for samples."""
    f = signal.stft(_vectors(spark, sf_dir).select("track_id", F.col("vector").alias("samples")), 32, 16)
    return f.select("track_id", "frame_idx", F.posexplode("mag").alias("bin", "mag")).select("track_id", "frame_idx", F.col("bin").cast("long").alias("bin"), F.round("mag", 5).alias("mag"))


#: Tracks of five vectors' values each, with silence where one is missing, in frames of 32 values, 16 apart.
PIECED = """p as (select vec_id // 5 as track_id, (vec_id % 5) * 64 as start, embedding::DOUBLE[] as e from embeddings where embedding is not null), l as (select track_id, max(start) + 64 as size from p group by all),
x as (select track_id, start + i as pos, e[i + 1] as v from p, range(0, 64) r(i)), f as (select track_id, f, f * 16 + n as pos, n from l, range(0, 19) f(f), range(0, 32) n(n) where f * 16 + 32 <= size),
y as (select f.track_id, f, n, coalesce(v, 0.0) as v from f left join x on x.track_id = f.track_id and x.pos = f.pos),
c as (select track_id, f, k, v * (0.5 - 0.5 * cos(2 * pi() * n / 31)) as y, 2 * pi() * k * n / 32 as a from y, range(0, 17) k(k)),
m as (select track_id, f, k, sqrt(pow(sum(y * cos(a)), 2) + pow(sum(y * sin(a)), 2)) as mag from c group by all)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pieces of tracks, each cut in two once more."""
    start = F.expr("(track_id % 5) * 64")
    v = _vectors(spark, sf_dir).select(F.expr("track_id div 5").alias("track_id"), start.alias("offset"), "vector")
    halves = F.inline(F.array(*[F.struct((F.col("offset") + a).alias("offset"), F.slice("vector", a + 1, n).alias("samples")) for a, n in ((0, 23), (23, 41))]))
    return v.select("track_id", halves)


@query(f"with {PIECED} select track_id, f as frame_idx, k as bin, round(mag, 5) as mag from m")
def pieced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over the borders of pieces."""
    f = pcm.stft(_pieces(spark, sf_dir), 32, 16, 48)
    return f.select("track_id", "frame_idx", F.posexplode("mag").alias("bin", "mag")).select("track_id", "frame_idx", F.col("bin").cast("long").alias("bin"), F.round("mag", 5).alias("mag"))


@query(f"""with {PIECED}, e as (select b, least(floor(33 * 700 * (pow(10, log10(1 + 500 / 700.0) * b / 7) - 1) / 1000), 16) as edge from range(0, 8) r(b)),
t as (select a.b as b, k, least((k - a.edge) / greatest(m.edge - a.edge, 1e-9), (z.edge - k) / greatest(z.edge - m.edge, 1e-9)) as w from e a join e m on m.b = a.b + 1 join e z on z.b = a.b + 2, range(0, 17) k(k)),
mel as (select track_id, f, b, ln(1 + sum(case when w > 0 then mag * w else 0 end)) as v from m join t using (k) group by all),
q as (select *, mag + 1e-10 as p, k * 1000 / 32.0::double as hz, sum(mag + 1e-10) over (partition by track_id, f order by k) as upto, sum(mag + 1e-10) over (partition by track_id, f) as total from m),
s as (select track_id, f, sum(p * hz) / sum(p) as centre, min(hz) filter (upto >= 0.85 * total) as roll from q group by all),
d as (select q.track_id, q.f, any_value(centre) as centre, sqrt(sum(p * (hz - centre) ** 2) / sum(p)) as width, any_value(roll) as roll from q join s on s.track_id = q.track_id and s.f = q.f group by all),
r as (select track_id, f, avg((sign(v) <> sign(before))::int) filter (n > 0) as cross_rate, sqrt(avg(v * v)) as rms from (select *, lag(v) over (partition by track_id, f order by n) as before from y) group by all),
u as (select track_id, b as k, v from mel union all select track_id, 6, centre from d union all select track_id, 7, width from d union all select track_id, 8, roll from d union all select track_id, 9, cross_rate from r union all select track_id, 10, rms from r),
g as (select track_id, k, avg(v) as a, stddev_pop(v) as z from u group by all), h as (select track_id, case when k < 6 then k else 2 * k end as i, a as x from g union all select track_id, case when k < 6 then k + 6 else 2 * k + 1 end, z from g)
select track_id, i, round(x / sqrt(sum(x * x) over (partition by track_id)), 5) as x from h""")
def spectral_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of tracks in pieces, with six bands."""
    v = pcm.descriptor(_pieces(spark, sf_dir), 1000, 32, 16, 6, 48)
    return v.select("track_id", F.posexplode("vector").alias("i", "x")).select("track_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query("select distinct concat(user_id, '-', event_type) as content_hash from events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of imports: one row of each content."""
    hashed = lambda s: s.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("content_hash"), "ts")
    return _streamed(spark, sf_dir, lambda s: streams.ingest(hashed(s), delay="1000 days").select("content_hash")).filter("content_hash <> '-1--'")


@query("""with m as (select label::bigint as genre_id, i - 1 as i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) where embedding is not null and label is not null group by all)
select genre_id, i, round(m / sqrt(sum(m * m) over (partition by genre_id)), 6) as x from m""")
def stream_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of a stream of confirmations that comes a file a batch: sums of each batch are added to those of the one before."""
    rows = _vectors(spark, sf_dir).filter("genre_id is not null").select("genre_id", "vector")
    base = saved(rows.repartition(3), "confirmed").inputFiles()[0].rsplit("/", 1)[0]
    out = scratch(spark, "centroids")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(base)
    streams.keep_centroids(stream, f"{out}/sums").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    kept = streams.kept_centroids(spark, f"{out}/sums")
    return kept.select("genre_id", F.posexplode("vector").alias("i", "x")).select("genre_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _loudness():
    """A model as a job loads it: mean, root of the mean square and peak of a window."""
    import numpy as np

    def run(samples, rate):
        if rate <= 0:
            raise ValueError(f"rate {rate}")
        return np.array([samples.mean(), np.sqrt((samples * samples).mean()), np.abs(samples).max()])

    return run


_JOB_SQL = """with w as (select vec_id // 4 as track_id, vec_id as window_id, embedding::DOUBLE[] as x, case when vec_id % 50 = 7 then 0 else 8000 end as rate from embeddings where embedding is not null),
bad as (select track_id, arg_min('rate ' || rate, window_id) as error from w where rate <= 0 group by 1),
v as (select track_id, avg(list_avg(x)) as a, avg(sqrt(list_avg(list_transform(x, lambda z: z * z)))) as b, avg(list_max(list_transform(x, lambda z: abs(z)))) as c from w where track_id not in (select track_id from bad) group by 1)
select track_id, error, null as a, null as b, null as c, 0 as again from bad
union all select track_id, null, round(a / sqrt(a * a + b * b + c * c), 6), round(b / sqrt(a * a + b * b + c * c), 6), round(c / sqrt(a * a + b * b + c * c), 6), 0 from v"""


@query(_JOB_SQL)
def embedding_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of tracks of four windows each by a job in two runs, even tracks first: what each track has come to, and how many tracks a third run finds to do."""
    from crate.operators import embed

    rate = F.when(F.col("vec_id") % 50 == 7, 0).otherwise(8000)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding is not null")
    w = rows.select(F.floor(F.col("vec_id") / 4).alias("track_id"), F.col("vec_id").alias("window_id"), F.col("embedding").alias("samples"), rate.alias("rate"))
    path, model = scratch(spark, "space"), embed.register("loudness", _loudness)
    runs = [saved(embed.embed_job(rows, path, model), "run") for rows in (w.filter("track_id % 2 = 0"), w)]
    again = embed.embed_job(w, path, model).count()
    found = embed.stored(spark, f"{path}/vectors", embed.VECTORS, model.name).select("track_id", "vector")
    entry = lambda k: F.round(F.get("vector", F.lit(k)), 6)
    both = runs[0].unionByName(runs[1]).join(found, "track_id", "left")
    return both.select("track_id", "error", entry(0).alias("a"), entry(1).alias("b"), entry(2).alias("c"), F.lit(again).alias("again"))
