"""Registered queries on groups at all levels of density and on tracklists from vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crate.functions import vectors as fv
from crate.operators import classify, hierarchy, metadata, mixes, organise, signal
from crate.plans import tables as records
from crate.plans.library import view
from crate.plans.sound import _BAND_SQL, _BANDS, frames
from crate.plans.vectors import tracks
from crate.sources import stored
from crate.storage import saved, scratch
from crate.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


UNIT = "u as materialized (select vec_id, label, list_transform(embedding::DOUBLE[], lambda y: y / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda z: z * z)))) as v from embeddings where embedding is not null)"


@query(f"""with recursive {UNIT},
d as materialized (select a.vec_id as q, b.vec_id as i, round(list_sum(list_transform(range(1, 65), lambda j: a.v[j] * b.v[j])), 6) as score from u a, u b where a.vec_id <> b.vec_id),
core as materialized (select q, 1 - score as core from (select *, row_number() over (partition by q order by score desc, i) as rank from d) where rank = 4),
m as materialized (select d.q, d.i, greatest(1 - score, x.core, y.core) as w from d join core x on x.q = d.q join core y on y.q = d.i), f as (select min(vec_id) as f from u),
p as (select i as item, w as dist, 0 as step from m, f where q = f union all select s.item, least(s.dist, m.w), s.step + 1 from (select *, arg_min(item, dist) over () as pick from p) s join m on m.q = s.pick and m.i = s.item)
select round(weight, 6) as weight, count(*) as edges from (select min(dist) as weight from p group by step) group by 1""")
def spanning_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of each weight the least spanning tree of mutual reachability has: the same whichever of equal edges are taken."""
    tree = hierarchy.spanning_tree(tracks(spark, sf_dir), 5)
    return tree.groupBy(F.round("weight", 6).alias("weight")).agg(F.count("*").alias("edges"))


@query()
def steady_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each track, named by its least track, chosen at its own level of density; -1 is noise."""
    found = hierarchy.steady_groups(tracks(spark, sf_dir).filter("vector is not null"), 5)
    return found.select("item_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


RUNS = f"""with {UNIT}, w as (select vec_id % 20 as mix_id, row_number() over (partition by vec_id % 20 order by vec_id) as seq, v from u),
i as (select label as track_id, arg_min(v, vec_id) as v from u where label is not null group by 1),
s as (select mix_id, seq, track_id, round(list_sum(list_transform(range(1, 65), lambda j: w.v[j] * i.v[j])), 6) as score from w, i),
b as (select mix_id, seq, first(track_id order by score desc, track_id) as track_id, max(score) as score from s group by all having max(score) >= 0.05),
c as (select *, case when lag(track_id) over (partition by mix_id order by seq) is distinct from track_id then 1 else 0 end as new from b),
r as (select *, sum(new) over (partition by mix_id order by seq) as run from c)
select mix_id::bigint as mix_id, track_id::bigint as track_id, (1700000000 + 7 * min(seq))::bigint as first_s, (1700000015 + 7 * max(seq))::bigint as last_s, count(*) as windows, max(score) as score from r group by mix_id, run, track_id"""


def _mixes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Twenty mixes of windows seven seconds apart, fifteen long, and the first vector of each label as the library."""
    t = tracks(spark, sf_dir).filter("vector is not null")
    seq = F.row_number().over(Window.partitionBy("mix_id").orderBy("item_id"))
    windows = t.withColumn("mix_id", F.col("item_id") % 20).withColumn("window_id", seq.cast("long"))
    time = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s) + 7 * F.col("window_id"))
    windows = windows.select("mix_id", "window_id", time(0).alias("start"), time(15).alias("end"), "vector")
    return windows, t.filter("genre_id is not null").groupBy(F.col("genre_id").alias("item_id")).agg(F.min_by("vector", "item_id").alias("vector"))


def _seconds(runs: DataFrame) -> DataFrame:
    s = lambda c: F.col(c).cast("long")
    return runs.select("mix_id", "track_id", s("start").alias("first_s"), s("end").alias("last_s"), "windows", "score")


@query(RUNS)
def mix_from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes as runs of the track that their windows are most like."""
    windows, items = _mixes(spark, sf_dir)
    return _seconds(mixes.tracklist(windows, items, floor=0.05))


@query(RUNS)
def live_from_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mixes as a stream that arrives in two halves, up to 140 seconds out of order; a window a day later ends all runs."""
    windows, items = _mixes(spark, sf_dir)
    items = saved(items, "library")
    late = F.col("window_id") + F.pmod(F.xxhash64("mix_id", "window_id"), F.lit(20))
    windows = saved(windows.withColumn("half", (F.percent_rank().over(Window.partitionBy("mix_id").orderBy(late)) > 0.5).cast("int")), "windows")
    last = windows.orderBy(F.desc("start"), "mix_id").limit(1)
    day = F.expr("interval 1 day")
    last = last.select(F.lit(-1).cast("long").alias("mix_id"), "window_id", (F.col("start") + day).alias("start"), (F.col("end") + day).alias("end"), "vector")
    base, found, kept, out = (scratch(spark, name) for name in ("plays", "found", "kept", "runs"))
    runs = None
    for part in (windows.filter("half = 0").drop("half"), windows.filter("half = 1").drop("half"), last):
        part.write.mode("append").parquet(base)
        live.keep_matches(spark.readStream.schema(part.schema).parquet(base), items, found, floor=0.05 if part is not last else -1.0).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
        runs = live.written(live.matches(spark, found), out, delay="5 minutes")
    return _seconds(runs.filter("mix_id >= 0"))


@query("""with o as (select p_partkey::bigint as track_id, p_size::bigint as n, p_name as name from part), u as (select track_id, case when track_id % 7 = 0 then n + 100 else n end as n, case when track_id % 7 <> 0 then name end as name from o),
p as (select coalesce(track_id, c_custkey)::bigint as track_id, coalesce(case when c_custkey % 2 = 0 then c_custkey end, n)::bigint as n, name from u full join customer on c_custkey = track_id),
i as (select p_partkey + 5 as track_id, -1 as n, 'new' as name from part), k as (select * from p union all select * from i where track_id not in (select track_id from p))
select track_id, n, name from k where track_id % 50 <> 1 union all select p_partkey, g, 'group' from part, range(0, 2) t(g) where p_partkey % 50 = 1
union all select track_id, n, name from k where track_id % 50 = 1 and track_id not in (select p_partkey from part)""")
def bucket_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the parts stored in buckets, then an upsert, a patch, an insert of new keys only and groups replaced, each rewriting its buckets."""
    path, kind = scratch(spark, "stored"), "track_id bigint, n bigint, name string"
    shaped = lambda text: view(spark, sf_dir, text).to(spark.createDataFrame([], kind).schema)
    stored.create(shaped("select p_partkey as track_id, cast(p_size as bigint) as n, p_name as name from {part}"), path, ["track_id"], 16)
    stored.upsert(spark, path, shaped("select p_partkey as track_id, cast(p_size + 100 as bigint) as n, cast(null as string) as name from {part} where p_partkey % 7 = 0"))
    stored.patch(spark, path, shaped("select c_custkey as track_id, case when c_custkey % 2 = 0 then cast(c_custkey as bigint) end as n, cast(null as string) as name from {customer}"))
    stored.insert_or_ignore(spark, path, shaped("select p_partkey + 5 as track_id, cast(-1 as bigint) as n, 'new' as name from {part}"))
    stored.replace_group(spark, path, shaped("select p_partkey as track_id, cast(g as bigint) as n, 'group' as name from {part} lateral view explode(array(0, 1)) as g where p_partkey % 50 = 1"))
    return stored.read(spark, path)


@query("""with c as (select vec_id // 7 as group_id, label, count(*) as n from embeddings where label is not null group by all),
t as (select group_id, first(label order by n desc, label) as label from c group by 1)
select label::bigint as label, count(*) as tracks, (case when count(*) % 5 = 0 then 0 else 1 end)::bigint as apart, 0::bigint as split from t group by 1""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of seven windows dealt to five folds: of each class how many, how far the largest and the smallest fold are apart, tracks in two folds."""
    rows = tracks(spark, sf_dir).filter("genre_id is not null").select(F.expr("item_id div 7").alias("group_id"), F.col("genre_id").alias("label"))
    folds = saved(classify.grouped_folds(rows, 5), "folds")
    each = F.expr("explode(sequence(0, 4))")
    labels = classify.vote(rows, "group_id", "label").select("group_id", "label")
    seen = labels.join(folds, "group_id").groupBy("label", "fold").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("tracks"))
    every = labels.select("label").distinct().select("label", each.alias("fold")).join(seen, ["label", "fold"], "left")
    n = F.coalesce("n", F.lit(0))
    return every.groupBy("label").agg(F.sum(F.coalesce("tracks", F.lit(0))).alias("tracks"), (F.max(n) - F.min(n)).alias("apart"), F.sum(n - F.coalesce("tracks", F.lit(0))).alias("split"))


@query("""with p as (select vec_id, list_transform(embedding[1:16]::DOUBLE[], lambda y: abs(y)) as e from embeddings where embedding is not null)
select a.vec_id as a_id, b.vec_id as b_id, round(list_cosine_similarity(a.e, b.e), 3) as overall from p a join p b on b.vec_id = a.vec_id + 1""")
def band_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the whole band profiles of neighbouring tracks are."""
    p = tracks(spark, sf_dir).filter("vector is not null").select("item_id", F.transform(F.slice("vector", 1, 16), F.abs).alias("p"))
    other = p.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b_id"), F.col("p").alias("q"))
    return p.join(other, "item_id").select(F.col("item_id").alias("a_id"), "b_id", fv.band_overall(F.col("p"), F.col("q")).alias("overall"))


@query(f"""with {_BAND_SQL}, s as (select track_id, frame_idx - 8 as frame_idx, band, e from e where frame_idx >= 8 and frame_idx < 41), l as (select *, max(frame_idx) over (partition by track_id) + 1 as last from s),
b as (select track_id, case when last <= 9 then frame_idx else floor(((frame_idx + 1) * 9 - 1) / last) end::bigint as bin, band, avg(e) as x from l group by all)
select track_id, bin, band, round(sqrt(x / max(x) over (partition by track_id)), 4) as level from b""")
def timeline_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of a stretch of each track, from second 2 to 10.25 at four frames a second, in nine bins."""
    found = signal.timeline(signal.band_sums(frames(spark, sf_dir), _BANDS), 9, 2.0, 10.25, 4.0)
    return found.withColumn("band", F.col("band").cast("long"))


@query(f"""with h as ({records.SQL["style_agreement"]}), s as (select genre, count(*) as n, count(*) filter (hit) as hits from h group by 1), b as (select * from s union all select null, sum(n), sum(hits) from s having count(*) > 0)
select genre, n::bigint as n, hits::bigint as hits, (hits / n)::double as rate from b""")
def agreement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the styles of tracks agree with their genre, by genre and in all."""
    return metadata.agreement(records.style_agreement(spark, sf_dir))


@query("""with s as (select p_partkey as track_id, 100 + p_partkey % 25 + r as genre_id, (p_partkey % 100) / 100.0 - r as confidence, r as rank from part, range(0, 2) t(r)), k as (select c_custkey as track_id, 7 as genre_id, 0.5 as confidence, 0 as rank from customer)
select track_id::bigint as track_id, genre_id::bigint as genre_id, confidence::double as confidence, rank::bigint as rank from s union all select track_id, genre_id, confidence, rank from k where track_id not in (select track_id from s)""")
def suggestions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suggestions of a run beside those that tracks without new ones had."""
    new = "select p_partkey as track_id, cast(100 + p_partkey % 25 + r as bigint) as genre_id, cast(p_partkey % 100 as double) / 100 - r as confidence, cast(r as bigint) as rank from {part} lateral view explode(array(0, 1)) as r"
    old = "select c_custkey as track_id, cast(7 as bigint) as genre_id, cast(0.5 as double) as confidence, cast(0 as bigint) as rank from {customer}"
    return classify.kept_suggestions(view(spark, sf_dir, new), view(spark, sf_dir, old))


@query("""with c as (select c_custkey as cluster, c_mktsegment as major, case when c_custkey % 3 = 0 then concat('genre ', c_custkey % 12) end as genre, c_custkey * 7919 % 10007 as t from customer),
r as (select *, (genre is null or row_number() over (partition by major, genre order by t, cluster) = 1)::int as new from c), k as (select *, sum(new) over (partition by major order by t, cluster rows unbounded preceding) as k from r)
select cluster::bigint as cluster, concat(major, ' ', k) as name from k where genre is null""")
def numbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of groups without a genre beside those that have one."""
    text = "select cast(c_custkey as bigint) as cluster, c_mktsegment as major, case when c_custkey % 3 = 0 then concat('genre ', c_custkey % 12) end as genre, c_custkey * 7919 % 10007 as first_track from {customer}"
    return organise.running_names(view(spark, sf_dir, text))


@query("""with m as (select vec_id // 3 as track_id, i, avg(abs(embedding[i]::double)) as p from embeddings, range(1, 65) r(i) where embedding is not null group by all), r as (select *, row_number() over (partition by track_id order by p desc, i) as n from m)
select track_id, n as nth, concat('style ', i - 1) as style, round(p, 3) as p from r where n <= 10""")
def excerpt_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten likeliest styles of tracks of three excerpts, from the mean of their probabilities."""
    t = tracks(spark, sf_dir).filter("vector is not null").select(F.expr("item_id div 3").alias("track_id"), F.transform("vector", F.abs).alias("probs"))
    found = classify.excerpt_styles(t, F.array(*[F.lit(f"style {i}") for i in range(64)]))
    return found.select("track_id", F.posexplode("styles").alias("nth", "s")).select("track_id", (F.col("nth") + 1).cast("long").alias("nth"), "s.style", "s.p")
