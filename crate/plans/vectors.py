"""Registered queries on vectors: genre by example, sound-alikes, windows, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crate.functions import vectors as fv
from crate.operators import classify, knn

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, genre_id, vector of the embeddings table."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("genre_id"), fv.doubles(F.col("embedding")).alias("vector"))


def exemplars(t: DataFrame) -> DataFrame:
    return t.filter("item_id % 5 <> 0 and genre_id is not null").select("genre_id", "vector")


X = "x as (select vec_id, label::bigint as label, embedding::DOUBLE[] as e from embeddings where embedding is not null)"
CENTROIDS = """ex as (select label, i, avg(e[i]) as m from x, range(1, 65) t(i) where vec_id % 5 <> 0 and label is not null group by all),
c as (select label as g, list(m order by i) as c from ex group by label)"""
SCORES = f"""with {X}, {CENTROIDS}, s as (select vec_id, label, g, round(list_cosine_similarity(e, c), 6) as score from x, c),
r as (select *, row_number() over (partition by vec_id order by score desc, g) as rn from s)"""


@query(f"{SCORES} select vec_id as item_id, g as genre_id, score, rn as rank from r where rn <= 3")
def classify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    scores = classify.centroid_scores(t, classify.mean_vectors(exemplars(t), "genre_id"))
    n = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "genre_id"))
    return scores.withColumn("rank", n).filter("rank <= 3")


@query(f"with {X}, {CENTROIDS} select g as genre_id, u.i - 1 as i, round(c[u.i] / sqrt(list_sum(list_transform(c, lambda y: y * y))), 9) as x from c, range(1, 65) u(i)")
def centroid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return classify.mean_vectors(exemplars(t), "genre_id").select("genre_id", F.posexplode("vector").alias("i", "v")).select("genre_id", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("x"))


@query(f"""{SCORES}, b as (select *, max(score) over (partition by vec_id) as best from r)
select vec_id as item_id, case when best >= 0.35 then g else -1 end as genre_id, score as confidence, rn - 1 as rank, 'centroid' as method from b where rn = 1 or (best >= 0.35 and rn <= 3)""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    found = classify.suggest(classify.centroid_scores(t, classify.mean_vectors(exemplars(t), "genre_id")))
    return found.withColumn("genre_id", F.coalesce("genre_id", F.lit(-1)))  # -1: for review


@query(f"""{SCORES}, k as (select vec_id, label, max(case when rn = 1 and score >= 0.1 then g end) as said, max(case when rn <= 3 and score >= 0.1 and g = label then 1 else 0 end) as near from r where vec_id % 5 = 0 and label is not null group by all),
u as (select label as g, case when said = label then 1 else 0 end as tp, 0 as fp, case when said is distinct from label then 1 else 0 end as fn from k
union all select said, 0, case when said = label then 0 else 1 end, 0 from k where said is not null)
select g as genre_id, coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0.0)::double as precision, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0.0)::double as recall,
(select avg((said is not distinct from label)::int) from k)::double as top1, (select avg(near) from k)::double as top3 from u group by g""")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    scores = classify.centroid_scores(t.filter("item_id % 5 = 0"), classify.mean_vectors(exemplars(t), "genre_id"))
    said = classify.suggest(scores, threshold=-2.0)
    return classify.accuracy_report(said, t.filter("item_id % 5 = 0 and genre_id is not null"), threshold=0.1)


@query(f"""with {X}, n as (select vec_id, label, list_transform(e, lambda y: y / sqrt(list_sum(list_transform(e, lambda z: z * z)))) as u from x),
s as (select a.vec_id, b.label, avg(list_inner_product(a.u, b.u)) as score from n a, n b where a.vec_id % 5 = 0 and b.vec_id % 5 <> 0 and b.label is not null group by all)
select vec_id as item_id, label as genre_id, round(score, 6) as score from s""")
def knn_genre_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return classify.exemplar_scores(t.filter("item_id % 5 = 0"), exemplars(t))


@query(f"""with {X}, p as (select vec_id, label, (row_number() over (partition by label order by vec_id) - 1) % 5 as fold from x where label is not null),
f as (select p.*, e from p join x using (vec_id)), m as (select t.i as fold, label, d.i, avg(e[d.i]) as m from f, range(0, 5) t(i), range(1, 65) d(i) where f.fold <> t.i group by all),
c as (select fold, label as said, list(m order by i) as c from m group by all),
r as (select f.vec_id, f.fold, f.label, said, row_number() over (partition by f.vec_id order by round(list_cosine_similarity(e, c), 6) desc, said) as n from f join c using (fold))
select fold, count(*) as n, avg((said = label)::int)::double as accuracy from r where n = 1 group by fold""")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.cross_validated(tracks(spark, sf_dir).filter("genre_id is not null and vector is not null"))


def _near(where: str, more: str = "", k: int = 10) -> str:
    return f"""with {X}, s as (select a.vec_id as query_id, b.vec_id as item_id, round(list_cosine_similarity(a.e, b.e), 6) as score from x a, x b where a.vec_id % 20 = 0 and {where}),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s {more}) select query_id, item_id, score, rank from r where rank <= {k}"""


def _asked(t: DataFrame) -> DataFrame:
    return t.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")


@query(_near("a.vec_id <> b.vec_id"))
def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return knn.top_k(_asked(t), t, 10)


@query(_near("b.vec_id % 3 <> 0 and a.vec_id <> b.vec_id", k=5))
def nearest_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    gone = t.filter("item_id % 3 = 0").select("item_id")
    return knn.top_k(_asked(t), t.join(gone, "item_id", "left_anti"), 5)


@query(_near("a.vec_id <> b.vec_id", "where score >= 0.25", k=1000))
def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return knn.top_k(_asked(t), t, 1000, floor=0.25)


@query(f"""with p as (select vec_id, list_transform(embedding[1:16]::DOUBLE[], lambda y: abs(y)) as e from embeddings where embedding is not null),
m as (select i, avg(e[i]) as m from p, range(1, 17) t(i) group by i), mm as (select list(m order by i) as mean from m),
x as (select vec_id, list_transform(e, lambda y, k: y - mean[k]) as e from p, mm),
s as (select a.vec_id as query_id, b.vec_id as item_id, round(list_cosine_similarity(a.e, b.e), 6) as score from x a, x b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s) select query_id, item_id, score, rank from r where rank <= 10""")
def spectral_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound-alikes by spectral profile, less the mean profile of the collection."""
    p = tracks(spark, sf_dir).filter("vector is not null").select("item_id", F.transform(F.slice("vector", 1, 16), F.abs).alias("vector"))
    mean = classify.mean_vectors(p.withColumn("one", F.lit(1)), "one", unit=False).select(F.col("vector").alias("mean"))
    centred = p.crossJoin(F.broadcast(mean)).select("item_id", F.zip_with("vector", "mean", lambda a, b: a - b).alias("vector"))
    return knn.top_k(_asked(centred), centred, 10)


@query(f"""with {X}, s as (select a.vec_id as query_id, b.vec_id // 10 as track_id, b.vec_id as item_id, round(list_cosine_similarity(a.e, b.e), 6) as score from x a, x b where a.vec_id % 50 = 0 and a.vec_id // 10 <> b.vec_id // 10),
w as (select *, row_number() over (partition by query_id, track_id order by score desc, item_id) as n from s),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from w where n = 1) select query_id, track_id, item_id, score, rank from r where rank <= 8""")
def best_window_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window search: every ten vectors are the windows of a track; the best window of each track counts, the query's own track doesn't."""
    t = tracks(spark, sf_dir).withColumn("track_id", F.expr("item_id div 10"))
    # One track more than asked for: the query's own is taken out afterwards.
    found = knn.top_k(t.filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "vector"), t, 9, group="track_id", skip_same_id=False)
    other = found.filter("query_id div 10 <> grp")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return other.withColumn("rank", n).filter("rank <= 8").select("query_id", F.col("grp").alias("track_id"), "item_id", "score", "rank")


@query(f"""with {X}, s as (select a.vec_id as query_id, b.vec_id as item_id, round(list_cosine_similarity(a.e, b.e), 6) as score from x a, x b where a.vec_id % 100 = 0),
z as (select *, avg(score) over (partition by query_id) as m, stddev_pop(score) over (partition by query_id) as d from s),
r as (select query_id, item_id, round((score - m) / case when d = 0 then 1 else d end, 6) as z from z) select query_id, item_id, z from r where z >= 2.0""")
def search_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a query calibrated by their mean and spread over the collection."""
    t = tracks(spark, sf_dir)
    return knn.calibrated(t.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector"), t, 2.0)


@query("""with p as (select vec_id, list_transform(embedding[1:16]::DOUBLE[], lambda y: abs(y)) as e from embeddings where embedding is not null),
r as (select vec_id, list_sum(e[1:3]) as sub, list_sum(e[4:6]) as bass, list_sum(e[7:8]) as lowmid, list_sum(e[9:12]) as mid, list_sum(e[13:14]) as himid, list_sum(e[15:16]) as highs from p),
j as (select a.vec_id as a_id, b.vec_id as b_id, unnest(['sub', 'bass', 'low-mid', 'mid', 'high-mid', 'highs']) as name, unnest([a.sub, a.bass, a.lowmid, a.mid, a.himid, a.highs]) as a, unnest([b.sub, b.bass, b.lowmid, b.mid, b.himid, b.highs]) as b from r a join r b on b.vec_id = a.vec_id + 1)
select a_id, b_id, name, round(a, 3) as a, round(b, 3) as b, round(greatest(0, least(1, 1 - abs(a - b) / (a + b + 1e-9))), 3) as match from j""")
def band_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tracks(spark, sf_dir).filter("vector is not null").select("item_id", F.transform(F.slice("vector", 1, 16), F.abs).alias("p"))
    other = p.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b_id"), F.col("p").alias("q"))
    return p.join(other, "item_id").select(F.col("item_id").alias("a_id"), "b_id", F.inline(fv.band_breakdown(F.col("p"), F.col("q"))))


#: The embedding beside the means of its eighths, at 0.6.
_FUSED = """q as (select vec_id, list_transform(range(1, 9), lambda k: list_sum(e[8 * k - 7 : 8 * k]) / 8) as tags from x),
n as (select vec_id, list_transform(e, lambda y: y / sqrt(list_sum(list_transform(e, lambda w: w * w)))) as a, list_transform(tags, lambda y: 0.6 * y / sqrt(list_sum(list_transform(tags, lambda w: w * w)))) as b from x join q using (vec_id)),
f as (select vec_id, list_concat(a, b) as v from n)"""


def _fused(t: DataFrame) -> DataFrame:
    tags = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(F.slice("vector", k * 8 + 1, 8), F.lit(0.0), lambda s, x: s + x) / 8)
    return t.withColumn("tags", tags).select("item_id", "genre_id", fv.fuse([(F.col("vector"), 1.0, 64), (F.col("tags"), 0.6, 8)]).alias("v"))


@query(f"""with {X}, {_FUSED} select vec_id as item_id, u.i - 1 as i, round(v[u.i] / sqrt(list_sum(list_transform(v, lambda w: w * w))), 6) as x from f, range(1, 73) u(i)""")
def fused_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _fused(tracks(spark, sf_dir).filter("vector is not null"))
    return fused.select("item_id", F.posexplode("v").alias("i", "y")).select("item_id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("x"))


@query(f"""with {X}, {_FUSED}, u as (select label, u.i - 1 as i, v[u.i] / sqrt(list_sum(list_transform(v, lambda w: w * w))) as x from f join embeddings using (vec_id), range(1, 73) u(i) where vec_id % 3 = 0 and label % 4 <> 0),
m as (select label, i, avg(x) as m from u group by all) select label::bigint as genre_id, i, round(m / sqrt(sum(m * m) over (partition by label)), 6) as x from m
union all select distinct label::bigint, 0, 1.0 from embeddings where label is not null and label not in (select label from m)""")
def fused_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the examples in the fused space; genres without examples keep theirs."""
    t = tracks(spark, sf_dir)
    fused = _fused(t.filter("vector is not null")).select(F.col("item_id").alias("track_id"), F.col("v").alias("vector"))
    old = t.filter("genre_id is not null").select("genre_id").distinct().withColumn("vector", F.array(F.lit(1.0)))
    given = t.filter("item_id % 3 = 0 and genre_id % 4 <> 0").select("genre_id", F.col("item_id").alias("track_id"))
    rows = classify.refreshed(old, given, fused).select("genre_id", F.posexplode("vector").alias("i", "x"))
    return rows.select("genre_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
