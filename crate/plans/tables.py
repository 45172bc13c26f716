"""Registered queries on plans, logs, merges and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.operators import metadata, organise, taxonomy
from crate.plans.library import A, ANALYSIS, ASSIGNMENTS, G, GENRES, S, T, TRACKS, view
from crate.plans.sound import EDGES, EDGES_SQL
from crate.sources import tables, taxonomy_files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""select a.track_id, coalesce(t.title, '') as from_value, g.name as to_value, coalesce(p.name, g.name) as grouping from {S} a join {G} g using (genre_id) left join {G} p on p.genre_id = g.parent_id left join {T} t on t.track_id = a.track_id where a.status <> 'rejected'""")
def tag_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = view(spark, sf_dir, TRACKS).select("track_id", F.col("title").alias("genre"))
    found = organise.tag_plan(view(spark, sf_dir, ASSIGNMENTS), view(spark, sf_dir, GENRES), existing)
    return found.select("track_id", F.coalesce("from_value", F.lit("")).alias("from_value"), "to_value", "grouping")


LOG = """select o_orderkey div 4 as id, o_orderkey as event, case when o_orderkey div 4 % 2 = 0 then 'move' else 'tag' end as type, o_custkey as track_id, concat('from ', cast(o_orderkey div 4 as string)) as from_value,
concat('to ', cast(o_orderkey div 4 as string)) as to_value, case when o_orderkey % 3 = 0 then 'undone' else 'done' end as status from {orders}"""
LOG_SQL = LOG.replace(" div ", " // ").replace("as string", "as varchar").format(orders="orders")


@query(f"""with l as ({LOG_SQL}), r as (select *, row_number() over (partition by id order by event desc) as n from l) select id, track_id, to_value as from_value, from_value as to_value from r where n = 1 and type = 'move' and status = 'done'""")
def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What takes the done moves of an append-only log back: the latest event of an action counts."""
    log = spark.sql(LOG, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return organise.undo_plan(log, "move")


@query(f"""select a.track_id, case when g.genre_id is null then -1 else a.genre_id end as genre_id from {S} a left join (select genre_id from {G} where genre_id % 3 <> 0) g using (genre_id)""")
def set_null_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments after a third of the genres are gone: their references are null (shown as -1)."""
    left = view(spark, sf_dir, GENRES).filter("genre_id % 3 <> 0")
    out = tables.set_null(view(spark, sf_dir, ASSIGNMENTS).select("track_id", "genre_id"), left, "genre_id", "genre_id")
    return out.withColumn("genre_id", F.coalesce("genre_id", F.lit(-1)))


@query(f"""select track_id, genre_id from {S} where genre_id % 2 = 1 union all select p_partkey, 100 + p_partkey % 25 from part where p_partkey % 25 in (2, 4, 6)
union all select track_id, genre_id from {S} where genre_id % 2 = 0 and genre_id not in (102, 104, 106)""")
def replace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the groups that new rows name are replaced."""
    new = view(spark, sf_dir, "select p_partkey as track_id, 100 + p_partkey % 25 as genre_id from {part} where p_partkey % 25 in (2, 4, 6)")
    return tables.replace_group(view(spark, sf_dir, ASSIGNMENTS).select("track_id", "genre_id"), new, ["genre_id"])


@query(f"""with l as (select track_id, name as genre from {S} join {G} using (genre_id)), s as (select track_id, [lower(case track_id % 3 when 0 then 'deep ' else '' end || n.n_name), 'other'] as styles from {S} join nation n on n.n_nationkey = track_id % 25)
select track_id, genre, len(list_filter(styles[1:5], lambda x: contains(x, lower(genre)) or (genre = 'CHINA' and contains(x, 'japan')))) > 0 as hit from l join s using (track_id)""")
def style_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, ASSIGNMENTS).join(F.broadcast(view(spark, sf_dir, GENRES)), "genre_id").select("track_id", F.col("name").alias("genre"))
    named = view(spark, sf_dir, ASSIGNMENTS).select("track_id", (F.col("track_id") % 25).alias("n_nationkey")).join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), "n_nationkey")
    style = F.lower(F.concat(F.when(F.col("track_id") % 3 == 0, "deep ").otherwise(""), "n_name"))
    styles = named.select("track_id", F.array(F.struct(style.alias("style"), F.lit(0.9).alias("p")), F.struct(F.lit("other").alias("style"), F.lit(0.1).alias("p"))).alias("styles"))
    accept = view(spark, sf_dir, GENRES).filter("name = 'CHINA'").select(F.col("name").alias("genre"), F.array(F.lit("china"), F.lit("japan")).alias("names"))
    return metadata.style_agreement(labels, styles, accept)


@query(f"""with p as (select p_partkey as track_id, case p_partkey % 3 when 0 then 'Drum and Bass' when 1 then '' else 'Polka' end as genre, (p_partkey % 10) / 10.0 as confidence from part)
select p.track_id, p.genre, p.confidence::double as confidence from p join {A} a using (track_id) where p.genre <> '' and p.confidence >= 0.6 and p.track_id % 5 <> 0 and (p.genre = 'Polka' or a.bpm between 156 and 184 or a.bpm / 2 between 156 and 184 or a.bpm * 2 between 156 and 184)""")
def accepted_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed genres that are named, sure, of a plausible tempo, and of tracks that have none yet."""
    p = view(spark, sf_dir, "select p_partkey as track_id, case p_partkey % 3 when 0 then 'Drum and Bass' when 1 then '' else 'Polka' end as genre, cast(p_partkey % 10 as double) / 10 as confidence from {part}")
    known = view(spark, sf_dir, "select p_partkey as track_id, array('x') as genres from {part} where p_partkey % 5 = 0")
    return metadata.accepted_proposals(p, known, view(spark, sf_dir, ANALYSIS))


@query(f"""with e as ({EDGES_SQL}), c as (select concat('g', c_custkey) as src, concat('g', c_custkey % 7) as dst, 'fusion' as rel from customer where c_custkey % 3 = 0)
select src, dst, rel from e union all select src, dst, rel from c where (src, dst) not in (select (src, dst) from e) and src in (select concat('g', c_custkey) from customer where c_custkey % 2 = 0)""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated = view(spark, sf_dir, "select concat('g', cast(c_custkey as string)) as src, concat('g', cast(c_custkey % 7 as string)) as dst, 'fusion' as rel from {customer} where c_custkey % 3 = 0")
    words = view(spark, sf_dir, "select concat('g', cast(c_custkey as string)) as name from {customer} where c_custkey % 2 = 0")
    return metadata.merged_edges(view(spark, sf_dir, EDGES), curated, words)


@query(f"""with recursive e as ({EDGES_SQL}), h as (select dst as parent, src as child from e where rel <> 'influence'), n as (select parent as name from h union select child from h),
t as (select [name] as path, name, 0 as depth from n where name not in (select child from h) union all select list_append(path, child), child, depth + 1 from t join h on parent = name where not list_contains(path, child) and depth < 16),
p as (select array_to_string(path, ' > ') as path, array_to_string(path[1:len(path) - 1], ' > ') as above, name, depth from t), f as (select *, 2 + row_number() over (order by depth, path) as genre_id from p where path not in ('g1', 'g2')),
k as (select path, genre_id from f union all select 'g1', 1 union all select 'g2', 2)
select f.genre_id, f.name, coalesce(k.genre_id, -1) as parent_id, case when depth = 0 then 'genre' else 'subgenre' end as level, f.path from f left join k on k.path = f.above""")
def seeded_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for all paths of the genre graph that aren't seeded yet, parents' ids with them."""
    links = view(spark, sf_dir, EDGES).filter("rel <> 'influence'").select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    nodes = links.select(F.col("parent").alias("name")).union(links.select("child")).distinct()
    existing = view(spark, sf_dir, "select c_custkey as genre_id, concat('g', cast(c_custkey as string)) as path from {customer} where c_custkey <= 2")
    return taxonomy_files.seeded(taxonomy.unfold(nodes, links), existing).withColumn("parent_id", F.coalesce("parent_id", F.lit(-1)))


@query(f"""with m as (select g.name, count(*) filter (a.status = 'confirmed') as confirmed, count(*) as n from {S} a join {G} g using (genre_id) group by 1) select name, n, confirmed, confirmed >= 5 as ready from m""")
def ready_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with enough confirmed members to learn from."""
    rows = view(spark, sf_dir, ASSIGNMENTS).join(F.broadcast(view(spark, sf_dir, GENRES)), "genre_id")
    out = rows.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    return out.withColumn("ready", F.col("confirmed") >= 5)


@query(f"""with v as (select track_id, genre_id, count(*) over (partition by genre_id) as n from {S}), c as (select n_regionkey as cluster, s.genre_id, count(*) as votes from {S} s join nation n on n.n_nationkey = s.track_id % 25 group by all),
r as (select *, row_number() over (partition by cluster order by votes desc, genre_id) as k from c) select cluster, genre_id, votes from r where k = 1""")
def cluster_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest genre of each group of tracks."""
    from crate.operators.classify import vote

    rows = view(spark, sf_dir, ASSIGNMENTS).withColumn("n_nationkey", F.col("track_id") % 25).join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), "n_nationkey")
    return vote(rows.withColumnRenamed("n_regionkey", "cluster"), "cluster", "genre_id")
