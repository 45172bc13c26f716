"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.llm import bpe, exact_dedup, fill_middle, language_id, multi_index, near_dedup, ngram_join, packing, pii, quality, spelling, substring_dedup, suffix_dedup

QUERIES: dict = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers, the same on every machine."""
    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(id_col: str, parts: int, held: int) -> F.Column:
    """Whether crc32 of the id as text leaves `held` when divided by `parts`; a row without an id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == held, F.lit(False))


@query
def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", _fold("doc_id", 4, 2).alias("held_out"))
    models = language_id.fit(language_id.sample(docs.filter("not held_out")))
    return language_id.identified(docs.drop("lang"), models).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), keep_ids=False)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op4_exact_dedup"] = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
), r as (
  select *, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id
  from t
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r
"""


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


#: Of these queries only; a job names its own secret.
PII_KEY = "pseudonyms of the registered query"


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


@query
def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(~_fold("doc_id", 5, 0))
    machine = quality.fit(quality.fitting_sample(docs, labels))
    score = F.col("quality_score")
    return quality.scored(docs, machine).select("doc_id", _fold("doc_id", 5, 0).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), " ")
    return found.select("doc_id", "n_chars", "n_removed", "n_spans", spans.alias("spans"), F.sha2("text", 256).alias("kept_sha256"))


SQL["op10_substring_dedup"] = r"""
with t as (
  select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from documents
), lines as (
  select doc_id, text, unnest(l) as line, unnest(range(len(l))) as k from t
), placed as (
  select *, sum(length(line) + 1) over (partition by doc_id order by k) - length(line) - 1 as start,
         trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) as norm
  from lines
), marked as (
  select *, norm <> '' and row_number() over (partition by norm order by doc_id, k) > 1 as gone from placed
)
select doc_id, length(any_value(text)) as n_chars, coalesce(sum(length(line)) filter (gone), 0)::bigint as n_removed, count(*) filter (gone) as n_spans,
       coalesce(string_agg(start::bigint || '-' || (start + length(line))::bigint, ' ' order by k) filter (gone), '') as spans,
       sha256(string_agg(case when gone then '' else line end, chr(10) order by k)) as kept_sha256
from marked group by doc_id
"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


# crc32 by its table, byte by byte; near words share a form with one letter left out (insertion, deletion) or masked (replacement).
SQL["op11_spelling"] = r"""
with recursive steps as (
  select i, i::bigint as c, 0 as k from range(256) as r(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8
), crc as (
  select list(c order by i) as tab from steps where k = 8
), found as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run
  from documents where text is not null
), runs as (
  select doc_id, run, count(*) as n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as bytes from found where length(run) >= 5 group by doc_id, run
), hashed as (
  select run, n, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(1, length(bytes), 2), lambda k: ('0x' || substr(bytes, k, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as h
  from runs, crc
), spelled as (
  select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
), v as (
  select word, sum(n)::bigint as n from spelled where length(word) >= 5 group by word having sum(n) >= 3
), masked as (
  select word, left(word, i::int) || '*' || substr(word, i::int + 2) as form from (select word, unnest(range(length(word))) as i from v)
), shorter as (
  select distinct word, left(word, i::int) || substr(word, i::int + 2) as form from (select word, unnest(range(length(word))) as i from v)
), near as (
  select a.word, b.word as other from masked a join masked b using (form) where a.word <> b.word
  union select s.word, v.word from shorter s join v on v.word = s.form
  union select v.word, s.word from shorter s join v on v.word = s.form
), ranked as (
  select near.word, near.other, o.n as other_n, w.n as own, count(*) over (partition by near.word) as n_near,
         row_number() over (partition by near.word order by o.n desc, encode(near.other)) as k
  from near join v o on o.word = near.other join v w on w.word = near.word
), formed as (
  select word, n_near, case when other_n >= 2 * own then other end as form, case when other_n >= 2 * own then other_n end as form_n from ranked where k = 1
), walk as (
  select word, form as at from formed where form is not null
  union all
  select walk.word, f.form from walk join formed f on f.word = walk.at where f.form is not null
), roots as (
  select w.word, w.at as root from walk w left join formed f on f.word = w.at where f.form is null
)
select v.word, f.form, coalesce(r.root, v.word) as root, v.n, coalesce(f.n_near, 0)::bigint as n_near, f.form_n
from v left join formed f using (word) left join roots r using (word)
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_in_middle(documents(spark, sf_dir))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


SQL["op12_fill_in_middle"] = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents
), u as (
  select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2,
         ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4
  from t
), c as (
  select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from u
), p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(coalesce(prefix, '')) end as prefix_chars, case when form <> 'plain' then length(coalesce(middle, '')) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || coalesce(prefix, '') || '<S>' || coalesce(suffix, '') || '<M>' || coalesce(middle, '')
                        else '<S>' || coalesce(suffix, '') || '<P>' || coalesce(prefix, '') || '<M>' || coalesce(middle, '') end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


# Every pair of documents that share a shingle is counted, so each link is seen; components by the least id that is reachable.
SQL["op13_ngram_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents
), sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [hash(w)]
                      else list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(w[i:i + 3]))) end as s
  from words
), twins as materialized (
  select min(doc_id) as node, list_sort(s) as s, len(s) as n from sets where len(s) > 0 group by list_sort(s), len(s)
), posts as materialized (
  select node, n, unnest(s) as t from twins
), pairs as (
  select a.node as x, b.node as y, a.n as nx, b.n as ny, count(*) as c from posts a join posts b on a.t = b.t and a.node < b.node group by all
), links as materialized (
  select x, y from pairs where 100 * c >= 85 * (nx + ny - c) union select y, x from pairs where 100 * c >= 85 * (nx + ny - c)
), reach as (
  select node as x, node as y from twins union select r.x, l.y from reach r join links l on l.x = r.y
), least_of as (
  select x, min(y) as component_id from reach group by x
)
select s.doc_id, len(s.s) as n_shingles, coalesce(l.component_id, s.doc_id) as component_id
from sets s left join twins t on t.s = list_sort(s.s) and len(s.s) > 0 left join least_of l on l.x = t.node
"""
