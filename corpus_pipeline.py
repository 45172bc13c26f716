"""Corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes the whole table that the stage before it kept. Tables between stages are written and read again, so a lost
executor costs the tasks it ran, not the stages before.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crate.llm import exact_dedup, language_id, near_dedup, packing, pii
from crate.llm.registry import vocabulary
from crate.storage import saved

#: Language models and packing have no SQL form; tests/llm/test_pipeline.py holds the stages against what each must keep.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with columns named by their place, and their names: what an operator adds can't replace a column that docs has."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), docs.columns


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject: no letters, or a text unlike every language seen.

    Models are learned from the documents with a language. Where none has one, only texts without letters go. Null texts go.
    Columns of any name stay as they are; rows that are repeated are judged alike; an empty table gives an empty one.
    """
    models = language_id.fit(language_id.sample(docs))
    inner, names = _apart(docs)
    found = language_id.identified(inner, models, f"c{names.index('text')}")
    return found.filter(~F.col("rejected")).select(*inner.columns).toDF(*names)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; cases as in exact_dedup.drop_exact_copies()."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; cases as in near_dedup.drop_near_copies()."""
    return near_dedup.drop_near_copies(docs)


KEY = "spark.crate.pii.key"


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts under the secret of `spark.crate.pii.key`; where that is unset, under a new one that the session then keeps.

    So pseudonyms of several sessions are alike only if they are given one secret, and none stands in the source. n_chars follows where a
    pseudonym is shorter or longer. Null and empty texts stay as they are, as do columns of any name.
    """
    if not spark.conf.get(KEY, ""):
        spark.conf.set(KEY, secrets.token_hex(32))
    inner, names = _apart(docs)
    text, size = f"c{names.index('text')}", f"c{names.index('n_chars')}"
    found = pii.pseudonymised(inner, spark.conf.get(KEY), text)
    length = F.when(F.col("n_replaced") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size))
    return found.withColumn(size, length).select(*inner.columns).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens at most; cases as in packing.best_fit_packing()."""
    return packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents table; an empty table gives none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
