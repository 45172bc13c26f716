"""Exact deduplication over an extendible-hash index kept on shared files (DataFrame functions only)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crate.storage import bounded, saved

SPACES = r"[\x20\x09-\x0D]+"
#: Bits of the hash that the directory may use: at most 2**16 slots, so a directory of at most 2**16 small rows.
SLOT_BITS = 16
#: Distinct keys that a bucket holds before it is split.
BUCKET_KEYS = 16_384


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(text, SPACES, "").alias("norm"), F.length(text).alias("n_points"), F.xxhash64(text).alias("h_text"))
    return rows.select("doc_id", "n_points", "h_text", "norm", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"))


def _slot(h) -> F.Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS)


def _directory(keys: DataFrame, bucket_keys: int) -> DataFrame:
    """slot -> bucket: starts as one bucket and doubles until none holds more than bucket_keys distinct keys.

    A bucket of local depth g is named by 2**g plus its g leading hash bits. At depth SLOT_BITS a bucket is no
    longer split; its keys chain. Copies of one text are one key, so a hot text never forces a split.
    """
    slots = saved(keys.groupBy(_slot("h").alias("slot")).agg(F.count("*").alias("n")), "slots")
    settled, todo = [], slots
    for depth in range(SLOT_BITS + 1):
        named = todo.withColumn("bucket", F.lit(1 << depth) + F.shiftright("slot", SLOT_BITS - depth))
        load = named.groupBy("bucket").agg(F.sum("n").alias("load"))  # at most 2**depth rows
        sized = named.join(F.broadcast(load), "bucket")
        full = (F.col("load") > bucket_keys) & F.lit(depth < SLOT_BITS)
        settled.append(saved(sized.filter(~full).select("slot", "bucket"), "directory"))
        todo = saved(sized.filter(full).select("slot", "n"), "overfull")
        if todo.isEmpty():
            break
    directory = settled[0]
    for part in settled[1:]:
        directory = directory.unionByName(part)
    return directory


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, copies, bucket, chain, h_text.

    Texts are equal when identical after deleting ASCII white space. Of equal texts the row with the most code
    points in the original, then the smallest id, stays. The index has an entry per distinct text: the directory sends a row to
    the bucket of its hash, an entry is made and looked up in its bucket only, and `chain` is its place among texts whose 64-bit
    hashes collide there. Within a bucket and hash, bytes are compared. h_text is a hash of the original text.

    Null text counts as empty; all empty texts are one group. A null id loses every tie; where all ids of a group
    are null, one row stays and keep_id is null. Rows repeated with the same id count singly in group_size and only one
    of them is kept; `copies` counts rows with this id and text. Other columns are ignored, whatever their names.
    An empty input gives an empty result.
    """
    rows = _keyed(docs, text_col, id_col).withColumn("slot", _slot("h"))
    same = Window.partitionBy("doc_id", "h", "text_sha256")
    entries = rows.drop("norm").select(
        "*", F.row_number().over(same.orderBy(F.desc("n_points"), "h_text")).alias("nth"), F.count("*").over(same).alias("copies")
    )
    entries = saved(entries, "entries")
    directory = saved(_directory(entries.select("h").distinct(), bucket_keys), "slots")  # at most 2**SLOT_BITS rows
    routed = lambda df: df.join(F.broadcast(directory), "slot").drop("slot")

    # Rank as one number, so that the grouping stays a hash aggregate: code points first, then the smaller id.
    big, top = F.lit(Decimal(1 << 65)), F.lit(Decimal(1 << 63))
    by_id = F.coalesce(top - F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(0)))  # from 1, or 0 without an id
    rank = (F.col("n_points").cast("decimal(17,0)") * big + by_id).cast("decimal(38,0)")
    # Grouping by the text itself compares bytes; partial sums shrink a hot text to a row a task before the shuffle.
    key = ["bucket", "h", "text_sha256"]
    groups = routed(rows.withColumn("rank", rank)).groupBy(*key, "norm").agg(F.count("*").alias("group_size"), F.max("rank").alias("best"))
    chained = groups.select(*key, "group_size", "best", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")).alias("chain"))
    index = saved(chained.repartitionByRange("bucket", "h"), "index")  # an owner has a range of buckets and keys

    low = F.col("best") % big
    keep_id = F.when(low > 0, (top - low).cast("long"))
    owner = index.select(*key, "group_size", "chain", keep_id.alias("keep_id"), F.floor((F.col("best") - low) / big).cast("long").alias("keep_points"))
    found = routed(entries).join(owner, key)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("nth") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "copies", "bucket", "chain", "h_text")


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the copies that exact_dedup() does not keep; columns and row contents are unchanged.

    Only the keys of what goes are joined back, so that texts stay where they are while these are few. Rows repeated with id and text
    are one; null, empty and clashing cases are those of exact_dedup().
    """
    names = docs.columns
    text_col, id_col = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # own helpers can't meet a column of the same name
    keys = exact_dedup(docs, text_col, id_col).groupBy("doc_id", "h_text").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n"))
    keys = saved(keys.filter("not stays or n > 1").toDF("_id", "_h", "_stays", "_n"), "dropped")
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h"))
    single = keyed.join(bounded(keys.select("_id", "_h")), on, "left_anti").select(*docs.columns)
    repeated = saved(keys.filter("_stays").select("_id", "_h"), "repeated")
    if repeated.isEmpty():
        return single.toDF(*names)
    first = F.row_number().over(Window.partitionBy(id_col, "_key").orderBy(*[F.col(c) for c in docs.columns if c != text_col]))
    return single.unionByName(keyed.join(bounded(repeated), on, "left_semi").withColumn("_nth", first).filter("_nth = 1").select(*docs.columns)).toDF(*names)
