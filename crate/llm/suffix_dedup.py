"""Removal of long repeated byte strings by difference-cover suffix sorting, dealt by anchors.

A string of LENGTH bytes owns an anchor: the leftmost GRAM-byte substring in it with the smallest hash. Equal strings
have equal anchors at equal offsets. So Spark first counts anchors over all documents; only strings whose anchor occurs
again can repeat. The strings of a run that own one anchor make up its context. Spark groups contexts by digest: all but the
earliest of equal ones go. Only anchors with several contexts are dealt out, so that all copies of a string meet in one task, which
sorts the suffixes with a difference cover (sampled triples, recursion on names, merge of the rest) and compares neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crate.llm.workers import releasing
from crate.storage import bounded, discard, saved, settle

LENGTH, GRAM = 100, 24
#: Bytes that one task sorts, about; the number of tasks grows with the input.
TASK_BYTES = 1_000_000
#: Anchors of more distinct contexts, which could fill a task, are hot: their strings are dealt one by one, by content, instead of all to one task.
HOT = TASK_BYTES // (LENGTH + 40)
#: Positions handled at a time, for texts of any length.
SEGMENT = 1 << 22

_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all substrings of 24 bytes, from those of 16 and 8."""
    h = (b.astype(np.uint64) + np.uint64(1)) * _M[0]
    by = {1: h}
    for n in (1, 2, 4, 8):
        h = by[n]
        left, right = h[: len(h) - n], h[n:]
        by[2 * n] = (left * _M[1]) ^ (right >> np.uint64(7)) ^ (right * _M[0])
    m = len(b) - GRAM + 1
    z = (by[16][:m] * _M[2]) ^ by[8][16 : 16 + m]
    z ^= z >> np.uint64(31)
    z *= _M[0]
    return z ^ (z >> np.uint64(29))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, number of starts) of each anchor: runs of starts whose strings own the same anchor."""
    w, total = LENGTH - GRAM + 1, len(b) - LENGTH + 1
    found = []
    for lo in range(0, max(total, 0), SEGMENT):
        n = min(SEGMENT, total - lo)
        z = _gram_hashes(b[lo : lo + n + LENGTH - 1])
        key = ((z >> np.uint64(24)) << np.uint64(24)) | np.arange(len(z), dtype=np.uint64)  # ties: the leftmost
        own = (_least(key, w) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        found.append((z[own[first]].view(np.int64), own[first] + lo, first + lo, np.diff(np.concatenate([first, [n]]))))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of values, from 1, and how many there are."""
    if len(keys) and int(keys.max()) < 1 << 25:
        there = np.zeros(int(keys.max()) + 1, bool)
        there[keys] = True
        rank = np.cumsum(there)
        return rank[keys], int(rank[-1])
    distinct, rank = np.unique(keys, return_inverse=True)
    return rank + 1, len(distinct)


def _before(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of the ordered values are less than each key; keys are looked up in their own order, which caches well."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(ordered, keys[order], "left")
    return out


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def ranks(s: np.ndarray, reach: int) -> np.ndarray:
    """Rank of each suffix of s (values from 1) by its first `reach` values at least; suffixes equal that far may tie.

    The difference cover {1, 2} mod 3: suffixes that start there are ranked by recursion on the names of their triples; the others by
    their first value and the rank of the next suffix. Both orders are merged by searching the keys that they share.
    """
    n = len(s)
    t = np.concatenate([s, np.zeros(4, s.dtype)]).astype(np.int64)
    ones, twos, rest = (np.arange(k, n, 3) for k in (1, 2, 0))
    sample = np.concatenate([ones, twos])
    base = int(t.max()) + 1
    if base < 1 << 20:
        triple = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
        name, distinct = _names(triple)
    else:
        pair, _ = _names(_packed(t[sample], t[sample + 1]))
        name, distinct = _names(_packed(pair, t[sample + 2]))
    if distinct < len(sample) and reach > 3:
        deeper = np.concatenate([name[: len(ones)], [0], name[len(ones) :]])  # a border between the two parts
        deeper = ranks(deeper + 1, -(-reach // 3))
        name = np.concatenate([deeper[: len(ones)], deeper[len(ones) + 1 :]])
        name, distinct = _names(name)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    # Keys that compare a suffix of the rest with one of either part of the sample.
    by_one = lambda i: _packed(t[i], rank[i + 1])
    first_two = t[:n] * base + t[1 : n + 1] if base < 1 << 16 else _names(_packed(t[:n], t[1 : n + 1]))[0]
    by_two = lambda i: _packed(first_two[i], rank[i + 2])
    keys = by_one(rest)
    key_one, key_two = np.sort(by_one(ones)), np.sort(by_two(twos))
    order = np.sort(keys)
    out = np.empty(n, np.int64)
    key_rest_two = by_two(rest)
    out[rest] = _before(order, keys) + _before(key_one, keys) + _before(key_two, key_rest_two)
    counts = np.bincount(name)
    less = (np.cumsum(counts) - counts)[name]  # within the sample
    out[ones] = less[: len(ones)] + _before(order, by_one(ones))
    out[twos] = less[len(ones) :] + _before(np.sort(key_rest_two), by_two(twos))
    return out + 1


def _repeats(contexts: list[bytes], docs: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its strings of LENGTH bytes also start at an earlier place in another context or in this one.

    docs and offs tell where the contexts start.
    """
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    there = np.bincount(text, minlength=256) > 0
    s = (np.cumsum(there) + 1)[text]
    s[starts + sizes] = 1  # the end of a context; no string of LENGTH bytes holds one
    rank = ranks(s, LENGTH)
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[owner] + offset
    order = np.argsort(rank[at], kind="stable")
    at = at[order]
    # Neighbours in suffix order with LENGTH bytes in common are one class.
    same = np.zeros(len(at), bool)
    for lo in range(1, len(at), 1 << 16):
        hi = min(lo + (1 << 16), len(at))
        i, j, alike = at[lo - 1 : hi - 1], at[lo:hi], np.ones(hi - lo, bool)
        for k in range(LENGTH):
            live = np.flatnonzero(alike) if k % 8 == 0 else live
            alike[live] &= text[i[live] + k] == text[j[live] + k]
            if k % 8 == 7 and not alike.any():
                break
        same[lo:hi] = alike
    group = np.cumsum(~same) - 1
    doc, start = docs[owner[order]], offs[owner[order]] + offset[order]
    by = np.lexsort((start, doc, group))
    lead = np.concatenate([[True], group[by][1:] != group[by][:-1]])
    first = by[np.flatnonzero(lead)]  # the earliest of each class
    later = (doc != doc[first][group]) | (start != start[first][group])
    out = np.zeros(len(at), bool)
    out[order] = later
    return np.split(out, np.cumsum(counts)[:-1])


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


#: A run of strings with one anchor as a number: first start, number of starts (under 2**8), offset of the anchor from the first start (under 2**8).
def _run(first: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (first << 16) | (n << 8) | (anchor - first)


def _ints(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, key, copy, text: keys ascend with ids; copy marks rows whose whole text an earlier row has, their keys mean nothing."""
    id_key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), id_key.alias("id_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "text")).withColumn("h2", F.xxhash64(F.lit(2), "text"))
    if not rows.groupBy("id_key").count().filter("count > 1").isEmpty():
        return _numbered(rows)
    copied = rows.groupBy("h1", "h2").agg(F.min("id_key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    found = rows.join(bounded(saved(copied, "copied")), ["h1", "h2"], "left")
    copy = F.coalesce(F.col("id_key") > F.col("first"), F.lit(False))
    return found.select("doc_id", F.when(copy, F.xxhash64(F.lit(3), "id_key")).otherwise(F.col("id_key")).alias("key"), "text", copy.alias("copy"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The same where ids are null or repeat: distinct texts are numbered in the order of their first ids, then hashes."""
    firsts = rows.groupBy("h1", "h2").agg(F.min("id_key").alias("first")).orderBy("first", "h1", "h2")
    firsts = saved(firsts.withColumn("nth", F.monotonically_increasing_id()), "firsts")
    rows = rows.join(firsts.hint("merge"), ["h1", "h2"]).withColumn("at", F.monotonically_increasing_id())
    later = F.col("id_key") > F.col("first")
    rows = saved(rows.select("doc_id", F.when(later, -1 - F.col("at")).otherwise(F.col("nth")).alias("key"), "at", "text"), "texts")
    # Equal ids with equal texts: one row stays, the others are copies too.
    equal = saved(rows.filter("key >= 0").groupBy("key").agg(F.min("at").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead"), "equal")
    if not equal.isEmpty():
        key = F.when(F.col("at") > F.col("lead"), -1 - F.col("at")).otherwise(F.col("key"))
        rows = saved(rows.join(bounded(equal), "key", "left").select("doc_id", key.alias("key"), "at", "text"), "texts")
    return rows.select("doc_id", "key", "text", (F.col("key") < 0).alias("copy"))


def _list_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, hashes, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, text in zip(batch["key"], batch["text"], strict=True):
            z, place, first, n = anchors(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
            keys.append(np.full(len(z), k, np.int64))
            hashes.append(z)
            runs.append(_run(first, n, place))
        yield pd.DataFrame({"key": np.concatenate(keys), "z": np.concatenate(hashes), "run": np.concatenate(runs)})


def _list_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of the contexts named by `again`; `local` marks those that the document has before."""
    digest, name = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    for batch in batches:
        keys, runs, deals, digests, local = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], []
        for k, text, again in zip(batch["key"], batch["text"], batch["again"], strict=True):
            raw, seen = text.encode("utf-8", "replace"), set()
            own = np.sort(np.asarray(again, np.int64))
            for run in own.tolist():
                lo, off = run >> 16, run & 255
                d = digest(raw[lo : lo + (run >> 8 & 255) + LENGTH - 1], off)
                local.append(d in seen)
                seen.add(d)
                digests.append(d)
                deals.append(name(raw[lo + off : lo + off + GRAM]))
            keys.append(np.full(len(own), k, np.int64))
            runs.append(own)
        high, low = _ints(digests)
        yield pd.DataFrame({"key": np.concatenate(keys), "run": np.concatenate(runs), "deal": np.array(deals, np.uint64).view(np.int64), "high": high, "low": low, "local": np.array(local, bool)})


def _list_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of the single strings of the runs named by `again`."""
    for batch in batches:
        keys, starts, digests, local = [], [], [], []
        for k, text, again in zip(batch["key"], batch["text"], batch["again"], strict=True):
            raw, seen = text.encode("utf-8", "replace"), set()
            for run in np.sort(np.asarray(again, np.int64)).tolist():
                for at in range(run >> 16, (run >> 16) + (run >> 8 & 255)):
                    d = xxhash.xxh3_128_digest(raw[at : at + LENGTH])
                    keys.append(k)
                    starts.append(at)
                    local.append(d in seen)
                    seen.add(d)
                    digests.append(d)
        high, low = _ints(digests)
        yield pd.DataFrame({"key": np.array(keys, np.int64), "start": np.array(starts, np.int64), "high": high, "low": low, "local": np.array(local, bool)})


def _read_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for k, text, again in zip(batch["key"], batch["text"], batch["again"], strict=True):
            raw = text.encode("utf-8", "replace")
            out += [(k, x["run"] >> 16, x["deal"], raw[x["run"] >> 16 : (x["run"] >> 16) + (x["run"] >> 8 & 255) + LENGTH - 1]) for x in again]
        yield pd.DataFrame(out, columns=["key", "start", "deal", "context"])


def _sort_task(rows: pd.DataFrame) -> pd.DataFrame:
    keys, starts = rows["key"].to_numpy(), rows["start"].to_numpy()
    masks = _repeats(list(rows["context"]), keys, starts)
    out = [(k, s + a, n) for k, s, mask in zip(keys.tolist(), starts.tolist(), masks, strict=True) for a, n in _runs(mask)]
    return pd.DataFrame(out, columns=["key", "start", "n"]).astype("int64")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, copy, gone in zip(batch["text"], batch["copy"], batch["gone"], strict=True):
            raw = text.encode("utf-8", "replace")
            delta = np.zeros(len(raw) + 1, np.int64)
            if copy and len(raw) >= LENGTH:
                delta[0] += 1
            elif gone is not None and not copy:
                for x in gone:
                    delta[x["start"]] += 1
                    delta[x["start"] + x["n"] + LENGTH - 1] -= 1
            mask = np.cumsum(delta)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            spans = [{"start": a, "end": a + n} for a, n in _runs(mask)]
            out.append((kept, spans, len(raw), int(mask.sum()), len(spans), hashlib.sha256(kept).hexdigest()))
        frame = pd.DataFrame(out, columns=["kept", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
        yield frame


def repeated_bytes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), spans (array of start and end, in bytes), n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Strings are judged on the input; overlaps count; none crosses documents. Null text is empty. A null id ranks after
    all others. Rows that share an id, or have none, are documents of their own, in the order of their texts' hashes; of equal
    rows one stays. Other columns are ignored; an empty input gives an empty result. Texts shorter than LENGTH bytes stay whole.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, text_col, id_col)
    distinct = rows.filter("not copy").select("key", "text")
    places = saved(distinct.mapInPandas(releasing(_list_anchors), "key long, z long, run long"), "anchors")
    repeated = saved(places.groupBy("z").agg(F.count("*").alias("n")).filter("n > 1").select("z"), "repeated")
    settle(spark)
    again = saved(places.join(repeated.hint("merge"), "z").groupBy("key").agg(F.collect_list("run").alias("again")), "again")  # a row a document, no longer than its text
    discard(places, repeated)
    settle(spark)

    near = distinct.join(again.hint("merge"), "key").mapInPandas(releasing(_list_contexts), "key long, run long, deal long, high long, low long, local boolean")
    near = saved(near, "contexts")
    discard(again)
    settle(spark)
    # The earliest document with each context; partial sums shrink a common one before the shuffle.
    same = ["deal", "high", "low"]
    best = saved(near.filter("not local").groupBy(*same).agg(F.min("key").alias("first"), F.count("*").alias("n")), "best")
    mixed = saved(best.groupBy("deal").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "mixed")
    judged = best.join(mixed.hint("merge"), "deal", "left").filter("n > 1 or kinds is not null").select(*same, "first", "kinds")
    judged = near.filter("not local").join(judged, same).select("key", "run", "deal", (F.col("key") > F.col("first")).alias("later"), F.coalesce("kinds", F.lit(0)).alias("kinds"))
    judged = saved(judged, "judged")
    as_span = F.col("key"), F.shiftright("run", 16).alias("start"), (F.shiftright("run", 8) % 256).alias("n")
    gone = [saved(near.filter("local").select(*as_span), "local"), judged.filter("later").select(*as_span)]
    discard(best, mixed, near)
    settle(spark)

    rest = judged.filter("not later and kinds > 0")
    sorts = rest.filter(F.col("kinds") <= HOT)
    parts = max(1, -(-int(sorts.agg(F.sum(F.shiftright("run", 8) % 256 + LENGTH)).first()[0] or 0) // TASK_BYTES))
    lists = saved(sorts.groupBy("key").agg(F.collect_list(F.struct("run", "deal")).alias("again")), "lists")
    contexts = distinct.join(lists.hint("merge"), "key").mapInPandas(releasing(_read_contexts), "key long, start long, deal long, context binary")
    dealt = contexts.withColumn("part", F.pmod(F.xxhash64("deal"), F.lit(parts))).groupBy("part")
    gone.append(saved(dealt.applyInPandas(_sort_task, "key long, start long, n long"), "inside"))
    hot = saved(rest.filter(F.col("kinds") > HOT).groupBy("key").agg(F.collect_list("run").alias("again")), "hot")
    if not hot.isEmpty():
        strings = distinct.join(hot.hint("merge"), "key").mapInPandas(releasing(_list_strings), "key long, start long, high long, low long, local boolean")
        strings = saved(strings, "strings")
        first = strings.filter("not local").groupBy("high", "low").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("high", "low", "first")
        later = strings.filter("not local").join(saved(first, "first"), ["high", "low"]).filter("key > first")
        gone += [x.select("key", "start", F.lit(1).cast("long").alias("n")) for x in (strings.filter("local"), later)]
    every = gone[0]
    for part in gone[1:]:
        every = every.unionByName(part)
    spans = saved(every.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("gone")), "gone")
    discard(judged, lists, hot)
    settle(spark)
    schema = "doc_id long, kept binary, spans array<struct<start:long,end:long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.join(spans.hint("merge"), "key", "left").select("doc_id", "text", "copy", "gone").mapInPandas(releasing(_cut), schema)
