"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crate.llm.workers import releasing
from crate.storage import bounded, discard, saved, settle

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Words in at least this share of all documents have their own inverse document frequency; rarer ones have that of this
#: share. There are at most (mean distinct words of a document) / RARE such words, however many documents there are.
RARE = 1e-3
#: Pairs of buckets of more nodes are compared block by block. Nodes and code points of a block: those to be linked, and those they meet.
SMALL = 24
OUT_NODES, OUT_CHARS = 256, 2_000_000
MET_NODES, MET_CHARS = 1_024, 8_000_000
#: Standard deviations of the signature's estimate beyond which a candidate pair is ruled out: one pair in ten million at the threshold.
DEVIATIONS = 5.6
MEMO_WORDS, FLUSH_WORDS = 200_000, 1_000_000
TABLE = 1 << 13
#: Vectors that a Python worker keeps while it verifies pairs.
VECTORS = 1_000
BLOCK = 1_024
#: Columns of the matrices that blocks are multiplied in, at a time.
COLUMNS = 4_096
#: Pairs with one leader that share a copy of its text.
PAIRS_A_COPY = 256

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class _Hashes(dict):
    def __missing__(self, chunk: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[chunk] = found = xxhash.xxh3_64_intdigest((chunk.strip(_EDGE) or chunk).encode("utf-8", "replace"))
        return found


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words between white space, lower case, without signs at their ends."""
    words = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


@dataclass
class Idf:
    """1 for a word in every document, rising with the log of rarity to 2 at RARE and below."""

    words: np.ndarray
    values: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), 2.0)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.values[at], 2.0)


def shingles(text: str | None, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, how often each occurs, and the mean idf of its words.

    A text of fewer words than a shingle has is one shingle; without words there is none.
    """
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    n = min(WORDS, len(h))
    if not n:
        return h, np.zeros(0), np.zeros(0)
    m = len(h) - n + 1
    rare, s, w = idf.of(h), np.full(m, n, np.uint64), np.zeros(m)
    for k in range(n):
        s = (s ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
        w += rare[k : k + m]
    found, first, counts = np.unique(s, return_index=True, return_counts=True)
    return found, counts, w[first] / n


def vector(text: str | None, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and their weights: occurrences times the mean idf of the words."""
    found, counts, each = shingles(text, idf)
    return found, counts * each


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater; 0 if both are empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    common = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return float(common / whole) if whole > 0 else 0.0


@cache
def _draws() -> tuple[np.ndarray, ...]:
    """r, 1 / r and log c with r and c gamma(2, 1), and beta, uniform, for each sample; and room to work in.

    Three parts of a shingle's hash choose its rows of r, of c and of beta, so that two shingles hardly ever share all draws.
    """
    rng, shape = np.random.default_rng(20_150_801), (TABLE, BANDS * ROWS)
    r, c, beta = rng.gamma(2, 1, shape), rng.gamma(2, 1, shape), rng.random(shape)
    tables = [x.astype(np.float32) for x in (r, 1 / r, np.log(c), beta)]
    return (*tables, *[np.empty((BLOCK, BANDS * ROWS), np.float32) for _ in range(4)])


def samples(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hashes of consistent weighted samples: the probability that two vectors share one is their weighted Jaccard similarity.

    With q = log(weight) / r + beta and its floor t, the sample is the shingle, and its t, of the least
    log c - r (t - beta + 1), which is log c - log(weight) + r (q - t - 1).
    """
    r, inverse, c, beta, *room = _draws()
    k = BANDS * ROWS
    best, which, level = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.float32)
    logs, low, every = np.log(weights).astype(np.float32)[:, None], np.uint64(TABLE - 1), np.arange(k)
    row, row_c, row_beta = ((found >> np.uint64(shift) & low).astype(np.intp) for shift in (0, 14, 28))
    for a in range(0, len(found), BLOCK):
        at = slice(a, a + BLOCK)
        n = len(found[at])
        rs, q, other, t = (x[:n] for x in room)
        np.take(r, row[at], axis=0, out=rs, mode="clip")
        np.take(inverse, row[at], axis=0, out=q, mode="clip")
        np.take(beta, row_beta[at], axis=0, out=other, mode="clip")
        q *= logs[at]
        q += other
        np.floor(q, out=t)
        q -= t
        q -= 1
        q *= rs
        q += np.take(c, row_c[at], axis=0, out=other, mode="clip")
        q -= logs[at]
        low_at = q.argmin(axis=0)
        value = q[low_at, every]
        less = value < best
        best[less], which[less], level[less] = value[less], found[a + low_at[less]], t[low_at[less], every[less]]
    out = (which ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def bits(hashes: np.ndarray, each: int) -> np.ndarray:
    """Some bits of each hash, in 64-bit integers."""
    places = np.arange(3, 3 + 8 * each, 8, dtype=np.uint64)[:, None]
    return np.packbits((hashes[None, :] >> places) & np.uint64(1), axis=1).view(np.int64).ravel()


def bands(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash for each band of samples, then two integers that hold two bits of each sample."""
    drawn = samples(found, weights)
    of = drawn.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = (out ^ of[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.concatenate([out.view(np.int64), bits(drawn, 2)])


def bits_apart(threshold: float) -> int:
    """In how many of the bits two texts at the threshold may differ: the mean and DEVIATIONS standard deviations."""
    n, unlike = BANDS * ROWS, 1 - threshold
    return int(np.ceil(n * unlike + DEVIATIONS * np.sqrt(n * unlike * (1.5 - unlike))))


def _alike(threshold: float) -> Column:
    """Whether the signatures x, y and u, v may belong to texts at the threshold."""
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("u"))) + F.bit_count(F.col("y").bitwiseXOR(F.col("v")))
    return apart <= bits_apart(threshold)


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, 128 bits of hash of the text, and the text; null is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"), "text")


def _frequent(rows: DataFrame) -> Idf:
    """Document frequencies of all words over all documents; those of at least RARE come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, held, keys = 0, np.zeros(0, np.uint64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([*keys, held[:0]])
            return np.unique(every, return_counts=True)

        size = 0
        for batch in batches:
            docs += len(batch)
            for text in batch["text"]:
                if text:
                    keys.append(np.unique(word_hashes(text)))
                    size += len(keys[-1])
                    if size > FLUSH_WORDS:
                        words, n = merged()
                        yield pd.DataFrame({"word": words.view(np.int64), "n": n})
                        keys, size = [], 0
        words, n = merged()
        yield pd.DataFrame({"word": words.view(np.int64), "n": n})
        yield pd.DataFrame({"word": pd.array([None], "Int64"), "n": [docs]})

    counts = rows.select("text").mapInPandas(releasing(count, forget), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(counts, "words")
    total = counts.filter("word is null").agg(F.sum("n")).first()[0] or 0
    got = counts.filter(F.col("word").isNotNull() & (F.col("n") >= RARE * total)).toPandas()
    discard(counts)
    words = got["word"].to_numpy("int64").view(np.uint64)
    order = np.argsort(words)
    share = np.minimum(got["n"].to_numpy(float) / max(total, 1), 1.0)
    return Idf(words[order], (1 + np.log(1 / np.maximum(share, RARE)) / np.log(1 / RARE))[order])


def _verified(pairs: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """a, b of the pairs whose weighted Jaccard similarity reaches the threshold, from whole texts."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    salted = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    leaders = texts.join(copies.withColumnRenamed("a", "node"), "node").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    leaders = leaders.select(F.col("node").alias("a"), "copy", F.col("text").alias("text_a"))
    # Merge joins at every size: texts are not for broadcasting.
    both = salted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").join(leaders.hint("merge"), ["a", "copy"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # In a large group of copies a text is in many pairs: some vectors are kept, by text.
        of = lru_cache(VECTORS)(lambda text: vector(text, shared.value))
        for batch in batches:
            keep = np.array([weighted_jaccard(of(a), of(b)) >= threshold for a, b in zip(batch["text_a"], batch["text_b"], strict=True)], bool)
            yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(releasing(run, forget), "a long, b long")


def similarities(left: list[tuple[np.ndarray, ...]], right: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Weighted Jaccard similarity of each of `left` with each of `right`, given what shingles() finds.

    The c-th occurrence of a shingle is a column of its own with the shingle's idf as its weight: the sum of the lesser weights
    is then a product of two matrices of zeros and ones.
    """

    def entries(side: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        counts = np.concatenate([c for _, c, _ in side] or [np.zeros(0)]).astype(np.int64)
        row = np.repeat(np.repeat(np.arange(len(side)), [len(f) for f, _, _ in side]), counts)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        name = np.repeat(np.concatenate([f for f, _, _ in side] or [np.zeros(0, np.uint64)]), counts) ^ (nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return row, name, np.repeat(np.concatenate([w for *_, w in side] or [np.zeros(0)]), counts)

    row_l, name_l, weight = entries(left)
    row_r, name_r, _ = entries(right)
    both = np.intersect1d(name_l, name_r)
    at_l, at_r = np.searchsorted(both, name_l), np.searchsorted(both, name_r)
    hit_l, hit_r = (np.r_[both, np.uint64(0)][at] == name for at, name in ((at_l, name_l), (at_r, name_r)))
    hit_l &= at_l < len(both)
    hit_r &= at_r < len(both)
    row_l, at_l, weight, row_r, at_r = row_l[hit_l], at_l[hit_l], weight[hit_l], row_r[hit_r], at_r[hit_r]
    common = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(both), COLUMNS):
        b = min(a + COLUMNS, len(both))
        in_l, in_r = (at_l >= a) & (at_l < b), (at_r >= a) & (at_r < b)
        x, y = np.zeros((len(left), b - a), np.float32), np.zeros((b - a, len(right)), np.float32)
        x[row_l[in_l], at_l[in_l] - a] = weight[in_l]
        y[at_r[in_r] - a, row_r[in_r]] = 1
        common += x @ y
    sums = [np.array([float((c * w).sum()) for _, c, w in side]) for side in (left, right)]
    whole = sums[0][:, None] + sums[1][None, :] - common
    return np.where(whole > 0, common / np.where(whole > 0, whole, 1), 0.0)


def _block(rows: pd.DataFrame, idf: Idf, threshold: float) -> pd.DataFrame:
    """a, b: labels that the links between the nodes of a block to be linked and those they meet join, as few as connect the same."""
    left, right = rows[rows["out"]], rows[~rows["out"]]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    of_left, of_right = ([shingles(t, idf) for t in side["text"]] for side in (left, right))
    found = similarities(of_left, of_right)
    own, met = left["label"].to_numpy(), right["label"].to_numpy()
    apart = own[:, None] != met[None, :]
    for i, j in np.argwhere(apart & (np.abs(found - threshold) < 1e-4)):  # too near for single precision
        (s, c, w), (t, d, v) = of_left[i], of_right[j]
        found[i, j] = threshold + (1 if weighted_jaccard((s, c * w), (t, d * v)) >= threshold else -1)
    i, j = np.nonzero(apart & (found >= threshold))
    links = np.unique(np.sort(np.stack([own[i], met[j]], axis=1), axis=1), axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    tree = []
    for a, b in links.tolist():
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree.append((a, b))
    return pd.DataFrame(tree, columns=["a", "b"]).astype("int64")


def _linked_blocks(split: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """a, b: links between labels of large buckets (bucket, node, label, size, out), every node that is out compared with the bucket.

    Both sides are dealt to blocks by hash, so that a task holds a bounded number of nodes and code points of any bucket.
    """
    out = F.when(F.col("out"), F.col("size"))
    shape = split.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("chars"), F.count(out).alias("n_out"), F.sum(out).alias("chars_out"))
    blocks = lambda n, chars, most, most_chars: F.ceil(F.greatest(F.col(n) / most, F.coalesce(chars, F.lit(0)) / most_chars)).cast("int")
    shape = saved(shape.select("bucket", blocks("n_out", "chars_out", OUT_NODES, OUT_CHARS).alias("outs"), blocks("n", "chars", MET_NODES, MET_CHARS).alias("mets")), "shape")
    placed = split.join(bounded(shape), "bucket").join(texts.hint("merge"), "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "label", "text", "i", "j"]
    left = placed.filter("out").withColumn("i", deal("outs")).withColumn("j", each("mets")).select(*columns, F.lit(True).alias("out"))
    right = placed.withColumn("j", deal("mets")).withColumn("i", each("outs")).select(*columns, F.lit(False).alias("out"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _block(rows, shared.value, threshold)

    return left.unionByName(right).groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component, for the nodes that edges (a, b) name."""
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = saved(lower.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            discard(both)
            return labels


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept, h1, h2 (hashes of the text).

    A class is a connected component of the links between texts that share a band and whose weighted Jaccard similarity
    reaches the threshold; exact copies are together always. class_id is the smallest doc_id in it. `kept` marks one
    row of each class: of those with that doc_id, the one with the least hashes. Texts without words link to exact copies only; null
    counts as empty. Null ids rank last; a class of null ids only has a null class_id. Rows repeated with id and text are rows of
    their own in class_size, and one is kept. Other columns are ignored; an empty input gives an empty result.

    Each node (a distinct text) is first compared with a leader of each of its buckets: the node that shares most buckets, weighted
    by their sizes, which in a group of edits is the text nearest to all. What that links is a class, and isn't compared again. Where a
    bucket still holds several classes, every node outside its largest one is compared with all of the bucket: pair by pair in
    buckets of up to SMALL nodes, where signatures that differ too much rule pairs out first, and block by block beyond that, where
    a task multiplies whole vectors and returns only which classes are linked. No pair of a bucket is passed over.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, text_col, id_col)
    shared = spark.sparkContext.broadcast(_frequent(keyed))

    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                found, weights = vector(t, shared.value)
                out.append(bands(found, weights) if len(found) else np.zeros(0, np.int64))
            yield pd.Series(out)

    sampled = F.pandas_udf(releasing(sign, forget), "array<bigint>")
    signed = saved(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h1", "h2", F.length("text").alias("size"), sampled("text").alias("bands")), "signatures")
    # A node is a distinct text, named by one of its rows.
    nodes = signed.groupBy("h1", "h2").agg(F.min("row").alias("node"))
    rows = saved(signed.select("row", "doc_id", "h1", "h2").join(nodes, ["h1", "h2"]), "rows")
    copies = saved(rows.filter("row <> node").select("row"), "copies")
    distinct = signed.join(bounded(copies), "row", "left_anti").withColumnRenamed("row", "node")

    everyone = distinct.select("node", F.explode(F.slice("bands", 1, BANDS)).alias("bucket"))
    buckets = saved(everyone.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = saved(everyone.join(bounded(buckets), "bucket"), "members")
    weight = saved(members.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    marks = F.get("bands", F.lit(BANDS)).alias("x"), F.get("bands", F.lit(BANDS + 1)).alias("y")
    wanted = saved(distinct.select("node", "h1", "h2", "size", *marks).join(bounded(weight), "node"), "wanted")
    texts = keyed.join(bounded(wanted.select("node", "h1", "h2")), ["h1", "h2"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = saved(texts, "texts")
    discard(signed, copies, buckets, weight)
    settle(spark)
    members = saved(members.join(bounded(wanted.select("node", "size", "weight", "x", "y")), "node"), "marked")
    leaders = saved(members.groupBy("bucket").agg(F.max_by("node", "weight").alias("leader")), "leaders")
    led = leaders.join(bounded(wanted.select(F.col("node").alias("leader"), F.col("x").alias("u"), F.col("y").alias("v"))), "leader")
    known = members.join(led, "bucket").filter((F.col("node") != F.col("leader")) & _alike(threshold))
    known = saved(known.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    edges = saved(_verified(known, texts, shared, threshold), "links")

    settle(spark)
    labels = components(edges)
    placed = saved(members.join(bounded(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    shares = saved(placed.groupBy("bucket", "label").agg(F.count("*").alias("held")), "shares")
    most = shares.groupBy("bucket").agg(F.count("*").alias("parts"), F.max("held").alias("most")).filter("parts > 1")
    main = saved(shares.join(most, "bucket").filter("held = most").groupBy("bucket").agg(F.min("label").alias("main")), "main")
    split = saved(placed.join(bounded(main), "bucket").withColumn("out", F.col("label") != F.col("main")), "split")
    discard(members, placed, shares, main, labels)
    few = split.filter(F.col("n") <= SMALL)
    heads = few.filter("out").select("bucket", F.col("node").alias("a"), F.col("label").alias("own"), F.col("x").alias("u"), F.col("y").alias("v"))
    met = heads.join(few.withColumnRenamed("node", "b"), "bucket").filter((F.col("label") != F.col("own")) & _alike(threshold))
    seen = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
    more = saved(_verified(saved(fresh, "pairs"), texts, shared, threshold), "links")
    blocks = saved(_linked_blocks(split.filter(F.col("n") > SMALL), texts, shared, threshold), "blocks")
    labels = components(edges.unionByName(more).unionByName(blocks))
    discard(split, texts, known)
    settle(spark)

    out = saved(rows.join(bounded(labels), "node", "left").select("row", "doc_id", "h1", "h2", F.coalesce("label", "node").alias("label")), "classes")
    sizes = saved(out.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "sizes")
    first = out.join(sizes, "label").filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min(F.struct("h1", "h2", "row")).alias("first"))
    chosen = saved(sizes.join(first, "label").select("label", "class_id", "class_size", F.col("first.row").alias("first")), "chosen")
    return out.join(chosen, "label").select("doc_id", "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept"), "h1", "h2")


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class that near_groups() finds; columns and row contents are unchanged.

    Only the keys of what goes are joined back, so that texts stay where they are while these are few.
    """
    names = docs.columns
    text_col, id_col = f"c{names.index(text_col)}", f"c{names.index(id_col)}"
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])  # own helpers can't meet a column of the same name
    keys = near_groups(docs, text_col, id_col, threshold).groupBy("doc_id", "h1", "h2").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("copies"))
    keys = saved(keys.filter("not stays or copies > 1").toDF("_id", "_h1", "_h2", "_stays", "_copies"), "dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"_k1": F.xxhash64(F.lit(1), text), "_k2": F.xxhash64(F.lit(2), text)})
    on = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2"))
    gone, repeated = keys.select("_id", "_h1", "_h2"), saved(keys.filter("_stays").select("_id", "_h1", "_h2"), "repeated")
    single = keyed.join(bounded(gone), on, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return single.toDF(*names)
    nth = F.row_number().over(Window.partitionBy(id_col, "_k1", "_k2").orderBy(*[F.col(c) for c in docs.columns if c != text_col]))
    return single.unionByName(keyed.join(bounded(repeated), on, "left_semi").withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns)).toDF(*names)
