"""Exact Jaccard join of word n-gram sets: signature trees inside groups of sets that share part of their content."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crate.llm.near_dedup import components
from crate.llm.workers import releasing
from crate.storage import bounded, discard, saved, settle

WORDS, PERCENT = 4, 85
#: Children of a node of a signature tree, and pairs of nodes that are bounded at once.
FAN, FRONT = 8, 1 << 14
#: Bits of a signature: twice the size of the largest sets of its group, within these limits.
BITS = (64, 4_096)
#: Sets and tokens of a block: those to be linked, and those they meet.
OUT_SETS, OUT_TOKENS = 256, 250_000
MET_SETS, MET_TOKENS = 1_024, 1_000_000
#: Groups of more sets bring the sets themselves to the task that joins them; from smaller ones candidate pairs go to the sets.
SMALL = 24
#: Pairs with one set that share a copy of it.
PAIRS_A_COPY = 256
MEMO_WORDS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct shingles of a UTF-8 text as sorted 64-bit hashes: A-Z in lower case, words between ASCII white space.

    A text of fewer words is one shingle; without words there is none. That two shingles of a pair of texts share a hash has a
    probability of their number squared over 2**64.
    """
    h = np.fromiter(map(_hashes.__getitem__, text.lower().split()), np.uint64)
    n = min(words, len(h))
    if not n:
        return h
    m = len(h) - n + 1
    s = np.full(m, n, np.uint64)
    for k in range(n):
        s = (s ^ h[k : k + m]) * _ODD
        s ^= s >> np.uint64(32)
    return np.unique(_mixed(s))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 times the size of the intersection is at least `percent` times that of the union; never for an empty set."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


@cache
def sizes(percent: int) -> np.ndarray:
    """Largest set of each class of sizes: a set of one class links to none beyond the next."""
    out = [0]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return np.array(out)


def most_apart(top: int, percent: int) -> int:
    """In how many tokens two linked sets differ at most, the smaller of at most `top`."""
    return (100 - percent) * (top + top * 100 // percent) // (100 + percent)


@lru_cache(64)
def _edges(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


def keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of parts of a set's content: two linked, different sets share one at least.

    With the smaller set of class j, linked sets differ in at most k tokens. The range of hashes is cut into S > k parts, so at least
    S - k parts hold the same tokens in both; of the parts in one order that depends on their content alone, the first k + 1 of
    either set then have one in common. Fuller parts come first: they hold several tokens each, which sets that have only a passage
    in common hardly share. A set gives keys as the smaller one of its class and as the larger one of the class below.
    """
    n, tops = len(tokens), sizes(percent)
    out = [np.zeros(0, np.uint64)]
    own = int(np.searchsorted(tops, n))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(tokens * _ODD), dtype=np.uint64)])
    for j in (own, own - 1):
        top = int(tops[max(j, 0)])
        k = most_apart(top, percent)
        if not n or j < 1 or not k or n > top * 100 // percent:
            continue
        parts = k + 1 + (k + 4) // 4
        cuts = np.append(np.searchsorted(tokens, _edges(parts)), n)
        held = np.diff(cuts).astype(np.uint64)
        name = np.arange(parts, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j)
        found = _mixed((running[cuts[1:]] - running[cuts[:-1]]) ^ _mixed(name * _ODD + held))
        out.append(found[np.lexsort((found, -held.astype(np.int64)))[: k + 1]])
    return np.concatenate(out)


def width(n: int, percent: int) -> int:
    """Bits of a signature of a set of n, alike for the sets that share a key but for the class of sizes."""
    return min(max(BITS[0], 1 << int(2 * n).bit_length()), BITS[1])


def signature(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of the tokens, one bit each by hash."""
    out = np.zeros(bits, np.uint8)
    out[(tokens >> np.uint64(7)) & np.uint64(bits - 1)] = 1
    return np.packbits(out).view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Signatures of several widths as those of the least: halves are combined, so each bit still stands for its tokens."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, least), axis=0) for m in maps])


@dataclass
class Tree:
    """Signature tree, leaves first. Node i of a level has the children FAN * i to FAN * i + FAN - 1 of the level below."""

    bitmaps: list[np.ndarray]  # of each level: the combined bitmap of a node's sets
    least: list[np.ndarray]  # their least and greatest size
    most: list[np.ndarray]
    excess: list[np.ndarray]  # the most tokens that one of them has beyond its bits
    labels: list[np.ndarray]  # the class of all of them, or -1

    @property
    def height(self) -> int:
        return len(self.bitmaps)

    def raised(self) -> None:
        """A level above the last one."""
        starts = np.arange(0, len(self.least[-1]), FAN)
        lo, hi = (f.reduceat(self.labels[-1], starts) for f in (np.minimum, np.maximum))
        self.labels.append(np.where(lo == hi, lo, -1))
        self.bitmaps.append(np.bitwise_or.reduceat(self.bitmaps[-1], starts, axis=0))
        self.least.append(np.minimum.reduceat(self.least[-1], starts))
        self.most.append(np.maximum.reduceat(self.most[-1], starts))
        self.excess.append(np.maximum.reduceat(self.excess[-1], starts))


def tree(bitmaps: np.ndarray, n: np.ndarray, labels: np.ndarray) -> Tree:
    """Tree of sets that stand in an order in which like ones are near each other."""
    excess = n - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
    out = Tree([bitmaps], [n], [n], [excess], [labels])
    while len(out.least[-1]) > 1:
        out.raised()
    return out


def traversed(a: Tree, b: Tree, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of a and of b that may be linked and are of different classes.

    Pairs of nodes go down together. A pair is dropped if no two sets below it can have enough in common: at most the bits that both
    bitmaps have, and the tokens beyond their bits, and no more than the smaller one's size; or if all below are of one class.
    """
    while a.height < b.height:
        a.raised()
    while b.height < a.height:
        b.raised()
    todo = [(a.height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > FRONT:
            todo += [(level, i[k : k + FRONT], j[k : k + FRONT]) for k in range(0, len(i), FRONT)]
            continue
        common = np.bitwise_count(a.bitmaps[level][i] & b.bitmaps[level][j]).sum(axis=1, dtype=np.int64)
        common += np.minimum(a.excess[level][i], b.excess[level][j])
        common = np.minimum(common, np.minimum(a.most[level][i], b.most[level][j]))
        own, other = a.labels[level][i], b.labels[level][j]
        keep = (common * (100 + percent) >= percent * (a.least[level][i] + b.least[level][j])) & ((own != other) | (own == -1))
        i, j = i[keep], j[keep]
        if not level:
            yield i, j
        elif len(i):
            child = np.arange(FAN)
            x, y = (FAN * i[:, None] + child), (FAN * j[:, None] + child)
            x, y = np.repeat(x, FAN, axis=1).ravel(), np.tile(y, (1, FAN)).ravel()
            there = (x < len(a.least[level - 1])) & (y < len(b.least[level - 1]))
            todo.append((level - 1, x[there], y[there]))


def joined(rows: pd.DataFrame, percent: int = PERCENT) -> tuple[list, list]:
    """Pairs of a group, each of a set that is out and one that isn't: candidates (nodes), or links (labels) where tokens are given.

    Where tokens are given candidates are compared at once, as few as connect the same classes.
    """
    of, trees = [], []
    maps = folded([np.frombuffer(x, np.uint64) for x in rows["bitmap"]])
    n, labels, out = rows["n"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), rows["out"].to_numpy(bool)
    for side in (out, ~out):
        at = np.flatnonzero(side)
        if not len(at):
            return [], []
        at = at[np.lexsort((*maps[at].T[:4], n[at], labels[at]))]
        of.append(at)
        trees.append(tree(maps[at], n[at], labels[at]))
    nodes, tokens = rows["node"].to_numpy(), rows["tokens"].to_numpy()
    left, right, root = [], [], {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in traversed(*trees, percent):
        i, j = of[0][i], of[1][j]
        other = nodes[i] != nodes[j]
        i, j = i[other], j[other]
        if tokens[0] is None:
            left += nodes[i].tolist()
            right += nodes[j].tolist()
            continue
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(labels[x]), find(labels[y])
            if a != b and linked(np.frombuffer(tokens[x], np.uint64), np.frombuffer(tokens[y], np.uint64), percent):
                root[a] = b
                left.append(int(labels[x]))
                right.append(int(labels[y]))
    return left, right


def _traversals(placed: DataFrame, percent: int) -> DataFrame:
    """a, b from joined() of each (bucket, i, j), which come to a task one after the other: many groups are small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def result() -> Iterator[pd.DataFrame]:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            name = rows[["bucket", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]).any(axis=1)])
            left, right = [], []
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                x, y = joined(rows.iloc[a:b], percent)
                left += x
                right += y
            yield pd.DataFrame({"a": left, "b": right}, dtype="int64")

        for batch in batches:
            if not len(batch):
                continue
            name = batch[["bucket", "i", "j"]].to_numpy()
            cut = int((name != name[-1]).any(axis=1).sum())  # rows before the last group, which may go on
            if cut:
                held.append(batch.iloc[:cut])
                yield from result()
                held = [batch.iloc[cut:]]
            elif held and (held[-1][["bucket", "i", "j"]].to_numpy()[-1] != name[-1]).any():
                yield from result()
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from result()

    order = ["bucket", "i", "j"]
    return placed.repartition(*order).sortWithinPartitions(*order).mapInPandas(releasing(run), "a long, b long")


def _blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Groups (bucket, node, label, n, out) dealt to blocks by hash and joined: no task holds more of a group than a block's bounds.

    The tokens go along in groups of more than SMALL sets; from smaller ones candidates come, as pairs of nodes.
    """
    out = F.when(F.col("out"), F.col("n"))
    shape = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"), F.count(out).alias("m_out"), F.sum(out).alias("tokens_out"))
    blocks = lambda n, tokens, most, most_tokens: F.ceil(F.greatest(F.col(n) / most, F.coalesce(tokens, F.lit(0)) / most_tokens)).cast("int")
    shape = saved(shape.select("bucket", blocks("m_out", "tokens_out", OUT_SETS, OUT_TOKENS).alias("outs"), blocks("m", "tokens", MET_SETS, MET_TOKENS).alias("mets")), "shape")
    placed = members.join(bounded(shape), "bucket").join(sets.hint("merge"), "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "i", "j", "node", "n", "label", "bitmap", "tokens"]
    left = placed.filter("out").withColumn("i", deal("outs")).withColumn("j", each("mets")).select(*columns, F.lit(True).alias("out"))
    right = placed.withColumn("j", deal("mets")).withColumn("i", each("outs")).select(*columns, F.lit(False).alias("out"))
    return _traversals(left.unionByName(right), percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that are linked; a set in many pairs is copied for each PAIRS_A_COPY of them."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    salted = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    firsts = sets.join(copies.withColumnRenamed("a", "node"), "node").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    firsts = firsts.select(F.col("node").alias("a"), "copy", F.col("tokens").alias("x"))
    both = salted.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b").join(firsts.hint("merge"), ["a", "copy"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return both.select("a", "b", "x", "y").mapInPandas(releasing(run), "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two documents link when the Jaccard similarity of their sets of word n-grams is at least `percent` of a hundred; every such link
    counts, exactly. A document of fewer words is one shingle; without words or text it links with nothing. Null ids rank last, and a
    component of null ids only has a null component_id. Rows that repeat an id are documents of their own, which link by their own texts.
    Other columns are ignored, whatever their names. An empty input gives an empty result.

    Equal sets are one node. Nodes that share a key (see keys()) are a group; of groups with the same members one is left. In each group
    the node with most company is first joined with all others, then, where several classes are left, every node outside the largest
    one with all of the group. Both joins traverse two signature trees (see traversed()), block by block in large groups.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"), text.cast("binary").alias("data"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["data"]:
                found = shingles(bytes(data), words)
                own = [int(_mixed(found ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) for salt in (0, 0x5851F42D4C957F2D)]
                out.append((len(found), *own, keys(found, percent).view(np.int64)))
            frame = pd.DataFrame(out, columns=["n", "s1", "s2", "keys"])
            yield pd.concat([batch[["row", "doc_id", "h1", "h2"]].astype({"doc_id": "Int64"}).reset_index(drop=True), frame], axis=1)

    numbered = keyed.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "h1", "h2", "data")
    signed = saved(numbered.mapInPandas(releasing(sign, forget), "row long, doc_id long, h1 long, h2 long, n long, s1 long, s2 long, keys array<long>"), "sets")
    nodes = signed.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("node"))
    rows = saved(signed.select("row", "doc_id", "n", "s1", "s2").join(nodes, ["s1", "s2", "n"], "left").select("row", "doc_id", "n", F.coalesce("node", "row").alias("node")), "rows")
    copies = saved(rows.filter("row <> node").select("row"), "copies")
    distinct = signed.join(bounded(copies), "row", "left_anti").withColumnRenamed("row", "node")

    everyone = distinct.select("node", F.explode("keys").alias("bucket"))
    shared = everyone.withColumn("m", F.count("*").over(Window.partitionBy("bucket"))).filter("m > 1")
    shared = saved(shared, "shared")  # all keys move once, most of them have one node; what is left of them is small
    name = [F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"f{salt}") for salt in (1, 2)]
    groups = shared.groupBy("bucket").agg(F.count("*").alias("m"), *name)
    buckets = saved(groups.groupBy("m", "f1", "f2").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    members = saved(shared.join(bounded(buckets), "bucket"), "members")
    weight = saved(members.groupBy("node").agg(F.sum("m").alias("weight")), "weights")
    wanted = saved(distinct.select("node", "h1", "h2", "n").join(bounded(weight), "node"), "wanted")
    texts = keyed.join(bounded(wanted.select("node", "h1", "h2", "n")), ["h1", "h2"]).groupBy("node").agg(F.first("data").alias("data"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(bytes(data), words) for data in batch["data"]]
            maps = [signature(x, width(len(x), percent)).tobytes() for x in found]
            yield pd.DataFrame({"node": batch["node"], "bitmap": maps, "tokens": [x.tobytes() for x in found]})

    sets = saved(texts.mapInPandas(releasing(whole, forget), "node long, bitmap binary, tokens binary"), "tokens")
    discard(signed, copies, shared, buckets, weight)
    settle(docs.sparkSession)
    bare = sets.select("node", "bitmap", F.lit(None).cast("binary").alias("tokens"))
    members = saved(members.join(bounded(wanted.select("node", "n", "weight")), "node"), "marked")
    leaders = saved(members.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("leader")), "leaders")
    led = members.join(bounded(leaders), "bucket").select("bucket", "node", "n", F.col("node").alias("label"), (F.col("node") == F.col("leader")).alias("out"))
    known = saved(_ordered(_blocks(led, bare, percent)), "pairs")
    edges = saved(_verified(known, sets, percent), "links")

    settle(docs.sparkSession)
    labels = components(edges)
    placed = saved(members.join(bounded(labels), "node", "left").select("bucket", "m", "node", "n", F.coalesce("label", "node").alias("label")), "placed")
    shares = saved(placed.groupBy("bucket", "label").agg(F.count("*").alias("held")), "shares")
    most = shares.groupBy("bucket").agg(F.count("*").alias("parts"), F.max("held").alias("most")).filter("parts > 1")
    main = saved(shares.join(most, "bucket").filter("held = most").groupBy("bucket").agg(F.min("label").alias("main")), "main")
    split = saved(placed.filter("m > 2").join(bounded(main), "bucket").withColumn("out", F.col("label") != F.col("main")), "split")
    discard(members, placed, shares, main, labels)
    few = _ordered(_blocks(split.filter(F.col("m") <= SMALL), bare, percent))
    fresh = saved(few.join(known, ["a", "b"], "left_anti"), "pairs")
    more = saved(_verified(fresh, sets, percent), "links")
    blocks = saved(_blocks(split.filter(F.col("m") > SMALL), sets, percent), "blocks")
    labels = components(edges.unionByName(more).unionByName(blocks))
    discard(split, sets, known)
    settle(docs.sparkSession)

    out = saved(rows.join(bounded(labels), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("label")), "classes")
    first = saved(out.groupBy("label").agg(F.min("doc_id").alias("component_id")), "first")
    return out.join(first, "label").select("doc_id", "n_shingles", "component_id")
