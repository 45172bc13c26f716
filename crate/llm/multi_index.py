"""Approximate nearest neighbours over an inverted multi-index: two codebooks, one for each half of a vector."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crate.llm.workers import releasing
from crate.storage import saved

#: Vectors that the codebooks are fitted on, and centroids of each half, at most.
SAMPLE_VECTORS, CENTROIDS = 20_000, 64
#: Recall that the visited share of the index is calibrated for, and queries of the sample used for that.
TARGET_RECALL, CALIBRATION_QUERIES = 0.95, 200
#: Entries of a block and queries of a group: what one task holds at a time. Queries of a traversal task, and of a product.
BLOCK_ROWS, GROUP_QUERIES = 8_192, 4_096
WALK_QUERIES, PRODUCT_QUERIES = 128, 256


@dataclass
class Codebooks:
    dims: int
    halves: tuple[np.ndarray, np.ndarray]
    share: float  # of all entries that a query visits at least

    @property
    def side(self) -> int:
        return max(len(h) for h in self.halves)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row: the nearest centroid of either half."""
        found = [_nearest(part, c) for part, c in zip(self.split(x), self.halves, strict=True)]
        return found[0] * self.side + found[1]

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.dims // 2], x[:, self.dims // 2 :]

    def visited(self, q: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
        """Cells in order of the summed distance of their centroid pair, until they hold `least` entries.

        A half's distance is the negative inner product. A heap walks the grid of sorted centroids: a pair enters
        once the pair before it on either axis has left.
        """
        distances = [-(part @ c.T) for part, c in zip(self.split(q[None]), self.halves, strict=True)]
        order = [np.argsort(d[0], kind="stable") for d in distances]
        a, b = (d[0][o].tolist() for d, o in zip(distances, order, strict=True))
        names = [o.tolist() for o in order]
        reached = [0] * len(a)  # pairs (i, 0 .. reached[i] - 1) have left
        heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
        while heap and held < least:
            _, i, j = heapq.heappop(heap)
            cell = names[0][i] * self.side + names[1][j]
            reached[i] = j + 1
            if n := int(counts[cell]):
                out.append(cell)
                held += n
            if i + 1 < len(a) and reached[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 15) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centroids)
        sizes = np.bincount(near, minlength=len(centroids))
        for d in range(x.shape[1]):
            sums = np.bincount(near, x[:, d], len(centroids))
            centroids[:, d] = np.where(sizes > 0, sums / np.maximum(sizes, 1), centroids[:, d])
    return centroids


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed in the order of the dimensions: equal vectors score equally."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def best_in_block(held: pd.DataFrame, queries: pd.DataFrame, k: int, n_cells: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k best entries of the opened cells of a block for each query, ties to smaller ids.

    held: vec_id, cell, v; queries: query_id, q, cells (those opened). Only opened cells are multiplied. Products choose the entries
    that may be among the best, rounding allowed for; their scores are then summed in one order.
    """
    held = held.sort_values(["cell", "vec_id"], kind="stable")
    x = np.frombuffer(b"".join(held["v"]), float).reshape(len(held), -1)
    ids = held["vec_id"].to_numpy()
    names, first = np.unique(held["cell"].to_numpy(), return_index=True)
    ends, slot = np.append(first[1:], len(x)), np.full(n_cells, len(names))
    slot[names] = np.arange(len(names))
    longest = float(np.sqrt((x * x).sum(axis=1).max()))
    by_id, out = np.argsort(ids, kind="stable"), []
    for a in range(0, len(queries), PRODUCT_QUERIES):
        part = queries.iloc[a : a + PRODUCT_QUERIES]
        own, q = part["query_id"].to_numpy(), np.frombuffer(b"".join(part["q"]), float).reshape(len(part), -1)
        opened = np.zeros((len(part), len(names) + 1), bool)
        for i, raw in enumerate(part["cells"]):
            opened[i, slot[np.frombuffer(raw, "<i4")]] = True
        scores = np.full((len(part), len(x)), -np.inf)
        for j, (s, e) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
            who = np.flatnonzero(opened[:, j])
            scores[who, s:e] = q[who] @ x[s:e].T
        lo, hi = (np.searchsorted(ids, own, side, sorter=by_id) for side in ("left", "right"))
        for i in np.flatnonzero(hi > lo):
            scores[i, by_id[lo[i] : hi[i]]] = -np.inf
        floor = np.partition(scores, -k, axis=1)[:, -k] if len(x) > k else np.full(len(part), -np.inf)
        floor = floor - 1e-12 * q.shape[1] * longest * np.sqrt((q * q).sum(axis=1))
        row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        exact = inner(q[row], x[col])
        order = np.lexsort((ids[col], -exact, row))
        nth = np.arange(len(row)) - np.searchsorted(row, row)  # row ascends
        at = order[nth < k]
        out.append(pd.DataFrame({"query_id": own[row[at]], "vec_id": ids[col[at]], "score": exact[at]}))
    return pd.concat(out, ignore_index=True)


def valid(vectors: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """vec_id and v (array<double>) of the rows that take part: id and components not null, finite, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, k: int, seed: int = 5) -> Codebooks | None:
    """Codebooks from at most SAMPLE_VECTORS rows of valid(), by hash of id; None if there are none.

    The share of entries to visit is the least that finds TARGET_RECALL of the exact neighbours within the sample.
    """
    few = rows.orderBy(F.xxhash64(F.lit("codebooks"), "vec_id"), "vec_id").limit(SAMPLE_VECTORS).toPandas()
    if not len(few):
        return None
    sizes = few["v"].map(len)
    dims = int(sizes.mode().iloc[0])
    x = np.array(few["v"][sizes == dims].tolist(), dtype=float)
    rng = np.random.default_rng(seed)
    cut = max(1, dims // 2)
    k_half = min(CENTROIDS, max(2, int(np.sqrt(len(x)))))
    halves = tuple(_kmeans(p, k_half, rng) if p.shape[1] else np.zeros((1, 0)) for p in (x[:, :cut], x[:, cut:]))
    books = Codebooks(dims, halves, 1.0)
    if dims < 2 or len(x) < 4 * k:
        return books
    near = [_nearest(p, c) for p, c in zip(books.split(x), halves, strict=True)]
    probes = rng.choice(len(x), min(CALIBRATION_QUERIES, len(x)), replace=False)
    places = []
    for i in probes:
        scores = x @ x[i]
        scores[i] = -np.inf
        top = np.argpartition(-scores, k)[:k]
        d = [-(p[i] @ c.T) for p, c in zip(books.split(x), halves, strict=True)]
        cost = d[0][near[0]] + d[1][near[1]]
        places += [(cost < cost[t]).mean() for t in top]
    books.share = float(min(1.0, np.quantile(places, TARGET_RECALL) + 0.02))
    return books


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product that each query finds.

    is_query is a condition on vec_id. Every valid row is indexed and a candidate but rows with the query's own id; ties go to
    the smaller id. Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows without an id
    and vectors of another length than most. If fewer candidates than k exist, all are returned. Rows that repeat an id are separate
    candidates, but one query: that of the vector whose bytes are least. Other columns are ignored; an empty input gives an empty result.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, vec_col, id_col)
    books = fit(rows, k)
    names = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], names)
    shared = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["v"].map(len) == shared.value.dims]
            x = np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), shared.value.dims)
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "cell": shared.value.cells(x).astype("int32"), "v": [r.tobytes() for r in x]})

    index = saved(rows.mapInPandas(releasing(place), "vec_id long, cell int, v binary"), "index")
    counts = np.zeros(books.side**2, "int64")
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most CENTROIDS**2 rows
        counts[r["cell"]] = r["n"]
    least = max(int(np.ceil(books.share * counts.sum())), 4 * k)
    # Neighbouring cells share a block; a cell of more rows than a block holds is dealt to several by hash.
    first, salts, block, room = np.zeros(len(counts), "int64"), np.ones(len(counts), "int64"), 0, BLOCK_ROWS
    for c in np.flatnonzero(counts):
        n = int(counts[c])
        if n > room:
            block, room = block + (room < BLOCK_ROWS), BLOCK_ROWS
        first[c] = block
        if n > BLOCK_ROWS:
            salts[c] = -(-n // BLOCK_ROWS)
            block += int(salts[c])
        else:
            room -= n
    layout = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(counts), dtype="int32"), "first": first, "salts": salts}))
    blocks = index.join(F.broadcast(layout), "cell").select("vec_id", "cell", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("salts"))).alias("block"))

    asked = saved(index.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    n_asked = asked.count()
    groups = max(1, -(-n_asked // GROUP_QUERIES))
    tables = spark.sparkContext.broadcast((counts, first, salts))

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, first, salts = tables.value
        for batch in batches:
            out = []
            for query_id, raw, group in zip(batch["vec_id"], batch["v"], batch["group"], strict=True):
                cells = shared.value.visited(np.frombuffer(raw), counts, least)
                by_block: dict[int, list[int]] = {}
                for c in cells:
                    for b in range(first[c], first[c] + salts[c]):
                        by_block.setdefault(b, []).append(c)
                out += [(b, group, query_id, raw, np.array(cs, "<i4").tobytes()) for b, cs in by_block.items()]
            yield pd.DataFrame(out, columns=["block", "group", "query_id", "q", "cells"])

    group = F.pmod(F.xxhash64(F.lit("group"), "vec_id"), F.lit(groups)).alias("group")
    visits = asked.select("vec_id", "v", group).repartition(max(1, -(-n_asked // WALK_QUERIES)), "vec_id").mapInPandas(releasing(traverse), "block long, group long, query_id long, q binary, cells binary")
    entries = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def rerank(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(held) and len(queries):
            return best_in_block(held, queries, k, len(counts))
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": float})

    partial = entries.groupBy("block", "group").cogroup(visits.groupBy("block", "group")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
