"""Similarity joins: every query against every item in blocks, top k by cosine."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crate.functions.vectors import EPS, doubles
from crate.storage import bounded, saved

#: Rows of either side that one task holds where items are in cells; the number of tasks grows with both.
BLOCK_ITEMS, BLOCK_QUERIES = 8_192, 2_048
#: Bytes of vectors of either side that one task holds where all pairs are scored, pairs that a task is worth, and tasks that are enough for these.
HELD_BYTES, TASK_PAIRS, ENOUGH = 32_000_000, 8_000_000, 64
#: Scores that a task holds at once.
HELD_SCORES = 2_000_000
#: From so many items on they are kept in cells, and a query opens only those that may hold one of its k best. Same results.
CELLS_FROM = 50_000
#: Cells are used if a sample of so many queries opens at most this share of all pairs; else all pairs are scored, which moves fewer rows.
SAMPLE, SHARE = 256, 0.2
#: Cells at most: the root of the number of items, up to this.
CELLS = 1_024
#: What rounding of scores and of angles may hide.
SLACK = 4e-6


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 decimals, halves away from zero: ranks then don't hang on float noise."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def _unit(raw: pd.Series) -> np.ndarray:
    x = np.array(raw.tolist(), dtype=float)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n < EPS, 0.0, x / np.maximum(n, EPS))


def _blocks(df: DataFrame, key: str, rows: int, n: int) -> tuple[DataFrame, int]:
    n = max(1, -(-n // rows))
    return df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def dealt(queries: int, items: int, dims: int) -> tuple[int, int]:
    """Into how many blocks queries and items are dealt so that a task holds one of each, enough tasks share the pairs, and few rows are copied."""
    held = max(1_024, HELD_BYTES // (8 * max(dims, 1)))
    nq, ni = max(1, -(-queries // held)), max(1, -(-items // held))
    enough = min(ENOUGH, -(-queries * items // TASK_PAIRS))
    while nq * ni < enough:
        nq, ni = (nq + 1, ni) if items < queries else (nq, ni + 1) if queries < items or ni < nq else (nq + 1, ni)
    return nq, ni


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _padded(raw: pd.Series, sizes: np.ndarray, dims: int) -> np.ndarray:
    """Unit vectors of that length; zeros for vectors of another, which score 0."""
    out, same = np.zeros((len(raw), dims)), sizes == dims
    if same.any():
        out[same] = _unit(raw[same])
    return out


@dataclass
class Cells:
    """Unit vectors that items are nearest to, with how many items each has and the widest angle to one of them.

    Items of another length than these vectors, and those without length, are in a last cell that every query opens.
    """

    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = unit @ self.centres.T
        at = s.argmax(axis=1)
        return at, np.arccos(np.clip(s[np.arange(len(at)), at], -1, 1))

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The highest score that an item of each cell can have: by the triangle inequality on angles."""
        apart = np.arccos(np.clip(unit @ self.centres.T, -1, 1)) - self.radii
        return np.cos(np.maximum(apart - 1e-7, 0)) + SLACK

    def blocks(self) -> list[list[int]]:
        """Blocks of BLOCK_ITEMS for each cell: large cells have several, small ones share one."""
        out, block, room = [], 0, BLOCK_ITEMS
        for n in self.sizes.tolist():
            if n > room:
                block, room = block + 1, BLOCK_ITEMS
            parts = max(1, -(-n // BLOCK_ITEMS))
            out.append([block + k for k in range(parts)])
            block, room = (block, room - n) if parts == 1 else (block + parts, BLOCK_ITEMS)
        return out


@dataclass
class Known:
    """What the first of several searches of the same items leaves to the others: their number and length, and their cells (none if all pairs are scored)."""

    size: tuple[int, int] | None = None
    celled: tuple[DataFrame, Cells] | tuple[()] | None = None


def _units(raw: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of vectors of that length that have one, and their unit vectors."""
    at = np.flatnonzero(raw.map(len).to_numpy() == dims)
    if not len(at):
        return at, np.zeros((0, dims))
    unit = _unit(raw.iloc[at])
    some = (unit != 0).any(axis=1)
    return at[some], unit[some]


def celled(items: DataFrame, n: int) -> tuple[DataFrame, Cells]:
    """items (v and others) with their cell, saved, and the cells. Centres are items drawn by hash: any centres give the same results."""
    share = min(CELLS, int(np.ceil(np.sqrt(n)))) / max(n, 1)
    drawn = items.filter(F.pmod(F.xxhash64(F.lit("centre"), "item_id"), F.lit(1 << 30)) < int(2 * share * (1 << 30)) + 1).select("v")
    drawn = [r["v"] for r in drawn.limit(2 * CELLS).collect()]  # at most 2 * CELLS vectors
    dims = Counter(map(len, drawn)).most_common(1)[0][0] if drawn else 0
    centres = np.unique(_units(pd.Series([v for v in drawn if len(v) == dims], dtype=object), dims)[1], axis=0)[:CELLS] if dims else np.zeros((0, 0))
    cells = Cells(centres, np.zeros(len(centres)), np.zeros(len(centres)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, angle = np.full(len(batch), len(cells.centres)), np.zeros(len(batch))
            if len(batch) and len(cells.centres):
                at, unit = _units(batch["v"], cells.centres.shape[1])
                if len(at):
                    cell[at], angle[at] = cells.nearest(unit)
            yield batch.assign(cell=cell.astype("int32"), angle=angle)

    schema = ", ".join(f"{c} {kind}" for c, kind in items.dtypes) + ", cell int, angle double"
    rows = saved(items.mapInPandas(place, schema), "cells")
    sizes, radii = np.zeros(len(centres) + 1), np.zeros(len(centres))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # a row a cell
        sizes[r["cell"]] = r["n"]
        if r["cell"] < len(centres):
            radii[r["cell"]] = r["angle"]
    return rows.drop("angle"), Cells(centres, sizes, radii)


def opened(queries: DataFrame, cells: Cells, k: int, kth: str | None) -> DataFrame:
    """queries with `cells`, those to open: without kth the likeliest ones that have k items together, with kth (a column) the others that can beat it."""
    wanted = k + 1  # the query itself may be one of them

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, dims = len(cells.centres), cells.centres.shape[1] if len(cells.centres) else -1
        sizes = np.append(cells.sizes[:-1], 0)  # the last cell's items are nobody's nearest
        for batch in batches:
            bounds = np.full((len(batch), last + 1), np.inf)
            at, unit = _units(batch["q"], dims) if len(batch) and last else ([], None)
            if len(at):
                bounds[at, :last] = cells.bounds(unit)
            out = []
            for i, b in enumerate(bounds):
                order = np.argsort(-b, kind="stable")
                first = int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1
                if kth is None:
                    out.append(order[:first])
                else:
                    at_least = batch[kth].iat[i]
                    rest = order[first:]
                    out.append(rest if pd.isna(at_least) else rest[b[rest] >= at_least])
            yield batch.assign(cells=[x.astype("int32") for x in out])

    schema = ", ".join(f"{c} {kind}" for c, kind in queries.dtypes) + ", cells array<int>"
    return queries.mapInPandas(choose, schema)


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str = "query_id",
    item_id: str = "item_id",
    query_vec: str = "vector",
    item_vec: str = "vector",
    skip_same_id: bool = True,
    floor: float | None = None,
    group: str | None = None,
    apart: tuple[str, float] | None = None,
    prefer: str | None = None,
    known: Known | None = None,
) -> DataFrame:
    """query_id, item_id, score, rank: the k items most like each query, by rounded cosine, ties to the smaller id.

    Both sides are dealt to blocks; a task scores one block against another with a matrix product and keeps its k best of each
    query, a window keeps the k best of all. From CELLS_FROM items on these are kept in cells around some of them: a query first opens
    the likeliest cells that have k items, then all others that its k-th score doesn't rule out. Null vectors take no part; vectors of another length than the query's
    score 0, as those without length do. floor drops lower scores. With `group`, a column of items, only the best
    item of each group counts (the smaller id on ties). apart, a column of both sides and a limit: pairs whose values differ by
    more don't count, null passes. prefer, a column of both sides: items with the query's value come before all others.
    known: what searches of the same items with the same options, whatever k, share.
    """
    extra = lambda c, kind, name: (F.col(c) if c else F.lit(None)).cast(kind).alias(name)
    near, limit = apart or (None, 0.0)
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), doubles(F.col(query_vec)).alias("q"), extra(near, "double", "at"), extra(prefer, "string", "kind")).filter("q is not null")
    items = items.select(F.col(item_id).cast("long").alias("item_id"), doubles(F.col(item_vec)).alias("v"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("grp"), extra(near, "double", "at"), extra(prefer, "string", "kind")).filter("v is not null")
    known = known or Known()
    if known.size is None:
        known.size = tuple(items.agg(F.count("*"), F.max(F.size("v"))).first())
    n, dims = known.size
    asks = q.count()
    ranked = lambda part: _ranked(part, k, group)
    options = (k, skip_same_id, floor, near, limit, prefer, group)

    def in_blocks(q: DataFrame, asks: int) -> DataFrame:
        nq, ni = dealt(asks, n, dims or 0)
        left = q.select("query_id", "q", "at", "kind", _block("query_id", nq).alias("qb"), _each(ni).alias("ib"), F.lit(None).cast("array<int>").alias("cells"))
        right = items.select("item_id", "v", "grp", "at", "kind", F.lit(0).alias("cell"), _block("item_id", ni).alias("ib"), _each(nq).alias("qb"))
        return ranked(_scored(left, right, options))

    def beaten(q: DataFrame, found: DataFrame) -> DataFrame:
        """q with the score that an item must reach: kth."""
        least = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        more = q.join(least, "query_id", "left")
        return more.withColumn("kth", F.greatest("kth", F.lit(float(floor)))) if floor is not None else more

    out = None
    if n >= CELLS_FROM and not prefer:  # with prefer nothing can be ruled out: an item of the query's kind comes before better ones
        if known.celled is None:
            rows, cells = celled(items, n)
            few = saved(q.orderBy(F.xxhash64(F.lit("sample"), "query_id")).limit(SAMPLE), "sample")
            known.celled = (rows, cells) if opened_share(beaten(few, in_blocks(few, SAMPLE)), cells, k, n) <= SHARE else ()
        if known.celled:
            rows, cells = known.celled
            q, _ = _blocks(q, "query_id", BLOCK_QUERIES, asks)
            places = F.array(*[F.array(*[F.lit(b) for b in own]) for own in cells.blocks()])
            own = F.get(places, F.col("cell"))
            rows = rows.withColumn("ib", F.get(own, F.pmod(F.xxhash64("item_id"), F.size(own)).cast("int")))

            def asked(chosen: DataFrame) -> DataFrame:
                blocks = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.get(places, c))))
                left = saved(chosen.select("query_id", "q", "at", "kind", F.col("_block").alias("qb"), "cells", F.explode(blocks).alias("ib")), "asked")
                met = saved(left.select("qb", "ib").distinct(), "met")
                return _scored(left, rows.join(bounded(met), "ib"), options)

            first = saved(asked(opened(q, cells, k, None)), "first")
            out = ranked(first.unionByName(asked(opened(beaten(q, ranked(first)), cells, k, "kth"))))
    if out is None:
        out = in_blocks(q, asks)
    return out.select("query_id", "item_id", "score", "rank", *(["grp"] if group else []))


def opened_share(queries: DataFrame, cells: Cells, k: int, n: int) -> float:
    """The share of all pairs that queries (query_id, q, kth) score in cells."""
    sizes = F.array(*[F.lit(int(x)) for x in cells.sizes])
    load = lambda kth: opened(queries, cells, k, kth).select(F.explode("cells").alias("c")).agg(F.sum(F.get(sizes, F.col("c")))).first()[0] or 0
    return (load(None) + load("kth")) / max(1, queries.count() * n)


def _ranked(part: DataFrame, k: int, group: str | None) -> DataFrame:
    best = [F.desc("same"), F.desc("score"), F.col("item_id")]
    if group:
        part = part.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "grp").orderBy(*best))).filter("n = 1").drop("n")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= k)


def _scored(left: DataFrame, right: DataFrame, options: tuple) -> DataFrame:
    """query_id, item_id, score, grp, same: the k best of each query in each block, of the cells that it opens (null: all)."""
    k, skip_same_id, floor, near, limit, prefer, group = options

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> list[tuple]:
        """Of each query its k best among vs: queries, ids, scores, groups, of their kind.

        Scores in single precision leave those that may be among the k best, with room for their error; these are scored in double precision.
        """
        out, need = [], k
        if group:
            vs = vs.sort_values("grp", kind="stable")
        ids, groups, places = vs["item_id"].to_numpy(), vs["grp"].to_numpy(), vs["at"].to_numpy(dtype=float)
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        by_id, sizes, wide = np.argsort(ids, kind="stable"), vs["v"].map(len).to_numpy(), qs["q"].map(len).to_numpy()
        kinds, names = pd.factorize(vs["kind"])
        for d in np.unique(wide):
            unit = _padded(vs["v"], sizes, d)
            fine, mine = unit.astype("float32"), np.flatnonzero(wide == d)
            slack = 2 * (d + 8) * 6e-8 * (5 if prefer else 1) + 2e-6
            step = max(1, HELD_SCORES // len(ids))
            for start in range(0, len(mine), step):
                part = qs.iloc[mine[start : start + step]]
                u, query = _unit(part["q"]), part["query_id"].to_numpy()
                s = u.astype("float32") @ fine.T
                same, unsure = np.zeros((len(part), 1), bool), None
                if prefer:
                    own = pd.Index(names, dtype=object).get_indexer(part["kind"])[:, None]
                    same = (kinds[None] == own) & (own >= 0)
                    unsure = s < floor + slack if floor is not None else None  # an item of the query's kind that the floor drops rules no other out
                    s += 4 * same
                if near:
                    s[np.abs(places[None] - part["at"].to_numpy(dtype=float)[:, None]) > limit] = -np.inf
                if skip_same_id:
                    lo, hi = np.searchsorted(ids, query, "left", by_id), np.searchsorted(ids, query, "right", by_id)
                    while len(own := np.flatnonzero(lo < hi)):
                        s[own, by_id[lo[own]]] = -np.inf
                        lo += 1
                least = np.full(len(part), -10.0)
                width = len(starts) if group else max(need, min(len(ids), 16 * need))
                if need <= width <= len(ids) and (group or len(ids) >= width):
                    # The need-th greatest of the groups' (or of some strips') best scores is no more than the need-th score.
                    sure = s if unsure is None else np.where(unsure, np.float32(-np.inf), s)
                    tops = np.maximum.reduceat(sure, starts, axis=1) if group else sure[:, : len(ids) // width * width].reshape(len(part), -1, width).max(axis=1)
                    least = np.maximum(least, np.partition(tops, width - need, axis=1)[:, width - need] - slack)
                if floor is not None:
                    least = np.maximum(least, floor - slack)
                r, c = np.divmod(np.flatnonzero(s >= least[:, None].astype("float32")), len(ids))
                if len(r) * 16 > s.size:  # many alike
                    exact = (u @ unit.T)[r, c]
                else:
                    piece = max(1, HELD_SCORES // max(d, 1))
                    exact = np.concatenate([np.einsum("ij,ij->i", u[r[i : i + piece]], unit[c[i : i + piece]]) for i in range(0, len(r), piece)] or [np.zeros(0)])
                value, alike = rounded(exact), same[r, c] if prefer else np.zeros(len(r), bool)
                order = np.lexsort((ids[c], -value, ~alike, r))
                if floor is not None:
                    order = order[value[order] >= floor]
                if group:
                    key = np.unique(np.stack([r[order], groups[c[order]]]), axis=1, return_index=True)[1]
                    order = order[np.sort(key)]
                row = r[order]
                order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
                r, c = r[order], c[order]
                out.append((query[r], ids[c], value[order], groups[c], alike[order]))
        return out

    def score(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(qs) and qs["cells"].iat[0] is not None:
            opens = [set(map(int, c)) for c in qs["cells"]]
            for cell, held in vs.groupby("cell"):
                own = qs[[cell in c for c in opens]]
                if len(own):
                    found += best(own, held)
        elif len(qs) and len(vs):
            found = best(qs, vs)
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[]] * 5
        frame = pd.DataFrame(dict(zip(["query_id", "item_id", "score", "grp", "same"], columns, strict=True)))
        return frame.astype({"query_id": "int64", "item_id": "int64", "score": float, "grp": "int64", "same": bool})

    return left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(score, "query_id long, item_id long, score double, grp long, same boolean")


def pairs_scored(queries: DataFrame, items: DataFrame, k: int) -> tuple[int, int]:
    """How many pairs top_k() scores in cells, and how many there are: queries (query_id, vector), items (item_id, vector)."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), doubles(F.col("vector")).alias("q")).filter("q is not null")
    rows, n = items.select(F.col("item_id").cast("long").alias("item_id"), doubles(F.col("vector")).alias("v")).filter("v is not null"), items.count()
    _, cells = celled(rows, n)
    least = top_k(queries, items, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    total = q.count() * n
    return round(opened_share(q.join(least, "query_id", "left"), cells, k, n) * total), total


def pairs_with_small(items: DataFrame, small: DataFrame, score: Column, most: int = 20_000) -> DataFrame:
    """All pairs of items with a small table, with `score`: broadcast while it has at most `most` rows, else left to Spark."""
    return items.crossJoin(F.broadcast(small) if small.count() <= most else small).withColumn("score", score)


def calibrated(queries: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """query_id, item_id, z: how far each score (rounded cosine) is above the mean of its query's, in their population spread; rows of z >= least.

    Queries (query_id, vector) and items (item_id, vector) meet in blocks twice: for the sums of each query's scores, then for the rows that
    pass. Scores are whole millionths, so their sums are exact in any order. Null vectors take no part; vectors of different lengths and those without length score 0.
    """
    q = queries.select("query_id", doubles(F.col("vector")).alias("q")).filter("q is not null")
    v = items.select("item_id", doubles(F.col("vector")).alias("v")).filter("v is not null")
    n, dims = v.agg(F.count("*"), F.max(F.size("v"))).first()
    nq, ni = dealt(q.count(), n, dims or 0)
    right = v.select("item_id", "v", _block("item_id", ni).alias("ib"), _each(nq).alias("qb"))

    def met(q: DataFrame, f: Callable, schema: str) -> DataFrame:
        left = q.select("*", _block("query_id", nq).alias("qb"), _each(ni).alias("ib"))
        return left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(f, schema)

    def millionths(qs: pd.DataFrame, vs: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Some queries, their rounded scores as whole numbers."""
        sizes, wide = vs["v"].map(len).to_numpy(), qs["q"].map(len).to_numpy()
        for d in np.unique(wide) if len(vs) else ():
            unit, mine = _padded(vs["v"], sizes, d), qs[wide == d]
            step = max(1, HELD_SCORES // len(vs))
            for start in range(0, len(mine), step):
                part = mine.iloc[start : start + step]
                s = _unit(part["q"]) @ unit.T
                low = s < 0
                np.abs(s, out=s)
                s *= 1e6
                s += 0.5
                whole = s.astype("int64")
                np.negative(whole, out=whole, where=low)
                yield part, whole

    def sums(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        rows = [pd.DataFrame({"query_id": part["query_id"].to_numpy(), "n": s.shape[1], "s": s.sum(axis=1), "ss": np.einsum("ij,ij->i", s, s)}) for part, s in millionths(qs, vs)]
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "n": [], "s": [], "ss": []}, dtype="int64")

    def passing(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        rows, ids = [pd.DataFrame({"query_id": [], "item_id": [], "z": []}).astype({"query_id": "int64", "item_id": "int64", "z": float})], vs["item_id"].to_numpy()
        for part, s in millionths(qs, vs):
            m, spread = part["m"].to_numpy()[:, None], part["d"].to_numpy()[:, None]
            r, c = np.nonzero(s >= 1e6 * (m + (least - 2e-6) * spread) - 1)
            z = (s[r, c] / 1e6 - m[r, 0]) / spread[r, 0]
            rows.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[r], "item_id": ids[c], "z": z}))
        return pd.concat(rows)

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("decimal(38,0)").alias(c)
    stat = met(q, sums, "query_id long, n long, s long, ss long").groupBy("query_id").agg(total("n"), total("s"), total("ss"))
    spread = F.sqrt((F.col("n") * F.col("ss") - F.col("s") * F.col("s")).cast("double")) / F.col("n").cast("double") / 1e6
    mean = F.col("s").cast("double") / F.col("n").cast("double") / 1e6
    stat = saved(stat.select("query_id", mean.alias("m"), F.when(spread > 0, spread).otherwise(1.0).alias("d")), "calibration")
    found = met(q.join(bounded(stat), "query_id"), passing, "query_id long, item_id long, z double")
    return found.withColumn("z", F.round("z", 6)).filter(F.col("z") >= least)
