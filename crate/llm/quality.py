"""Quality classifier: a factorisation machine over hashed words, structure statistics and size metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crate.llm.workers import releasing

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 8_000
WORD_BITS, RANK, EPOCHS = 14, 8, 12
MEMO_WORDS = 500_000
#: The decision threshold of `predicted`; scores are shifted so that the best cut of the fitting sample is there.
THRESHOLD = 0.3

SIGNS = "|*#$%&!?.,;:=<>{}[]()@/\\_-+\"'"
N_STATS = 12 + len(SIGNS)
SIZE = (1 << WORD_BITS) + N_STATS


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)
        return found


_buckets = _Buckets()


def forget() -> None:
    _buckets.clear()


def statistics(text: str, words: list[str]) -> np.ndarray:
    """Size metadata first, then shares of kinds of characters and of repetition."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n, w = max(len(raw), 1), max(len(words), 1)
    lines = text.split("\n")
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    shares = [counts[ord(c)] / w for c in SIGNS]
    return np.array(
        [
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
            min(n / w, 40), upper / n * 10, lower / n * 4, digits / n * 10, counts[128:].sum() / n * 4,
            len(set(words)) / w * 4, len(set(lines)) / len(lines) * 4, min(w / len(lines), 200) / 20, min(max(map(len, words), default=0), 100) / 10,
            *np.minimum(np.array(shares) * 4, 8),
        ]
    )


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights (log counts, unit length) and the raw statistics of a whole text."""
    words = (text or "").split()
    ids, counts = np.unique(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    x = np.log1p(counts)
    return ids, x / max(np.sqrt((x * x).sum()), 1e-12), statistics(text or "", words)


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    shift: float = 0.0

    def row(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, x, stats = found
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        return np.concatenate([ids, np.arange(SIZE - N_STATS, SIZE)]), np.concatenate([x, z])

    def logit(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Pairwise terms in linear time: half of (sum of v x) squared less the sum of (v x) squared."""
        ids, x = self.row(found)
        vx = self.factors[ids] * x[:, None]
        return float(self.bias + self.linear[ids] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(features(text)) + self.shift, -30, 30))))


def fit(rows: list[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]], seed: int = 7) -> Machine:
    """Logistic loss by Adam over mini-batches; a sixth of the rows is set apart to place the threshold.

    Without rows nothing is learned: the machine scores every text 0.5.
    """
    if not rows:
        return Machine(np.zeros(N_STATS), np.ones(N_STATS), 0.0, np.zeros(SIZE), np.zeros((SIZE, RANK)))
    stats = np.array([f[2] for f, _ in rows])
    scale = stats.std(axis=0)
    rng = np.random.default_rng(seed)
    m = Machine(stats.mean(axis=0), np.where(scale < 1e-6, 1, scale), 0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    apart = [r for i, r in enumerate(rows) if i % 6 == 5] or rows
    used = [(*m.row(f), y) for i, (f, y) in enumerate(rows) if i % 6 != 5] or [(*m.row(f), y) for f, y in rows]
    p = min(max(np.mean([y for *_, y in used]), 0.01), 0.99)
    m.bias = float(np.log(p / (1 - p)))
    params = [np.array([m.bias]), m.linear, m.factors]
    first, second, t = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(used))
        for a in range(0, len(order), 128):
            batch = [used[i] for i in order[a : a + 128]]
            ids, x = np.concatenate([b[0] for b in batch]), np.concatenate([b[1] for b in batch])
            y = np.array([b[2] for b in batch], float)
            sizes = np.array([len(b[0]) for b in batch])
            doc, starts = np.repeat(np.arange(len(batch)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = params[2][ids] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            z = params[0][0] + np.add.reduceat(params[1][ids] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(batch)
            gx = g[doc] * x
            by_factor = gx[:, None] * (sums[doc] - vx)
            grads = [
                np.array([g.sum()]),
                np.bincount(ids, gx, SIZE) + 1e-5 * params[1],
                np.stack([np.bincount(ids, by_factor[:, k], SIZE) for k in range(RANK)], axis=1) + 1e-5 * params[2],
            ]
            t += 1
            for k, grad in enumerate(grads):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                params[k] -= 0.02 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    m.bias, m.linear, m.factors = float(params[0][0]), params[1], params[2]
    z, y = np.array([m.logit(f) for f, _ in apart]), np.array([y for _, y in apart])
    if 0 < y.sum() < len(y):
        cuts = np.unique(np.quantile(z, np.linspace(0.001, 0.999, 400)))
        gain = [((z >= c) & (y == 1)).sum() / y.sum() + ((z < c) & (y == 0)).sum() / (1 - y).sum() for c in cuts]
        best = cuts[np.flatnonzero(np.array(gain) >= max(gain) - 1e-9)]
        m.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - best[len(best) // 2])
    return m


def fitting_sample(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> list:
    """Features of at most `rows` labelled documents, by hash of the id. Null labels and unknown ids are left out."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    few = named.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "ids": [a.astype("<i4").tobytes() for a, _, _ in every], "x": [b.astype("<f4").tobytes() for _, b, _ in every], "stats": [c.astype("<f8").tobytes() for *_, c in every]})

    got = found.mapInPandas(releasing(run, forget), "doc_id long, label int, ids binary, x binary, stats binary").orderBy("doc_id", "ids").collect()
    return [((np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float), np.frombuffer(r["stats"], "<f8")), int(r["label"])) for r in got]


def scored(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs and quality_score, 0 to 1, higher: label 1 likelier. Whole texts are read; a null text scores as an empty one.

    Each row is scored by its text alone, so repeated ids and other columns don't matter; a column of this name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for batch in batches:
            yield pd.Series([m.score(t) for t in batch], dtype=float)

    return docs.withColumn("quality_score", F.pandas_udf(releasing(score, forget), "double")(F.col(text_col)))
