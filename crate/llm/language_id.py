"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crate.llm.workers import releasing

ORDER = 4
#: Bounds of the sample that the models are fitted on: whole documents of a language, and their code points together.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 2_000_000
#: Code points scored at a time: bounds a task's memory for texts of any length.
BLOCK = 1 << 16
#: A document is rejected if its cross-entropy is above this quantile of the sample's, plus the margin in nats a character and
#: SHORT over the root of its length: the mean over few characters scatters more.
QUANTILE, MARGIN, SHORT = 0.999, 0.35, 6.0

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd: multiplication permutes the 64-bit integers


@cache
def _folding() -> np.ndarray:
    """Code point -> lower-case letter; 32 for all that is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def folded(text: str) -> np.ndarray:
    """Lower-case letters of a text, runs of anything else as one space, a space at both ends; empty without letters."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = _folding()[cps]
    gap = letters == 32
    keep = np.ones(len(letters), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    out = letters[keep]
    if not len(out) or (len(out) == 1 and out[0] == 32):
        return out[:0]
    return np.concatenate([[32] * int(out[0] != 32), out, [32] * int(out[-1] != 32)]).astype(np.uint32)


def grams(chars: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams; place i is the one that starts at i."""
    h = np.zeros(max(0, len(chars) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ chars[k : k + len(h)].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Models:
    """log-probabilities of all languages side by side: row i of logp[n] belongs to keys[n][i], keys sorted.

    backoff[n] has, for the contexts of n characters, the log of the weight that a language leaves to shorter contexts.
    """

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    limits: np.ndarray
    sharpness: float

    def losses(self, chars: np.ndarray) -> np.ndarray:
        """Summed negative log-probability of each character after the first, by language."""
        total = np.zeros(len(self.langs))
        for a in range(0, max(len(chars) - 1, 0), BLOCK):
            b = min(a + BLOCK, len(chars) - 1)
            lo = max(0, a + 1 - (ORDER - 1))
            total -= self._block(chars[lo : b + 1], a + 1 - lo)
        return total

    def _block(self, chars: np.ndarray, first: int) -> np.ndarray:
        """Sum of log-probabilities of chars[first:] given what stands before each in chars."""
        at = np.arange(first, len(chars))
        full = at >= ORDER - 1
        out = np.zeros(len(self.langs))
        todo = np.concatenate([at[full], at[~full]])
        n_full, n = int(full.sum()), ORDER
        add = np.zeros((0, len(self.langs)), np.float32)
        pending, weight = todo[:n_full], None
        late = todo[n_full:]  # the first characters: only shorter contexts exist
        while n >= 1:
            if n < ORDER and len(late):
                fit = late >= n - 1
                pending = np.concatenate([pending, late[fit]])
                weight = np.concatenate([weight if weight is not None else add, np.zeros((int(fit.sum()), len(self.langs)), np.float32)])
                late = late[~fit]
            if weight is None:
                weight = np.zeros((len(pending), len(self.langs)), np.float32)
            if len(pending):
                keys = self.keys[n]
                h = grams(chars, n)[pending - (n - 1)]
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[place] == h
                found = np.take(self.logp[n], place[hit], axis=0)
                out += np.ones(len(found), np.float32) @ found
                if n < ORDER:
                    out += weight[hit].sum(axis=0, dtype=np.float64)
                pending, weight = pending[~hit], weight[~hit]
                if n == 1:
                    out += (self.logp[0][0] + weight).sum(axis=0, dtype=np.float64)
                elif len(pending):
                    contexts = self.contexts[n - 1]
                    h = grams(chars, n - 1)[pending - (n - 1)]
                    place = np.minimum(np.searchsorted(contexts, h), len(contexts) - 1)
                    weight = weight + np.where((contexts[place] == h)[:, None], self.backoff[n - 1][place], 0)
            n -= 1
        return out


def _smoothed(texts: dict[str, list[np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney: below the highest order, counts are of distinct characters that come before."""
    langs = sorted(texts)
    per_order: list[dict] = [{} for _ in range(ORDER + 1)]
    for lang in langs:
        seqs = texts[lang]
        known = {}
        for n in range(ORDER, 0, -1):
            parts = [(grams(s, n), grams(s, n - 1)[: max(0, len(s) - n + 1)] if n > 1 else np.zeros(len(s), np.uint64), grams(s[1:], n - 1) if n > 1 else np.zeros(len(s), np.uint64)) for s in seqs if len(s) >= n]
            gram = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
            prefix = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint64)])
            suffix = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.uint64)])
            keys, where, count = np.unique(gram, return_index=True, return_counts=True)
            known[n] = (keys, prefix[where], suffix[where], count)
        for n in range(1, ORDER + 1):
            keys, prefix, suffix, count = known[n]
            if n < ORDER:  # in how many distinct ways the n-gram continues another character
                above = known[n + 1][2]
                s, c = np.unique(above, return_counts=True)
                at = np.minimum(np.searchsorted(s, keys), max(len(s) - 1, 0))
                count = np.where((s[at] == keys), c[at], 1) if len(s) else np.ones(len(keys), int)
            ones, twos = int((count == 1).sum()), int((count == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, inverse = np.unique(prefix, return_inverse=True)
            total = np.bincount(inverse, weights=count, minlength=len(ctx)) if len(ctx) else np.zeros(0)
            kinds = np.bincount(inverse, minlength=len(ctx)) if len(ctx) else np.zeros(0)
            left = discount * kinds / np.maximum(total, 1)
            own = np.maximum(count - discount, 0) / np.maximum(total[inverse], 1)
            per_order[n][lang] = (keys, own, suffix, inverse, ctx, left)
    alphabet = max(2, len(np.unique(np.concatenate([per_order[1][lang][0] for lang in langs]))) + 1)
    keys, logp, contexts, backoff = [np.zeros(1, np.uint64)], [np.full((1, len(langs)), -np.log(alphabet), np.float32)], [np.zeros(1, np.uint64)], [np.zeros((1, len(langs)), np.float32)]
    floor = np.log(1.0 / alphabet)
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([per_order[n][lang][0] for lang in langs]))
        ctxs = np.unique(np.concatenate([per_order[n][lang][4] for lang in langs]))
        suffix_of, prefix_of = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
        for lang in langs:
            k, _, suffix, inverse, ctx, _ = per_order[n][lang]
            at = np.searchsorted(every, k)
            suffix_of[at], prefix_of[at] = suffix, ctx[inverse] if len(ctx) else 0
        table, gone = np.zeros((len(every), len(langs)), np.float32), np.zeros((len(ctxs), len(langs)), np.float32)
        for j, lang in enumerate(langs):
            k, own, _, _, ctx, left = per_order[n][lang]
            p = np.zeros(len(every))
            p[np.searchsorted(every, k)] = own
            rest = np.ones(len(ctxs))
            rest[np.searchsorted(ctxs, ctx)] = np.maximum(left, 1e-9)
            if n == 1:
                p += rest[0] / alphabet
            else:
                p += rest[np.searchsorted(ctxs, prefix_of)] * np.exp(logp[n - 1][np.searchsorted(keys[n - 1], suffix_of), j])
            table[:, j], gone[:, j] = np.log(p), np.log(rest)
        keys.append(every)
        logp.append(table)
        if n == 1:  # a character never seen: what the unigrams leave, spread over the alphabet
            logp[0] = (gone[:1] + floor).astype(np.float32)
        contexts[n - 1 :] = [ctxs]
        backoff[n - 1 :] = [gone]
    return Models(langs, keys, logp, contexts, backoff, np.full(len(langs), np.inf), 1.0)


def fit(rows: list[tuple[str, str]]) -> Models | None:
    """Models of (lang, text) rows; None if no row has letters. A fifth of a language's rows is held back to calibrate limits and score.

    A language of fewer than five rows has no held text: it takes the widest limit of the others, or none if there is none.
    """
    held, used, seen = {}, {}, {}
    for lang, text in rows:
        if len(chars := folded(text)):
            seen[lang] = seen.get(lang, 0) + 1
            (held if seen[lang] % 5 == 0 else used).setdefault(lang, []).append(chars)
    if not used:
        return None
    models = _smoothed(used)
    gaps = []
    for j, lang in enumerate(models.langs):
        means = []
        for chars in held.get(lang, ()):
            loss = models.losses(chars) / max(len(chars) - 1, 1)
            means.append(loss[j])
            rest = np.delete(loss, j)
            if len(rest) and len(chars) > 20:
                gaps.append(rest.min() - loss[j])
        if means:
            models.limits[j] = np.quantile(means, QUANTILE) + MARGIN
    known = models.limits[np.isfinite(models.limits)]
    if len(known):
        models.limits[~np.isfinite(models.limits)] = known.max()
    models.sharpness = float(np.log(99) / max(np.median(gaps), 1e-3)) if gaps else 1.0  # the median gap scores 0.99
    return models


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(lang, whole text) of at most per_lang documents a language, by lowest hashes of their ids, up to `chars` code points; one document at least.

    Rows without a language or a text take no part; a table without others gives an empty list.
    """
    texts = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.xxhash64(F.lit("language"), F.col(id_col).cast("long"), F.length(text_col))
    named = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("o"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    share = F.least(F.lit(1.0), F.lit(1.1 * per_lang) / F.col("n"))
    few = named.join(F.broadcast(sizes), "lang").filter(F.pmod("o", F.lit(1 << 40)) < share * F.lit(float(1 << 40)))
    by_hash = Window.partitionBy("lang").orderBy("o", "text")  # about per_lang rows a language
    few = few.select("lang", "text", "o", F.row_number().over(by_hash).alias("nth"), F.sum(F.length("text")).over(by_hash).alias("held"))
    got = few.filter((F.col("nth") <= per_lang) & ((F.col("held") <= chars) | (F.col("nth") == 1))).select("lang", "nth", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], r["nth"]))]


def identified(docs: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """docs and lang_pred, score (0 to 1), cross_entropy (nats a character), rejected.

    The language with the lowest cross-entropy per character wins. Rejected are texts without letters (lang_pred `und`, score
    0), null texts among them, and texts whose best cross-entropy is above that language's limit. Ties go to the
    first language in order of names. Without models (None) every text is `und` with score 0, and only those without letters are
    rejected. Repeated rows give repeated results. Result columns replace columns of the same names in docs. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the fitting sample
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            rows = []
            for text in batch:
                chars = folded(text) if text else np.zeros(0, np.uint32)
                if len(chars) < 2:
                    rows.append(("und", 0.0, None, True))
                    continue
                if m is None:
                    rows.append(("und", 0.0, None, False))
                    continue
                mean = m.losses(chars) / (len(chars) - 1)
                j = int(np.argmin(mean))
                odds = np.exp(-(mean - mean[j]) * m.sharpness)
                rows.append((m.langs[j], float(1 / odds.sum()), float(mean[j]), bool(mean[j] > m.limits[j] + SHORT / np.sqrt(len(chars)))))
            yield pd.DataFrame(rows, columns=schema.names)

    named = docs.drop(*schema.names).withColumn("_guess", F.pandas_udf(releasing(guess), schema)(F.col(text_col)))
    return named.select("*", *[F.col(f"_guess.{c}").alias(c) for c in schema.names]).drop("_guess")
