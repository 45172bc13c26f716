"""Spelling variants: edits of each word probe blocked Bloom filters, and only positives meet the vocabulary in an exact join."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crate.llm.workers import releasing
from crate.storage import discard, saved

SHORTEST, OCCURRENCES = 5, 3
#: Of how many (document, run) pairs one loses a letter: planted misspellings.
DAMAGE = 97
#: Bits of filter for each word, and bytes of all filters that are broadcast at once; a larger vocabulary takes several passes.
BITS, FILTER_BYTES = 24, 1 << 24
#: Longer words share the filter of this length.
LONGEST = 64
#: Distinct words that a task counts before it hands them on, and edits that it probes at once.
FLUSH_WORDS, PROBES = 250_000, 400_000

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _letters(points: np.ndarray) -> np.ndarray:
    return mixed(points.astype(np.uint64) + np.uint64(0x51ED270B))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(_BASE)
    return np.multiply.accumulate(out)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """Sum of each letter's number times a power for its place: the hash of an edited word follows from that of the word."""
    return (_letters(points) * _powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def damaged(doc_id: int | None, run: str, damage: int = DAMAGE, start: int | None = None) -> str:
    """The run, without one letter if `damage` divides the crc32 of `<doc_id>:<run>`; a null id is written as nothing."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()) if start is None else start
    h = zlib.crc32(run.encode(), start)
    if not damage or h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", occurrences: int = OCCURRENCES, damage: int = DAMAGE) -> DataFrame:
    """word, n: runs of letters of the whole texts, A-Z in lower case, at least SHORTEST letters, and `occurrences` of them.

    `damage` > 0 plants misspellings (see damaged()); 0 plants none. A null text has no words. Rows that repeat an id count each.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": list(words.keys()), "n": np.fromiter(words.values(), np.int64, len(words))})

        for batch in batches:
            for doc_id, data in zip(batch["doc_id"], batch["data"], strict=True):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for run, n in Counter(_RUN.findall(bytes(data).lower().decode("utf-8", "replace"))).items():
                    word = damaged(None, run, damage, start)
                    if len(word) >= SHORTEST:
                        words[word] += n
                if len(words) > FLUSH_WORDS:
                    yield rows()
                    words.clear()
        if words:
            yield rows()

    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    counts = texts.mapInPandas(releasing(count), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


@dataclass
class Filters:
    """Blocked Bloom filters, one for each length of word: a word's four bits lie in one block of 64."""

    first: np.ndarray  # of each length: its first block
    size: np.ndarray  # and how many it has
    blocks: np.ndarray
    part: int
    parts: int

    def holds(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Whether a word of this length and hash may be in the vocabulary, or surely isn't."""
        shard = min(length, LONGEST)
        if not self.size[shard]:
            return np.zeros(len(hashes), bool)
        own, block, bits = placed(hashes, int(self.size[shard]), self.parts)
        found = (self.blocks[int(self.first[shard]) + block] & bits) == bits
        return found & (own == self.part) if self.parts > 1 else found


def placed(hashes: np.ndarray, size: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, block within the filter of so many blocks, and bits of each hash."""
    x = mixed(hashes)
    block = ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
    bits = np.zeros(len(x), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << ((x >> np.uint64(shift)) & np.uint64(63))
    return ((x >> np.uint64(24)) & np.uint64(0xFF)) % np.uint64(parts), block.astype(np.int64), bits


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places in the series and code points of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, PROBES // int(length))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            yield int(length), some, _points(words.iloc[some].tolist(), int(length))


def filters(words: DataFrame, loads: dict[int, int], part: int, parts: int) -> Filters:
    """Filters of one part of the vocabulary: tasks set bits, which are combined by block; at most FILTER_BYTES come to the driver."""
    size = np.zeros(LONGEST + 1, np.int64)
    for shard, n in loads.items():
        size[shard] = max(1, -(-n * BITS // (64 * parts)))
    first = np.cumsum(size) - size

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, _, points in _by_length(batch["word"]):
                shard = min(length, LONGEST)
                own, block, bits = placed(word_hashes(points), int(size[shard]), parts)
                mine = own == part
                yield pd.DataFrame({"block": first[shard] + block[mine], "bits": bits[mine].view(np.int64)})

    got = words.select("word").mapInPandas(releasing(place), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toPandas()
    blocks = np.zeros(int(size.sum()), np.uint64)
    blocks[got["block"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return Filters(first, size, blocks, part, parts)


def edits(points: np.ndarray, alphabet: np.ndarray, known: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter) of the edits that the filters may hold: deletions (letter 0), and replacements by a later letter.

    An insertion is a deletion seen from the other word, and a replacement by an earlier letter likewise. Of equal letters in a row
    only the last is deleted, so no edit comes twice.
    """
    n, length = points.shape
    powers, letters = _powers(length), _letters(points)
    terms = letters * powers
    before = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = before[:, -1]
    if length > 1:
        without = before - terms + (whole[:, None] - before) * np.uint64(_INVERSE)
        last = np.ones((n, length), bool)
        last[:, :-1] = points[:, 1:] != points[:, :-1]
        row, place = np.nonzero(last)
        hit = known.holds(length - 1, without[row, place])
        yield row[hit], place[hit], np.zeros(int(hit.sum()), np.uint32)
    for letter, number in zip(alphabet, _letters(alphabet), strict=True):
        row, place = np.nonzero(points < letter)
        hit = known.holds(length, whole[row] + (number - letters[row, place]) * powers[place])
        yield row[hit], place[hit], np.full(int(hit.sum()), letter, np.uint32)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each ordered pair of the vocabulary (word, n) one inserted, deleted or replaced letter apart."""
    spark = words.sparkSession
    length = F.least(F.length("word"), F.lit(LONGEST))
    loads = {r["shard"]: r["n"] for r in words.groupBy(length.alias("shard")).agg(F.count("*").alias("n")).collect()}  # at most LONGEST rows
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").distinct().collect()  # one row a letter of the script
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters), np.uint32)
    parts = max(1, -(-sum(loads.values()) * BITS // (8 * FILTER_BYTES)))
    if parts > 256:
        raise ValueError(f"{sum(loads.values())} words need more than 256 passes: raise FILTER_BYTES")
    found = []
    for part in range(parts):
        known = spark.sparkContext.broadcast(filters(words, loads, part, parts))

        def probe(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            for batch in batches:
                words, counts = batch["word"], batch["n"].to_numpy()
                for _, at, points in _by_length(words):
                    for row, place, letter in edits(points, alphabet, known.value):
                        if len(row):
                            own = [words.iat[at[r]] for r in row]
                            other = [w[:p] + (chr(c) if c else "") + w[p + 1 :] for w, p, c in zip(own, place, letter, strict=True)]
                            yield pd.DataFrame({"word": own, "n": counts[at[row]], "other": other})

        found.append(saved(words.mapInPandas(releasing(probe), "word string, n long, other string"), "positives"))
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    exact = positives.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    pairs = saved(exact.select("word", "n", "other", "other_n"), "near")
    discard(*found)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of a vocabulary (word, n) of distinct words.

    Words are near if one inserted, deleted or replaced code point makes the one the other. form is the near word of largest n, of equal
    ones the first in code-point order, if its n is at least twice the word's own, else null; root is where following forms ends, the
    word itself if it has none. An empty vocabulary gives an empty result; null words take no part.
    """
    words = saved(words.filter("word <> ''").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), "other")).alias("best"), F.first("n").alias("own"))
    takes = -F.col("best.order") >= 2 * F.col("own")
    formed = saved(best.select("word", "n_near", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.order")).alias("form_n")), "forms")
    # Each step at least doubles n, so chains are short, and doubling the jumps takes few rounds.
    roots = saved(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left")
        step = saved(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    out = words.join(formed, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", occurrences: int = OCCURRENCES, damage: int = DAMAGE) -> DataFrame:
    """variants() of the vocabulary() of documents; extra columns are ignored, an empty table gives an empty result."""
    return variants(vocabulary(docs, text_col, id_col, occurrences, damage))
