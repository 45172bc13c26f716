"""Best-fit packing with lower bounds from dual-feasible functions; partitions with a gap exchange what they hold."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crate.llm.workers import releasing
from crate.storage import saved

CAPACITY = 4096
#: Pieces that one task packs; the number of tasks grows with the input.
PART_ROWS = 16_000
MAX_ROUNDS = 8
#: Words that a Python worker remembers.
MEMO_WORDS = 250_000
#: Code points encoded at a time.
SLICE = 1_000_000

#: Texts of these characters only are cut into words here: letters, digits and signs for which `re` and the library agree.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u012f\u0131-\u024f]")
#: Fixed value: the vocabulary's pattern of words, with \p{L} and \p{N} as `re` has them for those characters.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordIds:
    """Ids of a text as the tokenizers library gives them; what stands between white space is encoded once and remembered."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        plain = [not (_OTHER.search(t) or ("<|" in t and self.added.search(t))) for t in texts]
        # Such texts are in composed form already, and no word of the pattern spans white space.
        chunks = [t.lower().split() if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        self._learn(set().union(*chunks).difference(self.memo))
        take = self.memo.__getitem__
        return [b"".join(map(take, c)) if p else self.whole(t) for t, c, p in zip(texts, chunks, plain, strict=True)]

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks: their new words are encoded many at a time, and told apart by the library's word numbers."""
        memo, words = self.memo, {c: _WORD.findall(c) for c in chunks}
        new = list({w for ws in words.values() for w in ws if w not in memo})
        for a in range(0, len(new), 1_000):
            part = new[a : a + 1_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = 4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
            raw, at = np.array(found.ids, "<u4").tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                memo[w] = raw[at:end]
                at = end
        for c, ws in words.items():
            memo[c] = b"".join([memo[w] for w in ws])


@cache
def load(path: str) -> WordIds:
    return WordIds(path)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size > SLICE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    yield first, texts[first:]


def pieces(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and end_id; only longer ones are cut, at multiples of capacity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = load(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for first, texts in _slices([t or "" for t in batch["text"]]):
                for i, raw in enumerate(ids.encode(texts), first):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        at.append(i)
                        rows.append((k, a // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").iloc[at].values)
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(releasing(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; counts[x] items have length x.

    The largest bound of two families of dual-feasible functions: one that drops items shorter than e and rounds up those
    longer than capacity - e, for each e; one that rounds (k+1) x down where it is not whole, for k to 100.
    """
    sizes = np.arange(len(counts))
    mass = counts * sizes
    below_n, below_m = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(mass)])
    e = np.arange(capacity // 2 + 1)
    large = below_n[-1] - below_n[capacity - e + 1]
    middle = below_m[capacity - e + 1] - below_m[e]
    best = int(np.max(large + -(-middle // capacity)))
    held = np.flatnonzero(counts)
    for k in range(1, 101):
        scaled = (k + 1) * held
        whole = scaled % capacity == 0
        # k * capacity times the function's value, so that all is in integers
        value = np.where(whole, held * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts[held]).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing over lengths that already decrease: the bin and the offset of each, and each bin's fill."""
    room: list[int] = []  # distinct free spaces, ascending
    by_room: dict[int, list[int]] = {}
    fill: list[int] = []
    bins, offsets = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64")
    for i, x in enumerate(lengths.tolist()):
        at = bisect.bisect_left(room, x)
        if at < len(room):
            free = room[at]
            holders = by_room[free]
            b = holders.pop()
            if not holders:
                del by_room[free], room[at]
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += x
        if left := free - x:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(room, left)
            by_room[left].append(b)
    return bins, offsets, np.array(fill, "int64")


def _packed(part_rows: DataFrame, turn: int, capacity: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, fill = best_fit(rows["length"].to_numpy(), capacity)
        gap = len(fill) - lower_bound(np.bincount(rows["length"], minlength=capacity + 1), capacity)
        rows["sequence_id"] = (turn << 56) | (int(rows["part"].iloc[0]) << 24) | bins
        rows["offset"], rows["fill"], rows["gap"] = offsets, fill[bins], gap
        # The least filled bin of a certified partition goes too: the rests of several may share a bin.
        rows["last"] = bins == int(np.argmin(fill))
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "gap", "last"]]

    names = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, gap long, last boolean"
    return part_rows.groupBy("part").applyInPandas(run, names)


def pack(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: lengths of a sequence add up to capacity at most.

    Items are dealt by hash to partitions of about part_rows, each packed by best-fit decreasing. A partition
    whose bin count equals its lower bound is certified and keeps its bins but the least filled; one with a gap keeps
    its full bins. The rest is dealt anew, to fewer partitions, and packed again, until the bins of all are as few as the
    lower bound over all items, or a round brings nothing more. Lengths from 1 to capacity; none is dropped.
    """
    items = saved(items, "pieces")
    sizes = items.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, "int64")
    for r in sizes:
        counts[r["length"]] += r["n"]
    n, needed = int(counts.sum()), lower_bound(counts, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    settled, todo, closed, before = [], items, 0, None
    for turn in range(max_rounds):
        parts = max(1, -(-n // part_rows))
        dealt = todo.select(*columns, F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part"))
        done = saved(_packed(dealt, turn, capacity), "packed")
        stays = (F.col("fill") == capacity) | ((F.col("gap") == 0) & ~F.col("last"))
        stat = done.agg(F.count_if((F.col("offset") == 0) & stays).alias("closed"), F.count_if(F.col("offset") == 0).alias("bins"), F.count_if(~stays).alias("left")).first()
        total = closed + (stat["bins"] or 0)
        if total <= needed or parts == 1 or not stat["left"] or (before is not None and total >= before and n <= 2 * part_rows):
            settled.append(done)
            break
        if turn == max_rounds - 1:
            settled.append(done)
            break
        settled.append(done.filter(stays))
        todo, n, closed, before = done.filter(~stays), stat["left"], closed + stat["closed"], total
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most capacity tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    vocabulary is the path of a tokenizers JSON file on every executor. Null text is an empty text, one end token. Repeated
    rows are packed as often as they occur; a null id stays null. Other columns are ignored; empty input, empty result.
    """
    return pack(pieces(docs, vocabulary, text_col, id_col, capacity), capacity)
