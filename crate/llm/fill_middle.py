"""Fill-in-the-middle transformation over UTF-8 bytes, with a sparse index of the characters that take several of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crate.llm.workers import releasing

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents, how many are rearranged, and of a hundred of those, how many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Exceptions:
    """Where a UTF-8 text is not a byte a code point: its multibyte characters and the excess bytes up to and with each.

    Between two of them positions differ by a constant, so an ASCII text needs no entry at all.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.points = self.at - self.excess[:-1]

    def to_points(self, byte):
        """Code points before a byte position where a character starts (or the end)."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def to_bytes(self, point):
        """Byte position of a code point (or the end)."""
        return point + self.excess[np.searchsorted(self.points, point)]


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte positions where a unit starts: a run of ASCII letters, or any other code point."""
    letter = _LETTER[data]
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inside & ((data & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearranged(text: bytes, doc_id: int | None, seed: int, rate: int, suffix_first: int) -> tuple:
    """n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output of one document."""
    data = np.frombuffer(text, np.uint8)
    starts = unit_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, None, text
    cuts = np.sort([h1 % (n + 1), h2 % (n + 1)])
    a, b = (int(x) for x in np.append(starts, len(data))[cuts])
    p, q = (int(x) for x in Exceptions(data).to_points(np.array([a, b])))
    if h4 % 100 < suffix_first:
        form, out = "spm", b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    else:
        form, out = "psm", b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return n, form, p, q - p, a, b - a, out


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per input row: doc_id, n (units of the text), form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output.

    Units are runs of A-Z and a-z, or any other single code point. Two cuts between units, drawn from the seed and the id, divide a text
    into prefix, middle and suffix. Form psm: `<P>`prefix`<S>`suffix`<M>`middle; spm: `<S>`suffix`<P>`prefix`<M>`middle; plain: the
    text itself, where it is empty or holds a mark, or in 100 - rate of 100 draws; plain rows have null lengths.

    A null text counts as empty. Rows without an id are drawn as if their id were an empty string; rows that repeat an id get the same
    draws. Extra columns are ignored, whatever their names. An empty input gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            out = [(i, *rearranged(bytes(t), i, seed, rate, suffix_first)) for i, t in zip(ids, batch["data"], strict=True)]
            frame = pd.DataFrame(out, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"])
            numbers = ["doc_id", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes"]
            yield frame.astype(dict.fromkeys(numbers, "Int64"))

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output binary"
    return rows.mapInPandas(releasing(run), schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() has rearranged: the marks' first places tell the parts, since no rearranged text holds a mark."""
    first, last = F.when(form == "psm", F.instr(output, "<S>")).otherwise(F.instr(output, "<P>")), F.instr(output, "<M>")
    one = F.substring(output, F.lit(4), first - 4)
    two = F.substring(output, first + 3, last - first - 3)
    middle = F.substring(output, last + 3, F.length(output))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
