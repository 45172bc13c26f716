"""Substring deduplication by hashing lines or paragraphs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crate.llm.workers import releasing
from crate.storage import bounded, saved

_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n\s*\n")}
#: White space after an end of a sentence; the ends of scripts that set none need none, and take closing quotes and brackets along.
_ENDS = re.compile(r"(?<=[.!?।॥۔؟።၊။])\s+|(?<=[。！？｡])(?![。！？｡」』”’）】])\s*|(?<=[。！？｡][」』”’）】])\s*")
#: Scripts without spaces, with how many of their letters count as a word: Chinese and Japanese two, Thai, Lao, Burmese and Khmer four.
_TWO = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
_FOUR = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")


def _spans(breaks: re.Pattern, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    at = start
    for m in breaks.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def _size(words: list[str]) -> int:
    """How many words there are; in scripts without spaces, by their letters."""
    n = len(words)
    for w in words:
        if not w.isascii() and (two := len(_TWO.findall(w))) + (four := len(_FOUR.findall(w))):
            n += max(0, two // 2 + four // 4 - 1)
    return n


def units(text: str, unit: str = "line", sentences: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit in reading order: lines (or paragraphs), and with `sentences` after each the sentences in it.

    A digest is of the lower-case words between ASCII white space, alike for lines and sentences. A line of one sentence is a
    unit once. Where a line goes, its sentences are earlier in the place that has the line, so no last copy is lost.
    """

    def digest(words: list[bytes]) -> bytes:
        return hashlib.blake2b(b" ".join(words), digest_size=16).digest()

    words_of = lambda a, b: text[a:b].lower().encode("utf-8", "replace").split()
    for a, b in _spans(_BREAK[unit], text, 0, len(text)):
        if not (words := words_of(a, b)):
            continue
        yield a, b, digest(words)
        inner = [(c, d, w) for c, d in _spans(_ENDS, text, a, b) if (w := words_of(c, d))] if sentences else []
        if len(inner) > 1:
            yield from ((c, d, digest(w)) for c, d, w in inner)


def repeated_spans(text: str, found: Iterator[tuple[int, int, bytes]], gone: set[bytes], min_words: int) -> list[tuple[int, int]]:
    """Spans to remove: units whose digest is in `gone` or came before in the text, where those with only white space between have min_words together."""
    spans: list[tuple[int, int]] = []
    seen: set[bytes] = set()
    for a, b, d in found:
        if (d in gone or d in seen) and (not spans or a >= spans[-1][1]):
            spans.append((a, b))
        seen.add(d)
    out: list[tuple[int, int]] = []
    stretch, words = [], 0
    for a, b in [*spans, (len(text) + 1, 0)]:
        if stretch and (a > len(text) or text[stretch[-1][1] : a].strip()):
            out += stretch if words >= min_words else []
            stretch, words = [], 0
        stretch.append((a, b))
        words += _size(text[a:b].split())
    return out


def substring_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unit: str = "line", sentences: bool = False, min_words: int = 0) -> DataFrame:
    """doc_id, text (what stays), spans (removed, array of start and end in the original), n_chars, n_removed, n_spans.

    Of the units with equal normalised words the one in the first document, then the earliest place, stays; all others go. Documents
    rank by doc_id, null last; rows that repeat an id, or have none, are documents of their own and rank by a hash of their text, rows
    that are equal in all by their place in the table. Offsets count code points of the original text; the line break after a removed
    line stays where it was. A null or empty text has no units. Other columns are ignored; an empty input gives an empty result.

    Options that are off: `sentences` in lines are units too; of repeated units that follow each other only those go that have
    `min_words` together (in scripts without spaces letters count).
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), order[0].alias("key"), F.col(id_col).isNull().alias("last"), order[1].alias("h"))
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "documents")  # row names a row from here on

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, found = [], []
            for row, text in zip(batch["row"], batch["text"], strict=True):
                own = list({d: None for _, _, d in units(text, unit, sentences)})
                names += [row] * len(own)
                found += own
            both = np.frombuffer(b"".join(found), ">i8").reshape(-1, 2).astype("int64")
            yield pd.DataFrame({"row": np.array(names, "int64"), "high": both[:, 0], "low": both[:, 1]})

    seen = saved(rows.filter("text <> ''").select("row", "text").mapInPandas(releasing(emit), "row long, high long, low long"), "units")
    repeated = saved(seen.groupBy("high", "low").agg(F.count("*").alias("n")).filter("n > 1").select("high", "low"), "repeated")
    hits = seen.join(bounded(repeated), ["high", "low"]).join(rows.select("row", "last", "key", "h"), "row")
    hits = saved(hits, "hits")
    first = hits.groupBy("high", "low").agg(F.min(F.struct("last", "key", "h", "row")).alias("first")).select("high", "low", F.col("first.row").alias("first"))
    first = saved(first, "first")  # a row a digest: a digest that is everywhere is summed up before it moves, and joined where its rows are or split
    later = hits.select("row", "high", "low").join(bounded(first), ["high", "low"]).filter("row <> first")
    gone = later.groupBy("row").agg(F.collect_list(F.struct("high", "low")).alias("gone"))  # as many as the document has units

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, gone in zip(batch["text"], batch["gone"], strict=True):
                text = text or ""
                drop = {x["high"].to_bytes(8, "big", signed=True) + x["low"].to_bytes(8, "big", signed=True) for x in gone} if gone is not None else set()
                spans = repeated_spans(text, units(text, unit, sentences), drop, min_words)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out.append(("".join(kept), [{"start": a, "end": b} for a, b in spans], len(text), sum(b - a for a, b in spans), len(spans)))
            frame = pd.DataFrame(out, columns=["text", "spans", "n_chars", "n_removed", "n_spans"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield frame

    both = rows.select("row", F.col("doc_id").cast("string").alias("doc_id"), "text").join(gone, "row", "left").drop("row")
    return both.mapInPandas(releasing(cut), "doc_id long, text string, spans array<struct<start:int,end:int>>, n_chars long, n_removed long, n_spans long")
