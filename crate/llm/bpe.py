"""Byte-level BPE: backtracking encoder with a pair-compatibility table, decoder with an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crate.llm.workers import releasing

#: Fixed values of the public byte-level BPE format: the pre-tokeniser's pattern, and the printable stand-ins of bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Pieces remembered by a Python worker; when full they are forgotten and found again.
MEMO_PIECES = 400_000
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 1_000_000
#: Longer pieces are encoded each time, not remembered.
MEMO_CHARS = 64


def _byte_of() -> dict[str, int]:
    table, extra = {chr(b): b for b in PRINTABLE}, 256
    for b in range(256):
        if b not in table.values():
            table[chr(extra)] = b
            extra += 1
    return table


class Bpe:
    """A vocabulary whose ids grow with merge order, so that an id is also the rank of the merge that makes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, vocab = _byte_of(), spec["model"]["vocab"]
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for s, i in vocab.items():
            self.tokens[i] = to_bytes(s)
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.made: dict[tuple[int, int], int] = {}  # pair -> merged id
        self.parts = [(i, i) for i in range(size)]  # id -> the pair that its merge joins; itself for a byte
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, out = vocab[a], vocab[b], vocab[a + b]
            self.made.setdefault((left, right), out)
            if self.parts[out] == (out, out):
                self.parts[out] = (left, right)
        # Merge order: a byte is before any merge; ids of merged tokens already follow the merge list.
        self.matcher = ahocorasick.Automaton()
        self.id_of: dict[bytes, int] = {}
        for s, i in vocab.items():
            raw = to_bytes(s)
            self.id_of[raw] = i
            self.matcher.add_word(raw.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.shorter = [self._shorter(self.tokens[i]) if i not in self.special.values() else -1 for i in range(size)]
        self.agree: dict[tuple[int, int], bool] = {}
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])])
        self.lengths = np.diff(self.offsets)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pieces = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.memo = _Memo(self)

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.id_of.get(token[:n])) is not None:
                return i
        return -1

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded.

        Undo merges from the latest back; if at some point the two inner neighbours have a merge that comes before
        the merges undone so far, the encoder would have joined them across the border.
        """
        known = self.agree.get((left, right))
        if known is None:
            a, b, limit = left, right, len(self.tokens)
            known = True
            while True:
                if self.made.get((a, b), limit) < limit:
                    known = False
                    break
                (a1, a2), (b1, b2) = self.parts[a], self.parts[b]
                whole_a, whole_b = a1 == a2 == a, b1 == b2 == b
                if whole_a and whole_b:
                    break
                if whole_b or (not whole_a and a > b):  # the left token is the later merge
                    limit, a = a, a2
                else:
                    limit, b = b + 1, b1
            if len(self.agree) > PAIRS:
                self.agree.clear()
            self.agree[(left, right)] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Exact merges of one piece: take the longest match; while it doesn't fit the token before, take shorter ones or step back."""
        raw = piece.encode("utf-8")
        if (whole := self.id_of.get(raw)) is not None:
            return [whole]
        text, end = raw.decode("latin-1"), len(raw)
        longest = lambda at: next(self.matcher.iter_long(text, at))[1] if at < end else -1
        out: list[int] = []
        alive = bytearray(b"\1") * (end + 1)  # places from which no dead end is known
        at, token = 0, longest(0)
        while token >= 0:
            while True:
                stop = at + len(self.tokens[token])
                if alive[stop] and (not out or self._fits(out[-1], token)):
                    out.append(token)
                    at, token = stop, longest(stop)
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                alive[at] = 0
                token = out.pop()
                at -= len(self.tokens[token])
                # the token that led to the dead end is tried again: its end is now marked
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        take, at, out = self.memo.__getitem__, 0, []
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            out += map(take, self.pieces(text[at : m.start()]))
            out.append(np.array([self.special[m.group()]], "<u4").tobytes())
            at = m.end()
        out += map(take, self.pieces(text[at:] if at else text))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids: a gather from the token bytes by the offset table."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1])
        return self.blob[at].tobytes()


class _Memo(dict):
    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.bpe.encode_piece(piece), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string), n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    vocabulary is the path of a tokenizers JSON file on every executor. Null text is an empty text: no ids. Strings of
    added tokens in a text become their ids, as in the tokenizers library. With keep_ids=False the ids and the decoded text are
    not returned, only the digests. Repeated rows give repeated results; other columns are ignored.
    """
    names = "doc_id long, " + "ids array<int>, decoded string, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                raw = bpe.encode(text) if text else b""
                ids = np.frombuffer(raw, "<u4")
                back = bpe.decode(ids).decode("utf-8", "replace")
                rows.append((*((ids.astype("int32"), back) if keep_ids else ()), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=[*(("ids", "decoded") if keep_ids else ()), "n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(releasing(run), names)
