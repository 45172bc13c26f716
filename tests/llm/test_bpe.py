import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crate.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = ["", "a" * 3000, "<|endoftext|>x <|endoftext|>", "  \n\n  xé中文 \U0001f600", "don't I'll 123 4567\t\n", "zzzqqq" * 200, "   x", "a  b   c \n d"]


def texts():
    rng = random.Random(1)
    return TEXTS + ["".join(rng.choice("abcdetnhiors  '\n.é中😀ſ'SX\x00\x7f") for _ in range(rng.randint(1, 60))) for _ in range(500)]


def test_same_ids_and_texts_as_the_library():
    ours, theirs = bpe.load(PATH), Tokenizer.from_file(PATH)
    for t in texts():
        ids = np.frombuffer(ours.encode(t), "<u4")
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert ours.decode(ids).decode("utf-8", "replace") == theirs.decode(want, skip_special_tokens=False)


def test_every_token_pair_table_entry_is_exact():
    """Two tokens that fit stay apart in the library's encoding of their bytes, and only those."""
    ours, theirs = bpe.load(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    plain = [i for i, t in enumerate(ours.tokens) if t.isalpha() and t.isascii()]
    for _ in range(400):
        a, b = rng.choice(plain), rng.choice(plain)
        both = (ours.tokens[a] + ours.tokens[b]).decode()
        assert ours._fits(a, b) == (theirs.encode(both, add_special_tokens=False).ids == [a, b])


def test_operator(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (1, "hello world")]
    got = bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert len(got) == 5
    assert [len(r.ids) for r in got if r.doc_id in (2, 3)] == [0, 0]
    assert {r.decoded for r in got if r.doc_id == 1} == {"hello world"}
    assert {r.ids_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
