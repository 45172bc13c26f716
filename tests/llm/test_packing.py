import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from crate.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_same_ids_as_the_library():
    rng = random.Random(2)
    texts = ["", "A'S don't I'LL x_y __ 1/2 ½ ² <|endoftext|> İΣΣ", "naïve ÀÉ ñ  \t", "ﬁ é", " x y"]
    texts += ["".join(rng.choice("abcdetnhiorsABÀÉ  '\n.éß_-½s'StłŁ7") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    library = Tokenizer.from_file(PATH)
    for text, raw in zip(texts, packing.load(PATH).encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def exact(lengths, capacity):
    """Fewest bins by search: for a handful of items."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum_and_packing_is_valid():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        low = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        bins, offsets, fill = packing.best_fit(np.array(lengths), capacity)
        assert low <= exact(lengths, capacity) <= len(fill)
        assert max(fill) <= capacity
        for b in range(len(fill)):
            at = 0
            for o, x in sorted((o, x) for k, o, x in zip(bins, offsets, lengths, strict=True) if k == b):
                assert o == at
                at += x


def test_operator(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "xyzzy"]) for _ in range(rng.randint(0, 90)))) for i in range(400)]
    rows += [(1000, None), (None, ""), (1001, "word " * 500), (5, rows[5][1])]
    got = packing.pack(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH, capacity=128), 128, part_rows=60).collect()
    assert len([r for r in got if r.doc_id == 1001]) == 4 and len([r for r in got if r.doc_id == 5]) == 2
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128
    lengths = np.array([r.length for r in got])
    assert len(by) <= 1.03 * packing.lower_bound(np.bincount(lengths, minlength=129), 128)  # of sixty items a task
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
