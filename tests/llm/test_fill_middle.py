import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crate.llm import fill_middle

TEXTS = [None, "", "a", "word", "one two three", "été à l'école", "日本語 text 漢字", "a😀b😀😀 c", "has <P> inside", "<S", "<M> only", "<<P", "x" * 5_000, ("mañana 日本 " * 40_000), "\n\r\n\t \x0b", "same", "same"]


def plainly(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_a_plain_version(spark):
    rows = [(i * 7 + k, t) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (None, "nor here"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(i, t, "n", "form") for i, t in rows], "doc_id long, text string, output string, form string")
    found = fill_middle.fill_in_middle(df)
    got = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *plainly(i, t or "")) for i, t in rows if i is not None)
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got if r.doc_id is not None) == want
    assert sorted(r.output for r in got if r.doc_id is None) == sorted(plainly(None, t)[-1] for i, t in rows if i is None)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_byte_lengths_cut_the_text(spark):
    df = spark.createDataFrame([(i, "é日😀a " * (i % 5 + 1)) for i in range(60)], "doc_id long, text string")
    for r in fill_middle.fill_in_middle(df).filter("form = 'psm'").collect():
        data = ("é日😀a " * (r.doc_id % 5 + 1)).encode()
        assert data[: r.prefix_bytes].decode() == r.output[3 : 3 + r.prefix_chars]
        assert r.output.endswith(data[r.prefix_bytes : r.prefix_bytes + r.middle_bytes].decode())


def test_an_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_positions(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.Exceptions(data)
    assert len(index.at) == sum(ord(c) > 127 for c in text)
    for point in range(len(text) + 1):
        byte = len(text[:point].encode())
        assert (index.to_bytes(point), index.to_points(byte)) == (byte, point)
    at, want = 0, []
    for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S):
        want.append(at)
        at += len(unit.encode())
    assert fill_middle.unit_starts(data).tolist() == want
