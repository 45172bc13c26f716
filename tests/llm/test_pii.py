import itertools
import re

from pyspark.sql import functions as F

from crate.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def hide(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    return {r.doc_id: r for r in pii.pseudonymised(df, key).collect()}


def test_formats_stay_valid_and_linked(spark):
    texts = [
        "card 4845168114407329 and 4845-1681-1440-7329.", "again 4845168114407329", "not a card 4845168114407328", "+1 (743) 555-3824", "ip 152.143.123.131### 999.1.1.1 1.2.3",
        "ssn 123-45-6789, 000-12-3456", "2021-02-28 2021-02-30 12/31/1999 31.12.1999", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "mail the.45@mail7.example.com", "", None, "clean 12 text 3.5",
    ]
    got = hide(spark, texts)
    card = re.search(r"card (\d{16}) and ([\d-]{19})", got[0].text)
    assert luhn(card[1]) and card[2].replace("-", "") == card[1] != "4845168114407329"
    assert card[1] in got[1].text and got[2].text == texts[2]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[3].text) and got[3].text != texts[3]
    ip = re.fullmatch(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+)### 999\.1\.1\.1 1\.2\.3", got[4].text)
    assert all(int(x) < 256 for x in ip.groups())
    assert got[5].text.endswith("000-12-3456") and not got[5].text.startswith("ssn 123")
    assert re.fullmatch(r"(19|20)\d\d-\d\d-\d\d 2021-02-30 \d\d/\d\d/(19|20)\d\d \d\d\.\d\d\.(19|20)\d\d", got[6].text)
    iban = got[7].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and got[8].text == texts[8]
    assert got[9].text.endswith("@mail7.example.com") and "the.45" not in got[9].text
    assert (got[10].text, got[11].text, got[12].text) == ("", None, texts[12])
    assert [got[i].n_replaced for i in (0, 2, 10, 11, 12)] == [2, 0, 0, 0, 0]
    assert hide(spark, texts[:1], "other key")[0].text != got[0].text


def test_permutations(spark):
    """All values of small formats, each hit once."""
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pii.permute_digits(F.col("d"), "k", "t").alias("p")).distinct().count() == 1000
    days = spark.sql("select explode(sequence(date'1900-01-01', date'2099-12-31')) as d")
    p = days.select(pii._permuted_day(F.year("d"), F.month("d"), F.dayofmonth("d"), "k").alias("p"))
    assert p.distinct().count() == days.count() == 73049
    assert p.agg(F.min("p").cast("string"), F.max("p").cast("string")).first()[:] == ("1900-01-01", "2099-12-31")
    few = spark.createDataFrame([(f"{a:03d}-{b:02d}-{c:04d}",) for a, b, c in itertools.product((1, 665, 667, 899), (1, 99), (1, 9999))], "s string")
    out = [r.p for r in few.select(pii._ssn(F.col("s"), "k").alias("p")).collect()]
    assert len(set(out)) == 16 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x) for x in out)


def test_empty_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = pii.pseudonymised(df, "k")
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()
