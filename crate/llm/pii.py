"""Format-preserving pseudonyms for personal data: Feistel permutations in column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31 as two factors, the halves of the date permutation.
DAYS = (17, 4297)
#: Social security numbers: areas 001 to 899 but 666; groups and serials from 1.
AREAS, REST = 898, 99 * 9999

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
HEX = r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
YMD = r"\d{4}(?:-\d{2}-\d{2}|/\d{2}/\d{2}|\.\d{2}\.\d{2})"
DMY = r"(?:\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2})[-/.]\d{4}"
CARD = r"(?:\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})"
#: Where two kinds could match, the first does.
FOUND = rf"(?<![\w.%+@-])(?:{EMAIL}|{HEX}(?!\w)|(?:{IBAN}|{YMD}|{DMY}|{IP}|{CARD}|{SSN})(?![\w-])(?!\.\d)|{PHONE}(?!\w))|(?<![\w.])(?:{PHONE})(?!\w)"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _number(s: Column) -> Column:
    return F.coalesce(F.when(F.length(s) > 0, s).cast("long"), F.lit(0).cast("long"))


def _mix(key: str, kind: str, n: Column, turn: Column, x: Column) -> Column:
    """Round function: 60 bits of a keyed SHA-256."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), turn.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, a_size: Column, b_size: Column, key: str, kind: str) -> Column:
    """struct(a, b): (a, b) permuted within a_size times b_size. Each round adds a keyed function of one half to the other."""

    def step(acc: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        add = _mix(key, kind, a_size, turn, F.when(even, acc["b"]).otherwise(acc["a"]))
        return F.struct(F.when(even, (acc["a"] + add) % a_size).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise((acc["b"] + add) % b_size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def permute_digits(d: Column, key: str, kind: str) -> Column:
    """A string of up to 36 digits permuted among those of its length."""
    u = F.floor(F.length(d) / 2).cast("int")
    v = F.length(d) - u
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    halves = feistel(_number(F.left(d, u)), _number(F.right(d, v)), power(u), power(v), key, kind)
    return _with(halves, lambda p: F.concat(F.when(u > 0, F.lpad(p["a"].cast("string"), u, "0")).otherwise(F.lit("")), F.lpad(p["b"].cast("string"), v, "0")))


def refill(shape: Column, digits: Column) -> Column:
    """shape with its digits, in order, replaced by those given."""
    at = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i)))
    char = lambda i: F.substring(shape, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(char(i).rlike(r"\d"), F.substring(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def luhn_sum(d: Column) -> Column:
    """Sum of the Luhn algorithm; the last digit counts once."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    body = permute_digits(F.left(_digits(m), F.length(_digits(m)) - 1), key, "card")
    checked = _with(body, lambda b: F.concat(b, ((F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _with(checked, lambda c: refill(m, c))


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+(?:\d{1,3}(?=[ .(-])|\d)", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _with(permute_digits(_digits(rest), key, "phone"), lambda d: refill(rest, d)))


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    halves = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    byte = lambda x: x.cast("string")
    return _with(halves, lambda p: F.concat_ws(".", byte(F.shiftright(p["a"], 8)), byte(p["a"] % 256), byte(F.shiftright(p["b"], 8)), byte(p["b"] % 256)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    halves = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(AREAS), F.lit(REST), key, "ssn")
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return _with(
        halves,
        lambda p: F.concat_ws("-", part(F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1), 3), part(F.floor(p["b"] / 9999) + 1, 2), part(p["b"] % 9999 + 1, 4)),
    )


def _remainder97(s: Column) -> Column:
    """Of an upper-case string as a number, A being 10, divided by 97."""

    def add(acc: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        return F.when(c.rlike(r"\d"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _compact(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def _iban(m: Column, key: str) -> Column:
    body = _with(permute_digits(_digits(F.substring(_compact(m), F.lit(5), F.length(m))), key, "iban"), lambda d: F.concat(F.left(m, F.lit(2)), F.lit("00"), d))
    filled = _with(body, lambda d: refill(m, F.substring(d, F.lit(3), F.length(d))))
    check = lambda f: F.lpad((F.lit(98) - _remainder97(F.concat(F.substring(_compact(f), F.lit(5), F.length(f)), F.left(f, F.lit(2)), F.lit("00")))).cast("string"), 2, "0")
    return _with(filled, lambda f: F.concat(F.left(f, F.lit(2)), check(f), F.substring(f, F.lit(5), F.length(f))))


def _last_day(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _real(y: Column, m: Column, d: Column) -> Column:
    return y.between(1900, 2099) & m.between(1, 12) & (d >= 1) & (d <= _last_day(y, m))


def _permuted_day(y: Column, m: Column, d: Column, key: str) -> Column:
    day = F.unix_date(F.make_date(y, m, d)) + F.lit(25567)  # from 1900-01-01
    return _with(feistel(day % DAYS[0], F.floor(day / DAYS[0]), F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date"), lambda p: F.date_from_unix_date((p["b"] * DAYS[0] + p["a"] - 25567).cast("int")))


def _rendered(day: Column, order: str, m: Column, parts: Column) -> Column:
    """day written as m is: its separators, and two digits where m has them or the number needs them."""
    number = {"y": F.year(day), "m": F.month(day), "d": F.dayofmonth(day)}
    first = F.lpad(number[order[0]].cast("string"), 4 if order[0] == "y" else 2, "0")
    second = F.lpad(number[order[1]].cast("string"), 2, "0")
    third = F.lpad(number[order[2]].cast("string"), 4 if order[2] == "y" else 2, "0")
    bare = lambda s, k: F.when(F.length(parts[k]) == 1, F.regexp_replace(s, "^0", "")).otherwise(s)
    seps = F.regexp_extract_all(m, F.lit(r"\D"), F.lit(0))
    return F.concat(bare(first, 0), seps[0], bare(second, 1), seps[1], third)


def _date(m: Column, key: str) -> Column:
    """Year first; else with slashes month first where that is a date; else day first. Unchanged if no reading is a date."""
    p = F.split(m, r"[-/.]")
    a, b, c = (p[k].cast("int") for k in range(3))
    as_is = lambda y, mo, d, order: _with(_permuted_day(y, mo, d, key), lambda day: _rendered(day, order, m, p))
    return (
        F.when(m.rlike(r"^\d{4}"), F.when(_real(a, b, c), as_is(a, b, c, "ymd")).otherwise(m))
        .when(m.contains("/") & _real(c, a, b), as_is(c, a, b, "mdy"))
        .when(_real(c, b, a), as_is(c, b, a, "dmy"))
        .otherwise(m)
    )


def _hidden(s: Column, key: str, kind: str) -> Column:
    """As many hexadecimal digits as s is long, from keyed digests: for what is no number."""
    digest = lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(k), F.lower(s)), 256)
    return F.left(F.concat(digest("0"), digest("1")), F.length(s))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for one match; the match itself where its check digits, octets or calendar say that it is none."""
    is_ = lambda pattern: m.rlike(f"^(?:{pattern})$")
    d = _digits(m)
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    area = F.left(m, F.lit(3))
    return (
        F.when(m.contains("@"), F.concat(_hidden(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(is_(IBAN), F.when(_remainder97(F.concat(F.substring(_compact(m), F.lit(5), F.length(m)), F.left(m, F.lit(4)))) == 1, _iban(m, key)).otherwise(m))
        .when(is_(f"{YMD}|{DMY}"), _date(m, key))
        .when(is_(IP), F.when(octets, _ip(m, key)).otherwise(m))
        .when(is_(CARD), F.when((F.length(d) >= 13) & (F.length(d) <= 19) & (luhn_sum(d) % 10 == 0), _card(m, key)).otherwise(m))
        .when(is_(SSN), F.when(~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) > "00") & (F.substring(m, 8, 4) > "0000"), _ssn(m, key)).otherwise(m))
        .when(is_(PHONE), _phone(m, key))
        .otherwise(F.when(m == F.upper(m), F.upper(_hidden(m, key, "secret"))).otherwise(_hidden(m, key, "secret")))
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced, and n_replaced.

    Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, social security numbers and dates that are valid are permuted by a keyed
    Feistel network within the values of their format, so the result is valid too, and distinct values stay distinct; digits of
    phone numbers after the country code are permuted within their length. Equal values get equal pseudonyms in all
    documents. Local parts of e-mail addresses and long hexadecimal secrets, no numbers, get keyed digests of their length.
    Everything else in a text stays, numbers that fail their checks included. A null text stays null, n_replaced 0.
    Other columns stay; a column n_replaced in docs is replaced. Ambiguous dates with slashes are read month first.
    """
    text = F.col(text_col)
    columns = [c for c in docs.columns if c != "n_replaced"]
    some = text.rlike("[0-9@]")
    cut = docs.select(*columns, F.when(some, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_found"))
    found = F.size("_found") > 0
    named = cut.select("*", F.when(found, F.transform("_found", lambda m: pseudonym(m, key))).alias("_names"))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, FOUND), F.concat("_names", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = F.size(F.filter(F.zip_with("_found", "_names", lambda a, b: a != b), lambda x: x))
    return named.select(
        *[F.when(found, joined).otherwise(text).alias(c) if c == text_col else F.col(c) for c in columns],
        F.when(found, changed).otherwise(0).cast("long").alias("n_replaced"),
    )
