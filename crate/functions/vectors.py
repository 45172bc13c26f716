"""Vector columns (array<double>): norms, cosines and blockwise arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once a row: inside an array function an expression is computed again for each element."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a vector of (almost) no length stays as it is."""
    return once(norm(v), lambda n: F.when(n < EPS, v).otherwise(F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """0.0 for vectors of no length or of different lengths."""
    na, nb = norm(a), norm(b)
    bad = (F.size(a) != F.size(b)) | (na < EPS) | (nb < EPS)
    return F.when(bad, F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def cosine_or_null(a: Column, b: Column) -> Column:
    """Null where a side is missing or has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0) & (F.size(a) == F.size(b)), dot(a, b) / (na * nb))


def layer_weights(n: int) -> list[float]:
    """Weights of n layers: a bump at 70 % of the depth over a floor of 0.3."""
    import math

    if n <= 0:
        return []
    centre, width = 0.7 * (n - 1), max(1.0, 0.25 * n)
    return [math.exp(-((i - centre) ** 2) / (2 * width * width)) + 0.3 for i in range(n)]


def meta_vector(energy: Column, danceability: Column, bpm: Column) -> Column:
    """Energy, danceability and tempo over 200, each with its own default."""
    return F.array(F.coalesce(energy, F.lit(0.5)), F.coalesce(danceability, F.lit(0.5)), F.coalesce(F.least(F.lit(1.0), bpm / 200), F.lit(0.6)))


def fuse(blocks: list[tuple[Column, float, int]]) -> Column:
    """Blocks (vector, weight, dimensions), each made unit and weighted, side by side and made unit; a missing block is zeros."""
    parts = [F.coalesce(scaled(l2_normalize(v), w), F.array_repeat(F.lit(0.0), d)) for v, w, d in blocks]
    return once(F.concat(*parts), l2_normalize)


#: The named ranges, and the range of each of the 16 bands that lie evenly on a log scale from 20 Hz to 11,025 Hz.
RANGES = ("sub", "bass", "low-mid", "mid", "high-mid", "highs")
BAND_EDGES_HZ = (20, 60, 250, 500, 2000, 6000)


def band_ranges(bands: int = 16, low: float = 20.0, high: float = 11025.0) -> list[int]:
    """Index of the named range that holds each band's centre."""
    step = (high / low) ** (1 / bands)
    centres = [low * step ** (i + 0.5) for i in range(bands)]
    return [max(r for r, edge in enumerate(BAND_EDGES_HZ) if edge <= c or r == 0) for c in centres]


def band_breakdown(a: Column, b: Column) -> Column:
    """array of (name, a, b, match) for two 16-band profiles; empty for a null or any other size."""
    of = band_ranges()
    parts = []
    for r, name in enumerate(RANGES):
        first, n = of.index(r), of.count(r)
        ea, eb = (F.aggregate(F.slice(v, first + 1, n), F.lit(0.0), lambda s, x: s + x) for v in (a, b))
        match = F.lit(1.0) - F.abs(ea - eb) / (ea + eb + F.lit(1e-9))
        parts.append(F.struct(F.lit(name).alias("name"), F.round(ea, 3).alias("a"), F.round(eb, 3).alias("b"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), match)), 3).alias("match")))
    full = (F.size(a) == 16) & (F.size(b) == 16)
    return F.when(full, F.array(*parts)).otherwise(F.array().cast("array<struct<name:string,a:double,b:double,match:double>>"))


def band_overall(a: Column, b: Column) -> Column:
    """The cosine of two 16-band profiles, 3 decimals; null for a null, any other size, or a side without energy."""
    return F.when((F.size(a) == 16) & (F.size(b) == 16), F.round(cosine_or_null(a, b), 3))
