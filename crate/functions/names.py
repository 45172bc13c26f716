"""Artist and title out of messy names, snippets out of HTML, answers out of nested records: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is taken off a raw name, in this order.
REWRITES = (
    r"(?i)\.(mp3|flac|wav|m4a|aac|ogg|aiff?)$",
    r"(?i)^.*?\bpremiere\b\s*[:|\-]?\s*",
    r"(?i)^[A-E]?\d{1,2}\s*[.\-]\s+",
    r"(?i)\(?\s*free\s*download\s*\)?",
    r"\[[^\]]*\]",
    r"(?i)\([^)]*\b(?:mix|edit|remix|version|bootleg|rework|dub|vip|remaster|master)\b[^)]*\)",
)
#: What an artist that is a label looks like, and a country or code in brackets behind a name.
LABELISH = r"(?i)records?|recordings|premiere|mixmag|promo|\bfree\b|\bvinyl\b|music|\bvol\b"
COUNTRY = r"\s*\((?:[A-Z]{2,3}|[A-Z][a-z]+)\)\s*$"
#: Signs that are stripped from both ends of a name, and the dash between artist and title.
ENDS, DASH = r"^[ \-–—|:_\t]+|[ \-–—|:_\t]+$", r"\s[-–—]\s"


def artist_title(title: Column, artist: Column, path: Column) -> Column:
    """struct(artist, title): both sides of a dash; with one side only, the given artist unless it looks like a label."""
    s = F.coalesce(F.nullif(title, F.lit("")), F.element_at(F.split(path, "/"), -1), F.lit(""))
    for pattern in REWRITES:
        s = F.regexp_replace(s, pattern, "")
    s = F.regexp_replace(s, ENDS, "")
    parts = F.filter(F.transform(F.split(s, DASH), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    name = lambda a: F.trim(F.regexp_replace(a, COUNTRY, ""))
    given = F.trim(F.coalesce(artist, F.lit("")))
    one = F.struct(F.when((F.length(given) > 0) & ~given.rlike(LABELISH), name(given)).alias("artist"), F.get(parts, F.lit(0)).alias("title"))
    return F.when(F.size(parts) >= 2, F.struct(name(F.get(parts, F.lit(0))).alias("artist"), F.get(parts, F.lit(1)).alias("title"))).otherwise(one)


#: The named entities that occur in result pages.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_text(html: Column, most: int = 200) -> Column:
    """Text of a fragment: tags are spaces, entities characters, white space single; cut to `most`."""
    s = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, char in ENTITIES.items():
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(s, r"\s+", " ")), 1, most)


def snippets(html: Column, tag: str = "p", n: int = 6, least: int = 12) -> Column:
    """The first n distinct texts of a page's elements that aren't too short."""
    cells = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    texts = F.filter(F.transform(cells, lambda c: plain_text(c)), lambda t: F.length(t) >= least)
    return F.slice(F.array_distinct(texts), 1, n)


def best_match(results: Column) -> Column:
    """Of array<struct<score, recordings>> the best that carries a recording; null if none does. Ties: the first."""
    held = F.filter(results, lambda r: F.size(r["recordings"]) > 0)
    top = F.array_max(F.transform(held, lambda r: r["score"]))
    return F.get(F.filter(held, lambda r: r["score"] == top), F.lit(0))


def first_with_style(hits: Column) -> Column:
    """Of array<struct<style, genre, ...>> the first with any."""
    return F.get(F.filter(hits, lambda h: (F.size(h["style"]) > 0) | (F.size(h["genre"]) > 0)), F.lit(0))


def genre_names(genres: Column, least: int = 1) -> Column:
    """Names of array<struct<name, count>> that are used enough, most used first, lower case, each once."""
    held = F.filter(genres, lambda g: F.coalesce(g["count"], F.lit(1)) >= least)
    return F.array_distinct(F.transform(F.array_sort(F.transform(held, lambda g: F.struct((-F.coalesce(g["count"], F.lit(1))).alias("o"), F.lower(g["name"]).alias("name")))), lambda s: s["name"]))


def picked_style(styles: Column, umbrellas: list[str], share: float = 0.35) -> Column:
    """The top style of array<struct<style, p>>, likeliest first, unless it is an umbrella and a specific one of the next two is likely enough."""
    first = F.get(styles, F.lit(0))
    specific = F.filter(F.slice(styles, 2, 2), lambda s: ~F.lower(s["style"]).isin(*umbrellas) & (s["p"] >= first["p"] * share))
    return F.when(F.lower(first["style"]).isin(*umbrellas) & (F.size(specific) > 0), F.get(specific, F.lit(0))["style"]).otherwise(first["style"])
