"""Reconciling metadata: a waterfall of sources, style agreement, graphs of dumps, gates on proposals, groups with names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crate.functions import music
from crate.storage import saved


def waterfall(tracks: DataFrame, fingerprint: DataFrame, styles: DataFrame, text: DataFrame) -> DataFrame:
    """track_id, artist, title, year, area, genres, source: the first source with genres wins, others fill empty fields.

    Each source has track_id, artist, title, year, area, genres (array); a row a track. Tracks that no source gives genres or an
    artist are left out.
    """
    out = tracks.select("track_id")
    fields = ["artist", "title", "year", "area"]
    for name, source in (("fingerprint", fingerprint), ("styles", styles), ("text", text)):
        out = out.join(source.select("track_id", *[F.col(c).alias(f"{name}_{c}") for c in [*fields, "genres"]]), "track_id", "left")
    order = ("fingerprint", "styles", "text")
    some = lambda n: F.size(F.coalesce(F.col(f"{n}_genres"), F.array().cast("array<string>"))) > 0
    genres, source = F.when(some(order[0]), F.col("fingerprint_genres")), F.when(some(order[0]), order[0])
    for n in order[1:]:
        genres, source = genres.when(some(n), F.col(f"{n}_genres")), source.when(some(n), n)
    rows = out.select("track_id", *[F.coalesce(*[F.col(f"{n}_{c}") for n in order]).alias(c) for c in fields], genres.alias("genres"), source.alias("source"))
    return rows.filter("genres is not null or artist is not null")


def flat_recording(json: Column) -> Column:
    """struct(mbid, title, artist, year, genres, area) of a recording's JSON."""
    schema = "id string, title string, `first-release-date` string, genres array<struct<name:string,count:int>>, `artist-credit` array<struct<name:string>>, releases array<struct<country:string,`release-events`:array<struct<area:struct<name:string>>>,`release-group`:struct<genres:array<struct<name:string,count:int>>>>>"
    r = F.from_json(json, schema)
    own = F.coalesce(r["genres"], F.array().cast("array<struct<name:string,count:int>>"))
    group = F.flatten(F.transform(F.coalesce(r["releases"], F.array().cast("array<struct<country:string,`release-events`:array<struct<area:struct<name:string>>>,`release-group`:struct<genres:array<struct<name:string,count:int>>>>>")), lambda x: F.coalesce(x["release-group"]["genres"], F.array().cast("array<struct<name:string,count:int>>"))))
    names = F.array_distinct(F.transform(F.concat(own, group), lambda g: F.lower(g["name"])))
    country = F.get(F.filter(F.transform(r["releases"], lambda x: x["country"]), lambda c: c.isNotNull()), F.lit(0))
    event = F.get(F.filter(F.flatten(F.transform(r["releases"], lambda x: F.transform(F.coalesce(x["release-events"], F.array().cast("array<struct<area:struct<name:string>>>")), lambda e: e["area"]["name"]))), lambda c: c.isNotNull()), F.lit(0))
    year = F.substring(r["first-release-date"], 1, 4).try_cast("int")
    return F.struct(r["id"].alias("mbid"), r["title"].alias("title"), F.get(r["artist-credit"], F.lit(0))["name"].alias("artist"), year.alias("year"), names.alias("genres"), F.coalesce(country, event).alias("area"))


def graph_of_dump(genre: DataFrame, link_type: DataFrame, link: DataFrame, ends: DataFrame) -> DataFrame:
    """src, dst, rel: links between two genres. genre (id, name), link_type (id, e0, e1, name), link (id, type_id), ends (link_id, from_id, to_id)."""
    types = link_type.filter("e0 = 'genre' and e1 = 'genre'").select(F.col("id").alias("type_id"), music.relation(F.col("name")).alias("rel"))
    a, b = genre.select(F.col("id").alias("from_id"), F.col("name").alias("dst")), genre.select(F.col("id").alias("to_id"), F.col("name").alias("src"))
    rows = link.withColumnRenamed("id", "link_id").join(F.broadcast(types), "type_id").join(ends, "link_id").join(a, "from_id").join(b, "to_id")
    return rows.select(F.lower("src").alias("src"), F.lower("dst").alias("dst"), "rel").distinct()


def merged_edges(base: DataFrame, curated: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Base edges, and curated ones that are new and whose child is known."""
    fresh = curated.join(base.select("src", "dst"), ["src", "dst"], "left_anti").join(vocabulary.select(F.lower("name").alias("src")), "src", "left_semi")
    return base.unionByName(fresh.select(*base.columns))


def style_agreement(labels: DataFrame, styles: DataFrame, accept: DataFrame, top: int = 5) -> DataFrame:
    """track_id, genre, hit: whether one of a track's top styles contains a name that its genre accepts; without a list, its own name.

    labels (track_id, genre), styles (track_id, styles: array<struct<style, p>> likeliest first), accept (genre, names array).
    """
    rows = labels.join(styles, "track_id").join(F.broadcast(accept), "genre", "left")
    names = F.coalesce("names", F.array(F.col("genre")))
    hit = F.exists(F.slice("styles", 1, top), lambda s: F.exists(names, lambda n: F.contains(F.lower(s["style"]), F.lower(n))))
    return rows.select("track_id", "genre", hit.alias("hit"))


def agreement(rows: DataFrame) -> DataFrame:
    """genre (null: all), n, hits, rate of style_agreement()."""
    said = rows.groupBy("genre").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    both = said.unionByName(said.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter("n is not null").withColumn("genre", F.lit(None).cast("string")))
    return both.withColumn("rate", F.col("hits") / F.col("n"))


def accepted_proposals(proposals: DataFrame, identified: DataFrame, analysis: DataFrame, least: float = 0.6) -> DataFrame:
    """Proposals (track_id, genre, confidence) for tracks without genres that are named, sure and of a plausible tempo."""
    rows = proposals.join(identified.filter("size(genres) > 0").select("track_id"), "track_id", "left_anti").join(analysis.select("track_id", "bpm"), "track_id", "left")
    return rows.filter((F.length(F.trim("genre")) > 0) & (F.col("confidence") >= least) & music.tempo_plausible(F.col("genre"), F.col("bpm"))).select(*proposals.columns)


def accepted_order(proposed: DataFrame, pool: DataFrame) -> DataFrame:
    """Proposed positions (request_id, position, track_id, reason) of known tracks, each once, reasons cut to 140."""
    n = F.row_number().over(Window.partitionBy("request_id", "track_id").orderBy("position"))
    kept = proposed.join(pool.select("track_id"), "track_id", "left_semi").withColumn("_n", n).filter("_n = 1")
    order = F.row_number().over(Window.partitionBy("request_id").orderBy("position"))
    return kept.select("request_id", order.alias("position"), "track_id", F.substring("reason", 1, 140).alias("reason"))


#: Names that say too little to place a track.
UMBRELLAS = ["electronic", "electronica", "edm", "dance", "club", "pop", "instrumental", "experimental", "electro", "leftfield"]


def own_genres(own: DataFrame, analysis: DataFrame) -> DataFrame:
    """track_id, genre, major, confidence: of each track's genres (track_id, genres) the first one of a plausible tempo that is more specific
    than its family, at 0.85; else the family of the first plausible one, with a null genre, at 0.6.

    Umbrella names count only where a track has no others. Where at least 60 % of all names are of electronic families, others are taken
    for namesakes and dropped. Null or empty lists give no row.
    """
    listed = F.transform("genres", lambda g: F.lower(g))
    specific = F.filter(listed, lambda g: ~g.isin(*UMBRELLAS))
    said = own.select("track_id", F.posexplode(F.when(F.size(specific) > 0, specific).otherwise(listed)).alias("i", "name")).filter("name is not null")
    said = said.withColumn("major", music.major_of(F.col("name"))).withColumn("style", music.clean_genre(F.col("name")))
    electronic = F.col("major").isin(*music.ELECTRONIC)
    share = said.agg((F.avg(electronic.cast("double")) >= 0.6).alias("_gate"))  # one row
    rows = said.crossJoin(F.broadcast(share)).filter(~F.col("_gate") | electronic).join(analysis.select("track_id", "bpm"), "track_id", "left")
    rows = rows.filter(music.tempo_plausible(F.col("name"), F.col("bpm"), music.GROUPING_TEMPO)).withColumn("broad", F.col("style") == F.col("major"))
    best = rows.groupBy("track_id").agg(F.min_by(F.struct("style", "major", "broad"), F.struct("broad", "i")).alias("b"))
    return best.select("track_id", F.when(~F.col("b.broad"), F.col("b.style")).alias("genre"), "b.major", F.when(F.col("b.broad"), 0.6).otherwise(0.85).alias("confidence"))


def labelled(own: DataFrame, labels: DataFrame, genres: DataFrame) -> DataFrame:
    """own_genres() with the tracks that were given as examples (labels: genre_id, track_id) under the genre they stand for, at 1.0.

    genres: genre_id, name, parent_id. The family is the parent's name, else that of the name; of several genres the greatest id counts.
    """
    parents = genres.select(F.col("genre_id").alias("parent_id"), F.col("name").alias("_parent"))
    named = genres.select("genre_id", "name", "parent_id").join(parents, "parent_id", "left")
    rows = labels.join(named, "genre_id").groupBy("track_id").agg(F.max_by(F.struct("name", "_parent"), "genre_id").alias("g"))
    given = rows.select("track_id", F.col("g.name").alias("genre"), F.coalesce("g._parent", music.major_of(F.col("g.name"))).alias("major"), F.lit(1.0).alias("confidence"))
    return own.join(given.select("track_id"), "track_id", "left_anti").unionByName(given)


def organised(own: DataFrame, vectors: DataFrame, analysis: DataFrame, least: float = 0.5, tempo: float = 14.0) -> DataFrame:
    """track_id, genre, major, confidence, via: every track of vectors and own, by its own genre or that of an anchor.

    own: track_id, genre (null: the family only), major, and confidence (1.0 where there is no such column).
    Anchors are tracks whose own genre is more specific than its major. Of all anchors that are at least so similar and close in tempo
    (unknown passes), a track without such a genre takes the most similar, those of its own major before others. Where none
    qualifies it is unsorted: genre is null, and the major its own or else that of the nearest anchor. vectors: track_id, vector.
    """
    from crate.operators.knn import top_k

    broad = F.col("genre").isNull() | F.lower("genre").isin(*UMBRELLAS) | (F.lower("genre") == F.lower("major"))
    sure = F.col("confidence") if "confidence" in own.columns else F.lit(1.0)
    kept = own.select("track_id", F.when(~broad, F.col("genre")).alias("genre"), "major", broad.alias("broad"), sure.alias("sure"))
    v = vectors.join(analysis.select("track_id", "bpm"), "track_id", "left").join(kept.drop("sure"), "track_id", "left")
    todo = saved(v.filter("genre is null").select(F.col("track_id").alias("query_id"), "vector", "bpm", "major"), "unplaced")
    anchors = saved(v.filter("genre is not null").select(F.col("track_id").alias("item_id"), "vector", "bpm", "major", "genre"), "anchors")
    found = saved(top_k(todo, anchors, 1, floor=least, apart=("bpm", tempo), prefer="major"), "filled")
    nearest = top_k(todo.join(found.select("query_id"), "query_id", "left_anti"), anchors, 1)
    of = anchors.select("item_id", "genre", F.col("major").alias("anchor_major"))
    similar = found.join(of, "item_id").select(F.col("query_id").alias("track_id"), "genre", F.col("anchor_major").alias("major"), F.col("score").alias("confidence"), F.lit("similar").alias("via"))
    none = F.lit(None).cast("string")
    rest = nearest.join(of, "item_id").join(todo.select("query_id", "major"), "query_id")
    unsorted = rest.select(F.col("query_id").alias("track_id"), none.alias("genre"), F.coalesce("major", "anchor_major").alias("major"), F.col("score").alias("confidence"), F.lit("unsorted").alias("via"))
    have = kept.filter("not broad").select("track_id", "genre", "major", F.col("sure").alias("confidence"), F.lit("own").alias("via"))
    # A broad genre that no anchor was compared with (no vector, or no anchors at all) still gives the major.
    alone = kept.filter("broad").join(similar.select("track_id"), "track_id", "left_anti").join(unsorted.select("track_id"), "track_id", "left_anti")
    alone = alone.select("track_id", none.alias("genre"), "major", F.col("sure").alias("confidence"), F.lit("unsorted").alias("via"))
    return have.unionByName(similar).unionByName(unsorted).unionByName(alone)


def filled_from_anchors(own: DataFrame, vectors: DataFrame, analysis: DataFrame, least: float = 0.5, tempo: float = 14.0) -> DataFrame:
    """The tracks that organised() gives a genre."""
    return organised(own, vectors, analysis, least, tempo).filter("genre is not null")


def tree_of(placed: DataFrame) -> DataFrame:
    """major, sub (null for the major's own row), n: sizes of both levels in one pass, from (major, genre); no genre is '<major> - Unsorted'."""
    named = placed.select("major", F.coalesce("genre", F.concat("major", F.lit(" - Unsorted"))).alias("genre"))
    return named.rollup("major", "genre").agg(F.count("*").alias("n")).filter("major is not null").select("major", F.col("genre").alias("sub"), "n")


def family_share(genres: DataFrame, families: list[str]) -> DataFrame:
    """share, is_family: how many mentions (track_id, genres) belong to the families, and whether at least 60 % do."""
    rows = genres.select(F.explode("genres").alias("g"))
    hit = F.exists(F.array(*[F.lit(f) for f in families]), lambda f: F.contains(F.lower("g"), f))
    return rows.agg(F.avg(hit.cast("double")).alias("share")).select("share", (F.col("share") >= 0.6).alias("is_family"))


def artist_region(begin_area: Column, area: Column) -> Column:
    """The region of an artist: where they began, else where they are; empty names don't count."""
    named = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(named(begin_area), named(area))


def with_artists(recordings: DataFrame, artists: DataFrame) -> DataFrame:
    """Recordings (track_id, artist_id, genres, area) with their artist's genres where they have none, and area where theirs is null.

    artists: artist_id, genres, area. Genres keep their order, each once; a recording without any has an empty list.
    """
    of = artists.select("artist_id", F.col("genres").alias("_genres"), F.col("area").alias("_area"))
    own = F.when(F.size("genres") > 0, F.col("genres"))
    found = F.array_distinct(F.coalesce(own, "_genres", F.array().cast("array<string>")))
    return recordings.join(of, "artist_id", "left").select("track_id", "artist_id", found.alias("genres"), F.coalesce("area", "_area").alias("area"))
