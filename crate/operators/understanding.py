"""Readable records out of tag probabilities and analysis, and why two tracks are alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crate.functions import music
from crate.functions.vectors import band_breakdown, cosine, cosine_or_null, doubles
from crate.operators.classify import mean_vectors
from crate.operators.knn import pairs_with_small
from crate.storage import saved

#: Names of the classes that are instruments, and that are singing or voices by gender.
INSTRUMENTS = (
    "Guitar", "Electric guitar", "Bass guitar", "Acoustic guitar",
    "Steel guitar, slide guitar", "Banjo", "Sitar", "Mandolin", "Ukulele",
    "Piano", "Electric piano", "Organ", "Electronic organ", "Hammond organ",
    "Synthesizer", "Sampler", "Harpsichord", "Percussion", "Drum kit",
    "Drum machine", "Drum", "Snare drum", "Bass drum", "Timpani", "Tabla",
    "Cymbal", "Hi-hat", "Tambourine", "Maraca", "Gong", "Tubular bells",
    "Mallet percussion", "Marimba, xylophone", "Glockenspiel", "Vibraphone",
    "Steelpan", "Cowbell", "Wood block", "Brass instrument", "French horn",
    "Trumpet", "Trombone", "Bowed string instrument", "String section",
    "Violin, fiddle", "Cello", "Double bass", "Flute", "Saxophone", "Clarinet",
    "Harp", "Harmonica", "Accordion", "Bagpipes", "Didgeridoo", "Theremin",
)
SUNG = ("Singing", "Male singing", "Female singing", "Child singing", "Choir", "Vocal music", "A capella", "Rapping", "Chant", "Synthetic singing")
MALE = ("Male singing", "Male speech, man speaking")
FEMALE = ("Female singing", "Female speech, woman speaking")


def _greatest(probs: Column, names: list[str], wanted: tuple[str, ...]) -> Column:
    """The greatest probability of the classes named, 0 if there is none."""
    held = [F.coalesce(F.get(probs, F.lit(i)), F.lit(0.0)) for i, n in enumerate(names) if n in wanted]
    return F.greatest(*held, F.lit(0.0)) if len(held) > 1 else (held[0] if held else F.lit(0.0))


def instruments(probs: Column, names: list[str], threshold: float = 0.12, most: int = 10) -> Column:
    """array of (name, p), likeliest first; ties by name."""
    rows = [F.struct((-F.coalesce(F.get(probs, F.lit(i)), F.lit(0.0))).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(names) if n in INSTRUMENTS]
    held = F.slice(F.array_sort(F.filter(F.array(*rows), lambda r: -r["o"] >= threshold)), 1, most)
    return F.transform(held, lambda r: F.struct(r["name"].alias("name"), F.round(-r["o"], 3).alias("p")))


def records(tags: DataFrame, analysis: DataFrame, names: list[str]) -> DataFrame:
    """track_id, instruments, vocal, arousal, valence, moods, caption, tags from tags (track_id, probs) and analysis; one row a track of tags."""
    a = analysis.select("track_id", "bpm", "music_key", "energy")
    p = doubles(F.col("probs"))
    rows = tags.join(a, "track_id", "left").select(
        "track_id", "bpm", "music_key",
        instruments(p, names).alias("instruments"),
        music.vocal(_greatest(p, names, SUNG), _greatest(p, names, MALE), _greatest(p, names, FEMALE)).alias("vocal"),
        F.coalesce("energy", F.lit(0.5)).alias("arousal"),
        music.valence(F.col("energy"), F.col("music_key")).alias("valence"),
    )
    rows = rows.withColumn("moods", music.named_moods(F.col("valence"), F.col("arousal"), F.col("bpm")))
    voice = F.when(F.col("vocal.kind") == "instrumental", "instrumental").when(F.col("vocal.gender") != "unknown", F.concat("vocal.gender", F.lit(" vocal"))).otherwise("vocal")
    lead, top = F.col("moods")[0]["mood"], F.transform(F.slice("instruments", 1, 3), lambda i: i["name"])
    has_bpm = F.coalesce(F.col("bpm"), F.lit(0.0)) != 0
    caption = F.concat(
        F.upper(F.substring(lead, 1, 1)), F.substring(lead, F.lit(2), F.length(lead)), F.lit(", "), music.energy_word(F.col("arousal")), F.lit(" "), voice, F.lit(" track"),
        F.when(has_bpm, F.concat(F.lit(" at "), F.bround("bpm").cast("long").cast("string"), F.lit(" BPM"))).otherwise(""),
        F.coalesce(F.concat(F.lit(" in "), "music_key"), F.lit("")), F.lit("."),
        F.when(F.size(top) > 0, F.concat(F.lit(" Prominent "), F.lower(F.array_join(top, ", ")), F.lit("."))).otherwise(""),
    )
    words = F.concat(F.array(voice), F.transform(F.slice("moods", 1, 2), lambda m: m["mood"]), top, F.array(F.col("music_key")))
    return rows.select("track_id", "instruments", "vocal", F.round("arousal", 3).alias("arousal"), F.round("valence", 3).alias("valence"), "moods", caption.alias("caption"), music.distinct_ignoring_case(words).alias("tags"))


def _percent(x: Column) -> Column:
    return F.bround(x * 100).cast("long").cast("string")


def explain(pairs: DataFrame, record: DataFrame, analysis: DataFrame, vectors: DataFrame, spectra: DataFrame) -> DataFrame:
    """a_id, b_id, score, shared, different, bands for pairs (a_id, b_id): what both have, and where they part.

    record is of records(); vectors and spectra have track_id and vector. A side without a record or an analysis adds no lines.
    """
    r = record.select("track_id", F.transform("instruments", lambda i: i["name"]).alias("ins"), F.col("vocal.kind").alias("kind"), F.col("vocal.gender").alias("gender"), F.transform("moods", lambda m: m["mood"]).alias("mood"))
    full = r.join(analysis.select("track_id", "bpm", "music_key", "energy"), "track_id", "full")
    full = full.join(vectors.select("track_id", doubles(F.col("vector")).alias("v")), "track_id", "full").join(spectra.select("track_id", doubles(F.col("vector")).alias("s")), "track_id", "full")
    side = lambda x: full.select(*[F.col(c).alias(f"{x}_{c}" if c != "track_id" else f"{x}_id") for c in full.columns])
    t = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    of = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    (ia, ib), (ka, kb), (ga, gb), (ma, mb) = of("ins"), of("kind"), of("gender"), of("mood")
    (ta, tb), (ya, yb), (ea, eb) = of("bpm"), of("music_key"), of("energy")
    listed = lambda xs: F.lower(F.array_join(F.array_sort(xs), ", "))
    number = lambda x: F.bround(x).cast("long").cast("string")
    some = lambda xs, text: F.when(F.size(xs) > 0, text)
    close, fits = F.abs(ta - tb) <= 4, music.harmonic_distance(music.wheel_position(ya), music.wheel_position(yb)) == 0
    near, known = F.abs(ea - eb) <= 0.12, ka.isNotNull() & kb.isNotNull()
    first_two = lambda xs: F.array_join(F.slice(F.array_sort(xs), 1, 2), "/")
    both, apart = F.array_intersect(ma, mb), (F.size(F.array_intersect(ma, mb)) == 0) & (F.size(ma) > 0) & (F.size(mb) > 0)
    shared = [
        some(F.array_intersect(ia, ib), F.concat(F.lit("instruments: "), listed(F.array_intersect(ia, ib)))),
        F.when(known & (ka == kb), ka),
        F.when((ga != "unknown") & (ga == gb), F.concat(ga, F.lit(" vocal"))),
        some(both, F.concat(F.lit("mood: "), listed(both))),
        F.when(close, F.concat(F.lit("tempo ~"), number((ta + tb) / 2), F.lit(" BPM"))),
        F.when(fits, F.concat(F.lit("key "), F.coalesce(music.wheel_label(music.wheel_position(ya)), ya))),
        F.when(near, F.concat(F.lit("energy ~"), _percent((ea + eb) / 2), F.lit("%"))),
    ]
    different = [
        some(F.array_except(ia, ib), F.concat(F.lit("first has "), listed(F.array_except(ia, ib)))),
        some(F.array_except(ib, ia), F.concat(F.lit("second has "), listed(F.array_except(ib, ia)))),
        F.when(known & (ka != kb), F.concat(ka, F.lit(" vs "), kb)),
        F.when(apart, F.concat(F.lit("mood "), first_two(ma), F.lit(" vs "), first_two(mb))),
        F.when(~close, F.concat(F.lit("tempo "), number(ta), F.lit(" vs "), number(tb), F.lit(" BPM"))),
        F.when(~fits & ya.isNotNull() & yb.isNotNull(), F.concat(F.lit("key "), ya, F.lit(" vs "), yb)),
        F.when(~near, F.concat(F.lit("energy "), _percent(ea), F.lit("% vs "), _percent(eb), F.lit("%"))),
    ]
    held = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return t.select("a_id", "b_id", (F.round(cosine_or_null(F.col("a_v"), F.col("b_v")), 3) + F.lit(0.0)).alias("score"), held(shared).alias("shared"), held(different).alias("different"), band_breakdown(F.col("a_s"), F.col("b_s")).alias("bands"))


def matched_label(queries: DataFrame, names: list[str]) -> DataFrame:
    """queries (query_id, text) with label and class_idx: the class named exactly, else the longest that contains or is contained (plurals too).

    Ties go to the later class; null if none matches.
    """
    labels = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(i).alias("idx"), F.lit(n.lower()).alias("low")) for i, n in enumerate(names)])
    q = F.trim(F.lower("text"))
    bare = F.regexp_replace(q, "s$", "")

    def score(s: Column) -> Column:
        exact = s["low"] == q
        near = q.contains(s["low"]) | s["low"].contains(q) | (F.length(bare) > 2) & (s["low"].contains(bare) | q.contains(F.regexp_replace(s["low"], "s$", "")))
        return F.struct(exact.cast("int").alias("exact"), F.when(exact | near, F.length(s["low"])).otherwise(-1).alias("n"), s["idx"].alias("idx"), s["label"].alias("label"))

    best = F.array_max(F.transform(labels, score))
    rows = queries.withColumn("_b", best)
    ok = F.col("_b.n") > 0
    return rows.select(*queries.columns, F.when(ok, F.col("_b.label")).alias("label"), F.when(ok, F.col("_b.idx")).alias("class_idx"))


def search(queries: DataFrame, tags: DataFrame, names: list[str], prompts: DataFrame, vectors: DataFrame, n: int = 50, threshold: float | None = None) -> DataFrame:
    """query_id, method, label, track_id, score, rank: the best n tracks of each query (query_id, text), or all from a threshold on.

    A query that names a class ranks tracks (track_id, probs) by its probability, method `tags`; any other ranks vectors (track_id, vector) by the
    cosine to the mean of its prompts (query_id, vector), as a z-score over all tracks, method `text`. A query with neither gives no rows. Ties go to
    the smaller track_id.
    """
    m = saved(matched_label(queries, names).select("query_id", "label", "class_idx"), "queries")
    by_class = pairs_with_small(tags.select("track_id", "probs"), m.filter("class_idx is not null"), F.round(F.coalesce(F.get("probs", F.col("class_idx")).cast("double"), F.lit(0.0)), 6))
    asked = mean_vectors(prompts.join(m.filter("class_idx is null").select("query_id"), "query_id", "left_semi"), "query_id").select("query_id", F.col("vector").alias("_q"))
    rows = vectors.filter("vector is not null").select("track_id", doubles(F.col("vector")).alias("_v"))
    near = saved(pairs_with_small(rows, saved(asked, "asked"), cosine(F.col("_q"), F.col("_v"))).select("query_id", "track_id", "score"), "cosines")
    stat = near.groupBy("query_id").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("d"))  # a row a query
    z = F.round((F.col("score") - F.col("m")) / F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")), 6)
    by_text = near.join(stat, "query_id").select("query_id", F.lit("text").alias("method"), F.lit(None).cast("string").alias("label"), "track_id", z.alias("score"))
    out = by_class.select("query_id", F.lit("tags").alias("method"), "label", "track_id", "score").unionByName(by_text)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "track_id"))
    if threshold is not None:
        return out.filter(F.col("score") >= threshold).withColumn("rank", order)
    return out.withColumn("rank", order).filter(F.col("rank") <= n)


def view_of(tags: DataFrame, analysis: DataFrame, names: list[str], stored: DataFrame) -> DataFrame:
    """records() with top_tags, and from stored (track_id, language, language_conf, deep_done) what a deeper pass has found; a row a track of tags."""
    labels = F.array(*[F.lit(x) for x in names])
    top = tags.filter("probs is not null").select("track_id", music.top_tags(doubles(F.col("probs")), labels).alias("top_tags"))
    out = records(tags.filter("probs is not null"), analysis, names).join(top, "track_id").join(stored.select("track_id", "language", "language_conf", "deep_done"), "track_id", "left")
    return out.withColumn("deep_done", F.coalesce("deep_done", F.lit(False))).withColumn("language_conf", F.when(F.length("language") > 0, F.col("language_conf"))).withColumn("language", F.when(F.length("language") > 0, F.col("language")))
