"""Greedy sequences, many at once: radio walks and sets along an energy arc. The batch is what runs in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crate.functions import music, requests
from crate.functions.vectors import once
from crate.operators.knn import Known, top_k
from crate.sources.taxonomy_files import numbered
from crate.storage import bounded, discard, saved

#: Parts of an energy of 1 by which tracks are posted, and the most tracks of a class and cell in a part.
CELLS, PART_ROWS = 1000, 100_000
#: The word and the voice that every track meets.
ANY = "*"


def radio(seeds: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """seed, position (from 0), item_id: from each seed to the most similar item not played yet, n items with the seed.

    A round a step, for all seeds together. Of the current item's nearest, as many are fetched as could all have been
    played, and the first that wasn't is next. Rounds share what is known of the items. items: item_id, vector; seeds: seed. Unknown
    seeds give nothing.
    """
    vectors, known = items.select("item_id", "vector"), Known()
    start = saved(seeds.select("seed", F.col("seed").alias("item_id")), "seeds")
    at = saved(vectors.join(bounded(start), "item_id").select("seed", F.lit(0).alias("position"), "item_id", "vector"), "radio")
    played = at.drop("vector")
    for step in range(1, n):
        asked = at.select(F.col("item_id").alias("query_id"), "vector").dropDuplicates(["query_id"])
        near = top_k(asked, items, step + 1, known=known)
        next_ = at.select("seed", F.col("item_id").alias("query_id")).join(near, "query_id").join(played.select("seed", "item_id"), ["seed", "item_id"], "left_anti")
        first = F.row_number().over(Window.partitionBy("seed").orderBy("rank"))
        found = saved(next_.withColumn("n", first).filter("n = 1").select("seed", "item_id"), "found")
        at = saved(vectors.join(bounded(found), "item_id").select("seed", F.lit(step).alias("position"), "item_id", "vector"), "radio")
        if at.isEmpty():
            break
        played = played.unionByName(at.drop("vector"))
    return played


def even_sample(df: DataFrame, order: str, n: int, group: str) -> DataFrame:
    """n rows of each group, evenly along an order (halves to even); all rows of a smaller group.

    Rows are numbered by ranges of (group, order), so that a group of any size is dealt to many tasks.
    """
    rows = numbered(df, group, order, *[c for c in df.columns if c not in (order, group)][:1])
    size = rows.groupBy(group).agg(F.min("n").alias("_from"), F.count("*").alias("_m"))
    rows = rows.join(size, group).withColumn("_i", F.col("n") - F.col("_from")).drop("n", "_from")
    # Row i is taken if some k of 0 .. n-1 rounds to it.
    step = (F.col("_m") - 1) / F.lit(max(n - 1, 1))
    k = F.round(F.col("_i") / step)
    hit = F.array(k - 1, k, k + 1)
    chosen = F.exists(hit, lambda j: (j >= 0) & (j <= n - 1) & (F.bround(j * step) == F.col("_i")))
    return rows.filter((F.col("_m") <= n) | chosen).select(*df.columns)


def set_pool(candidates: DataFrame, wishes: DataFrame, most: int = 80) -> DataFrame:
    """Candidates (request_id, track_id, genre, energy) of each wish (request_id, genres, want), at most `most`, evenly along energy (null: 0.5).

    Only those of a wished genre, where at least max(2 want, 16) are; a wish without genres, or with too few, keeps all.
    """
    w = wishes.select("request_id", "genres", "want")
    genre = F.lower("genre")
    rows = candidates.join(w, "request_id").withColumn("_in", F.coalesce(F.exists("genres", lambda g: genre.contains(F.lower(g))), F.lit(False)))
    enough = rows.groupBy("request_id").agg((F.count_if("_in") >= F.greatest(F.first("want") * 2, F.lit(16))).alias("_enough"))
    kept = rows.join(enough, "request_id").filter("_in or not _enough").withColumn("_e", F.coalesce("energy", F.lit(0.5)))
    return even_sample(kept.select("request_id", "_e", "track_id", "genre", "energy"), "_e", most, "request_id").select("request_id", "track_id", "genre", "energy")


def build_sets(wishes: DataFrame, tracks: DataFrame, default_length: int = 12) -> DataFrame:
    """request_id, position, track_id, target: for each wish (request_id, text) the tracks along its arc.

    tracks: track_id (a key; null takes no part), energy (null or NaN: 0.5), bpm, music_key, genre, vocal, gender, moods, instruments
    (all may be null). A filter that would leave nothing is ignored. Each step takes, of all tracks that the filters leave, the unused
    one with the least (energy gap, missing attributes, harmonic distance, tempo step, id); without tracks there are no rows.

    A text is read once, however many wishes have it, and wishes that ask for the same are worked out once. Tracks are posted by class (what of a wish's filters they satisfy) and cell (a
    thousandth of energy). A step opens the cells around its target in which, by the counts of postings, an unused track may be
    nearest, so that it meets the tracks of a few cells instead of all; the result is that of all. State is a row for each different wish.
    """
    wishes = wishes.select("request_id", F.coalesce("text", F.lit("")).alias("text"))
    parsed = requests.parsed(wishes.select("text").distinct()).withColumn("want", F.coalesce("length", F.lit(default_length)))
    parsed = parsed.withColumn("plan", F.sha2(F.to_json(F.struct("genres", "vocal", "gender", "moods", "instruments", "energies", "want")), 256))
    parsed = saved(parsed.select("text", "plan", "genres", F.coalesce("gender", "vocal", F.lit(ANY)).alias("voice"), "moods", "instruments", "energies", "want"), "wishes")
    t, posted = _posted(tracks)
    plans = parsed.dropDuplicates(["plan"]).withColumn("filter", F.to_json(F.struct("genres", "voice")))
    places = saved(_allowed(plans.select("filter", "genres", "voice").dropDuplicates(["filter"]), posted), "places")
    counts = places.groupBy("filter", "cell").agg(F.sum("n").alias("n")).groupBy("filter").agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    counts = saved(counts.withColumn("size", F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])), "counts")
    want = F.greatest(F.lit(1), F.least("want", "size")).cast("int").alias("want")
    state = plans.join(counts, "filter").select("plan", "filter", "moods", "instruments", "energies", want).withColumn("targets", requests.resampled(F.col("energies"), F.col("want")))
    state = state.select("plan", "filter", "want", "targets", "moods", "instruments", F.array().cast("array<struct<track_id:bigint,cell:bigint>>").alias("used"), F.lit(None).cast("double").alias("prev_bpm"), F.lit(None).cast("struct<n:int,ring:string>").alias("prev_place"))
    state = saved(state, "state")
    for i in range(state.agg(F.max("want")).first()[0] or 0):
        now = state.filter(F.col("want") > i).withColumn("target", F.get("targets", F.lit(i)))
        probes = now.join(counts.select("filter", "cells"), "filter").withColumn("cell", F.explode(_nearest_cells(F.col("cells"), F.col("used"), F.col("target"))))
        probes = probes.join(places.select("filter", "cell", "class", "parts"), ["filter", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = probes.select("plan", "class", "cell", "part", "target", "prev_bpm", "prev_place", F.col("moods").alias("want_moods"), F.col("instruments").alias("want_instruments"), F.transform("used", lambda u: u["track_id"]).alias("gone"))
        rows = t.join(bounded(asked), ["class", "cell", "part"]).filter(~F.array_contains("gone", F.col("track_id")))
        best = rows.groupBy("plan").agg(F.min_by(F.struct("track_id", "cell", "bpm", "place"), _step_key()).alias("b"))
        found = F.when(F.col("b").isNull(), F.col("used")).otherwise(F.concat("used", F.array(F.struct("b.track_id", "b.cell"))))
        kept = ["plan", "filter", "want", "targets", "moods", "instruments"]
        after = saved(state.join(best, "plan", "left").select(*kept, found.alias("used"), F.coalesce("b.bpm", "prev_bpm").alias("prev_bpm"), F.coalesce("b.place", "prev_place").alias("prev_place")), "state")
        discard(state)
        state = after
    sets = state.select("plan", "targets", F.posexplode("used").alias("position", "u")).select("plan", "position", F.col("u.track_id").alias("track_id"), F.get("targets", F.col("position")).alias("target"))
    return wishes.join(bounded(parsed.select("text", "plan")), "text").select("request_id", "plan").join(bounded(saved(sets, "sets")), "plan").select("request_id", "position", "track_id", "target")


def _posted(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks with class, cell and part, and the postings: class, cell, n tracks in so many parts, with the words and voices of the class.

    A class is the set of genre words that meet the track's genre (either contains the other) with its voice and gender, so there are
    few, however many genres there are. It is worked out once for tracks of equal genre, voice and gender. A class and cell of many
    tracks is dealt to parts of PART_ROWS.
    """
    genre = F.lower("genre")
    words = F.filter(F.array(*[F.lit(w) for w in requests.GENRE_WORDS]), lambda w: F.coalesce(genre.contains(w) | w.contains(genre), F.lit(False)))
    sung = F.when(F.col("vocal") == "uncertain", F.array(F.lit("vocal"), F.lit("instrumental"))).when(F.col("vocal").isin("vocal", "instrumental"), F.array("vocal")).otherwise(F.array().cast("array<string>"))
    voices = F.concat(F.array(F.lit(ANY)), sung, F.when(F.col("gender").isin("female", "male"), F.array("gender")).otherwise(F.array().cast("array<string>")))
    energy = F.nanvl(F.coalesce("energy", F.lit(0.5)), F.lit(0.5))
    kind = F.struct(words.alias("words"), voices.alias("voices"))
    kinds = saved(tracks.select("genre", "vocal", "gender").distinct().withColumn("class", F.to_json(kind)), "kinds").withColumnsRenamed({c: f"_{c}" for c in ("genre", "vocal", "gender")})
    t = tracks.filter("track_id is not null").join(bounded(kinds), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("genre", "vocal", "gender")])
    t = t.select(F.col("track_id").cast("long").alias("track_id"), energy.alias("energy"), "bpm", music.wheel_position(F.col("music_key")).alias("place"), "moods", "instruments", "class")
    t = saved(t.withColumn("cell", F.floor(F.col("energy") * CELLS)), "tracks")
    posted = t.groupBy("class", "cell").agg(F.count("*").alias("n")).withColumn("kind", F.from_json("class", "words array<string>, voices array<string>"))
    posted = saved(posted.select("class", "cell", "n", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"), "kind.words", "kind.voices"), "postings")
    if posted.filter("parts > 1").isEmpty():
        return t.withColumn("part", F.lit(0)), posted
    dealt = t.join(bounded(posted.select("class", "cell", "parts")), ["class", "cell"])
    return saved(dealt.withColumn("part", F.pmod(F.xxhash64("track_id"), F.col("parts")).cast("int")).drop("parts"), "tracks"), posted


def _allowed(filters: DataFrame, posted: DataFrame) -> DataFrame:
    """filter, class, cell, n, parts: the postings that each filter (filter, genres, voice) leaves. Wishes meet classes by genre word."""
    classes = posted.groupBy("class").agg(F.first("words").alias("words"), F.first("voices").alias("voices"))
    by_word = classes.select("class", "voices", F.explode(F.concat("words", F.array(F.lit(ANY)))).alias("word"))
    asked = filters.select("filter", "voice", F.explode(F.concat("genres", F.array(F.lit(ANY)))).alias("word"))
    met = asked.join(by_word, "word").groupBy("filter", "voice", "class").agg(F.first("voices").alias("voices"), F.max(F.col("word") != ANY).alias("named"))
    own = Window.partitionBy("filter")
    met = met.withColumn("some", F.max("named").over(own)).filter("named or not some")
    met = met.withColumn("sings", F.expr("array_contains(voices, voice)")).withColumn("some", F.max("sings").over(own)).filter("sings or not some")
    return met.select("filter", "class").join(posted.select("class", "cell", "n", "parts"), "class")


def _nearest_cells(cells: Column, used: Column, target: Column) -> Column:
    """Cells that may hold the unused track nearest to a target: no farther off than the far end of the best cell with one left.

    Gaps are compared in thousandths, so cells up to one more than that are opened.
    """
    low, high = (lambda c: c["cell"] / CELLS), (lambda c: (c["cell"] + 1) / CELLS)
    left = F.filter(cells, lambda c: c["n"] > F.size(F.filter(used, lambda u: u["cell"] == c["cell"])))
    reach = F.array_min(F.transform(left, lambda c: F.greatest(F.abs(low(c) - target), F.abs(high(c) - target)))) + 1.1 / CELLS
    near = once(reach, lambda r: F.filter(cells, lambda c: F.greatest(low(c) - target, target - high(c)) <= r))
    return F.transform(near, lambda c: c["cell"])


def _step_key() -> Column:
    """What a step prefers in a track for a plan, least first."""
    wanted = F.size("want_moods") + F.size("want_instruments")
    empty = F.array().cast("array<string>")
    hit = F.size(F.array_intersect("want_moods", F.coalesce("moods", empty))) + F.size(F.array_intersect("want_instruments", F.coalesce("instruments", empty)))
    share = F.when(wanted > 0, hit / wanted).otherwise(0.0)
    far = F.when(F.col("prev_place").isNull(), 0.0).otherwise(music.harmonic_distance(F.col("prev_place"), F.col("place")))
    return F.struct(F.round(F.abs(F.col("energy") - F.col("target")), 3), F.round(-share, 3), F.round(far, 3), F.coalesce(F.abs(F.col("bpm") - F.col("prev_bpm")), F.lit(0.0)), F.col("track_id"))
