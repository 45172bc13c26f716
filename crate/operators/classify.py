"""Genres by example: centroids, nearest exemplars, suggestions with a review threshold, and how right they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crate.functions.music import top_tags
from crate.functions.vectors import cosine, doubles, l2_normalize
from crate.operators.knn import pairs_with_small, top_k
from crate.storage import saved

#: Entries of sums that a task holds before it hands them on.
HELD = 4_000_000


def _sums(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """key, i, s, n: sum and count of each position of the vectors of a group.

    Tasks add up whole vectors, a batch at a time, and hand on a row a key and position: what is shuffled doesn't grow with the rows.
    """
    rows = rows.filter(F.col(vec).isNotNull()).select(F.col(key).alias("key"), doubles(F.col(vec)).alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out(kind: pa.DataType) -> pa.RecordBatch:
            names, sums, counts = list(held), [s for s, _ in held.values()], [n for _, n in held.values()]
            sizes = [len(s) for s in sums]
            keys = pa.array(names, kind).take(pa.array(np.repeat(np.arange(len(names)), sizes)))
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            return pa.RecordBatch.from_arrays([keys, pa.array(places), pa.array(np.concatenate(sums)), pa.array(np.concatenate(counts))], ["key", "i", "s", "n"])

        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            values, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0))
            there, x = np.asarray(values.is_valid()), np.asarray(values.fill_null(0.0), dtype=float)
            starts = np.cumsum(sizes) - sizes
            names = keys.dictionary_encode(null_encoding="encode")
            codes = np.asarray(names.indices)
            for code, name in enumerate(names.dictionary.to_pylist()):
                for d in np.unique(sizes[codes == code]).tolist():
                    at = starts[(codes == code) & (sizes == d)][:, None] + np.arange(d)
                    s, n = held.get(name, (np.zeros(0), np.zeros(0, np.int64)))
                    if len(s) < d:
                        s, n = np.pad(s, (0, d - len(s))), np.pad(n, (0, d - len(n)))
                    s[:d] += x[at].sum(axis=0)
                    n[:d] += there[at].sum(axis=0)
                    held[name] = s, n
            if sum(len(s) for s, _ in held.values()) > HELD:
                yield out(keys.type)
                held.clear()
        if held and any(len(s) for s, _ in held.values()):
            yield out(keys.type)

    parts = rows.mapInArrow(add, f"key {rows.schema['key'].dataType.simpleString()}, i int, s double, n long")
    return parts.groupBy("key", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def mean_vectors(rows: DataFrame, key: str, vec: str = "vector", unit: bool = True) -> DataFrame:
    """key, vector: the element-wise mean over a group, of unit length unless unit is False; no row for a group without vectors.

    A null entry counts for nothing; vectors of several lengths are averaged position by position.
    """
    means = _sums(rows, key, vec).select("key", "i", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("m"))
    gathered = means.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"))
    v = F.transform("ms", lambda s: s["m"])
    return gathered.select(F.col("key").alias(key), (l2_normalize(v) if unit else v).alias("vector"))


def refreshed(centroids: DataFrame, exemplars: DataFrame, space: DataFrame) -> DataFrame:
    """Centroids (genre_id, vector) after a change of space: means of the examples' vectors there.

    exemplars: genre_id, track_id, a pair given twice counting once; space: track_id, vector. A genre none of whose examples has a vector keeps the centroid it had, if any.
    """
    from crate.sources.tables import replace_group

    rows = exemplars.select("genre_id", "track_id").distinct().join(space.filter("vector is not null").select("track_id", "vector"), "track_id")
    return replace_group(centroids.select("genre_id", "vector"), saved(mean_vectors(rows, "genre_id"), "centroids"), ["genre_id"])


def elementwise_max(rows: DataFrame, key: str, vec: str = "vector") -> DataFrame:
    spread = rows.filter(F.col(vec).isNotNull()).select(key, F.posexplode(doubles(F.col(vec))).alias("i", "x"))
    tops = spread.groupBy(key, "i").agg(F.max("x").alias("m"))
    return tops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms")).select(key, F.transform("ms", lambda s: s["m"]).alias("vector"))


def centroid_scores(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """item_id, genre_id, score (6 decimals) for items (item_id, vector) and centroids (genre_id, vector)."""
    c = centroids.select("genre_id", doubles(F.col("vector")).alias("_c"))
    rows = items.select("item_id", doubles(F.col("vector")).alias("_v")).filter("_v is not null")
    return pairs_with_small(rows, c, F.round(cosine(F.col("_v"), F.col("_c")), 6)).select("item_id", "genre_id", "score")


def exemplar_scores(items: DataFrame, exemplars: DataFrame) -> DataFrame:
    """item_id, genre_id, score: the mean cosine to the genre's exemplars (genre_id, vector).

    The mean of cosines is the cosine's numerator with the mean of the unit exemplars, so exemplars are averaged first:
    the work is items times genres, however many exemplars there are.
    """
    unit = exemplars.filter(F.col("vector").isNotNull()).select("genre_id", l2_normalize(doubles(F.col("vector"))).alias("vector"))
    means = mean_vectors(unit, "genre_id", unit=False).select("genre_id", F.col("vector").alias("_c"))
    rows = items.select("item_id", l2_normalize(doubles(F.col("vector"))).alias("_v")).filter("_v is not null")
    dot = F.aggregate(F.zip_with("_v", "_c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs_with_small(rows, means, F.round(dot, 6)).select("item_id", "genre_id", "score")


def blended(scores: DataFrame, zero_shot: DataFrame, method: str = "centroid") -> DataFrame:
    """Scores (item_id, name, genre_id, score) joined on name with zero_shot (item_id, name, score): their mean where both exist.

    The method is `zeroshot` where that part is greater or alone. Of genres with one name, the greatest id counts.
    """
    s = scores.groupBy("item_id", "name").agg(F.max_by("score", "genre_id").alias("p"), F.max("genre_id").alias("genre_id"))
    z = zero_shot.select("item_id", "name", F.col("score").cast("double").alias("z"))
    both = s.join(z, ["item_id", "name"], "full")
    score = F.when(F.col("p").isNotNull() & F.col("z").isNotNull(), (F.col("p") + F.col("z")) / 2).otherwise(F.coalesce("p", "z"))
    label = F.when(F.col("z").isNotNull() & (F.col("p").isNull() | (F.col("z") > F.col("p"))), "zeroshot").otherwise(method)
    return both.select("item_id", "name", "genre_id", score.alias("score"), label.alias("method"))


def suggest(scores: DataFrame, top: int = 3, threshold: float = 0.35, method: str = "centroid") -> DataFrame:
    """item_id, genre_id, confidence, rank (from 0), method: the best genres; one row without a genre if the best is below threshold."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "genre_id")
    ranked = scores.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < max(top, 1))
    best = F.max("score").over(Window.partitionBy("item_id"))
    kept = ranked.withColumn("best", best).filter((F.col("rank") == 0) | ((F.col("best") >= threshold) & (F.col("rank") < top)))
    label = F.col("method") if "method" in scores.columns else F.lit(method)
    return kept.select("item_id", F.when(F.col("best") >= threshold, F.col("genre_id")).alias("genre_id"), F.col("score").alias("confidence"), "rank", F.when(F.col("best") >= threshold, label).otherwise(method).alias("method"))


def accuracy_report(suggestions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """genre_id, precision, recall, top1, top3 (the last two over all): suggestions of rank 0 count if confident enough.

    truth has item_id and genre_id. Empty denominators give 0.
    """
    t = truth.select("item_id", F.col("genre_id").alias("true_id"))
    first = suggestions.filter((F.col("rank") == 0) & F.col("genre_id").isNotNull() & (F.col("confidence") >= threshold)).select("item_id", F.col("genre_id").alias("said_id"))
    near = suggestions.filter((F.col("rank") < 3) & (F.col("confidence") >= threshold)).join(t, "item_id").filter(F.col("genre_id") == F.col("true_id")).select("item_id").distinct().withColumn("near", F.lit(1))
    rows = t.join(first, "item_id", "left").join(near, "item_id", "left")
    hit = (F.col("said_id") == F.col("true_id")).cast("int")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("h1"), F.coalesce(F.sum("near"), F.lit(0)).alias("h3"))
    # The said genre gets a hit or a false alarm, the true one a hit or a miss.
    per = rows.select(F.explode(F.array(F.struct(F.col("true_id").alias("genre_id"), hit.alias("tp"), F.lit(0).alias("fp"), (1 - F.coalesce(hit, F.lit(0))).alias("fn")), F.struct(F.col("said_id").alias("genre_id"), F.lit(0).alias("tp"), (1 - hit).alias("fp"), F.lit(0).alias("fn")))).alias("s")).select("s.*").filter("genre_id is not null")
    by = per.groupBy("genre_id").agg(F.sum(F.coalesce("tp", F.lit(0))).alias("tp"), F.sum(F.coalesce("fp", F.lit(0))).alias("fp"), F.sum("fn").alias("fn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return by.crossJoin(F.broadcast(total)).select("genre_id", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("h1"), F.col("n")).alias("top1"), rate(F.col("h3"), F.col("n")).alias("top3"))


#: Parts of a class that are numbered by themselves, so that no task numbers a whole class.
DEALS = 256


def grouped_folds(members: DataFrame, folds: int = 5) -> DataFrame:
    """group_id, fold of the groups of members (group_id, label): dealt in turn within each class, so that folds differ by a group of it at most.

    A group's class is its commonest label (the smaller on ties); groups without a label are left out. Classes begin at different folds.
    """
    own = saved(vote(members, "group_id", "label").select("group_id", "label", F.pmod(F.xxhash64("group_id"), F.lit(DEALS)).alias("deal")), "classes")
    sizes = own.groupBy("label", "deal").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("deal")) - F.col("n")  # at most DEALS rows a class
    nth = F.row_number().over(Window.partitionBy("label", "deal").orderBy("group_id")) - 1
    placed = own.withColumn("nth", nth).join(sizes.select("label", "deal", before.alias("before")), ["label", "deal"])
    return placed.select("group_id", F.pmod(F.col("nth") + F.col("before") + F.pmod(F.xxhash64("label"), F.lit(folds)), F.lit(folds)).cast("int").alias("fold"))


def cross_validated(rows: DataFrame, folds: int = 5, group: str | None = None) -> DataFrame:
    """fold, n, accuracy of the prototype classifier on rows (item_id, genre_id, vector); folds are dealt within each genre.

    With group, a column of rows, all rows of a group are in one fold, as windows of a track must be.
    """
    if group:
        dealt = grouped_folds(rows.select(F.col(group).alias("group_id"), F.col("genre_id").alias("label")), folds)
        numbered = rows.join(dealt.withColumnRenamed("group_id", group), group)
    else:
        numbered = rows.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy("genre_id").orderBy("item_id")) - 1, F.lit(folds)))
    copies = numbered.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter(F.col("fold") != F.col("test"))
    copies = copies.filter("genre_id is not null").withColumn("key", F.concat_ws(":", "test", "genre_id"))
    part = lambda i: F.element_at(F.split("key", ":", 2), i)
    protos = mean_vectors(copies, "key").select(part(1).cast("int").alias("fold"), part(2).cast(rows.schema["genre_id"].dataType).alias("said"), F.col("vector").alias("_c"))
    scored = numbered.join(F.broadcast(protos), "fold").withColumn("score", F.round(cosine(doubles(F.col("vector")), F.col("_c")), 6))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "said"))).filter("n = 1")
    return best.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("said") == F.col("genre_id")).cast("double")).alias("accuracy"))


def vote(members: DataFrame, group: str, label: str) -> DataFrame:
    """group, label, votes: the commonest label of each group, the smaller on ties; null labels don't vote."""
    counts = members.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("votes"))
    return counts.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("votes"), label))).filter("n = 1").drop("n")


def confirm(confirmed: DataFrame, assignments: DataFrame, exemplars: DataFrame, centroids: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assignments, exemplars and centroids after a batch of confirmations (track_id, genre_id): each is by hand, at 1.0, and an example.

    Only the centroids of the genres touched are made anew. vectors: track_id, vector.
    """
    from crate.sources.tables import insert_or_ignore, replace_group, upsert

    decided = confirmed.select("track_id", "genre_id", F.lit(1.0).alias("confidence"), F.lit("manual").alias("method"), F.lit("confirmed").alias("status"))
    taught = insert_or_ignore(exemplars, confirmed.select("genre_id", "track_id"), ["genre_id", "track_id"])
    touched = taught.join(confirmed.select("genre_id").distinct(), "genre_id", "left_semi").join(vectors, "track_id")
    return upsert(assignments, decided, ["track_id"]), taught, replace_group(centroids, mean_vectors(touched, "genre_id"), ["genre_id"])


def by_example(wanted: DataFrame, genres: DataFrame, exemplars: DataFrame, centroids: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genres, exemplars and centroids with genres made of examples (name, parent_id, level, track_id; a row an example).

    A name that its parent (null: none) already has goes on as that genre, the least id of several; new ones get ids after the greatest, by name.
    Only the centroids of the genres named are made anew. genres: genre_id, name, parent_id, level; vectors: track_id, vector.
    """
    from crate.sources.tables import insert_or_ignore, replace_group
    from crate.sources.taxonomy_files import numbered

    said = wanted.groupBy("name", "parent_id").agg(F.min("level").alias("level"))
    have = genres.groupBy(F.col("name").alias("_n"), F.col("parent_id").alias("_p")).agg(F.min("genre_id").alias("genre_id"))
    known = said.join(have, (F.col("name") == F.col("_n")) & F.col("parent_id").eqNullSafe(F.col("_p")), "left").drop("_n", "_p")
    top = genres.agg(F.coalesce(F.max("genre_id"), F.lit(0)).alias("_top"))  # one row
    fresh = numbered(known.filter("genre_id is null").drop("genre_id"), "name", "parent_id").crossJoin(F.broadcast(top))
    fresh = fresh.select((F.col("_top") + F.col("n")).cast("long").alias("genre_id"), "name", "parent_id", "level")
    ids = known.filter("genre_id is not null").select("genre_id", "name", "parent_id").unionByName(fresh.select("genre_id", "name", "parent_id"))
    ids = ids.select("genre_id", F.col("name").alias("_n"), F.col("parent_id").alias("_p"))
    examples = wanted.join(ids, (F.col("name") == F.col("_n")) & F.col("parent_id").eqNullSafe(F.col("_p"))).select("genre_id", "track_id").distinct()
    taught = insert_or_ignore(exemplars.select("genre_id", "track_id"), examples, ["genre_id", "track_id"])
    touched = taught.join(examples.select("genre_id").distinct(), "genre_id", "left_semi").join(vectors, "track_id")
    return genres.select("genre_id", "name", "parent_id", "level").unionByName(fresh), taught, replace_group(centroids, mean_vectors(touched, "genre_id"), ["genre_id"])


def by_segment(segments: DataFrame, windows: DataFrame, genres: DataFrame, exemplars: DataFrame, centroids: DataFrame, vectors: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """by_example() with a sound as the example: the track of each segment and the k tracks whose best window is most like it.

    segments: track_id, name, parent_id, level, vector of the stretch that was marked; windows: window_id, track_id, vector.
    """
    asked = segments.select(F.xxhash64("track_id", "name", "parent_id").alias("query_id"), "*")
    near = top_k(asked, windows, k, item_id="window_id", skip_same_id=False, group="track_id")
    found = near.join(asked.select("query_id", "name", "parent_id", "level"), "query_id").select("name", "parent_id", "level", F.col("grp").alias("track_id"))
    wanted = segments.select("name", "parent_id", "level", "track_id").unionByName(found).distinct()
    return by_example(wanted, genres, exemplars, centroids, vectors)


def persisted(suggestions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments (track_id, genre_id, confidence, status) after suggestions (track_id, genre_id, confidence, rank, from 0): the first of each
    track stands as `suggested`, unless it has a confirmed one."""
    firm = assignments.filter("status = 'confirmed'")
    top = suggestions.filter("rank = 0").join(firm.select("track_id"), "track_id", "left_anti").select("track_id", "genre_id", "confidence", F.lit("suggested").alias("status"))
    rest = assignments.join(top.select("track_id"), "track_id", "left_anti")
    return rest.select("track_id", "genre_id", "confidence", "status").unionByName(top)


def kept_suggestions(suggestions: DataFrame, kept: DataFrame) -> DataFrame:
    """All suggestions, to choose from later (track_id, genre_id, confidence, rank): those of a track replace its earlier ones."""
    from crate.sources.tables import replace_group

    columns = ["track_id", "genre_id", "confidence", "rank"]
    return replace_group(kept.select(*columns), suggestions.select(*columns), ["track_id"])


def layer_pool(states: DataFrame, weights: list[float]) -> DataFrame:
    """track_id, vector from rows (track_id, layer, vector), one a time step: means over time, then the weighted mean over layers."""
    spread = states.filter(F.col("vector").isNotNull()).select("track_id", "layer", F.posexplode(doubles(F.col("vector"))).alias("i", "x"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("layer").cast("int"))
    means = spread.groupBy("track_id", "layer", "i").agg(F.avg("x").alias("m")).withColumn("w", w)
    pooled = means.groupBy("track_id", "i").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("x"))
    return pooled.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("track_id", F.transform("v", lambda s: s["x"]).alias("vector"))


def excerpt_styles(predictions: DataFrame, names: Column, k: int = 10) -> DataFrame:
    """track_id, styles: the k likeliest of names (a column of all classes) by the mean of a track's excerpts (track_id, probs), as array of (style, p)."""
    means = mean_vectors(predictions, "track_id", "probs", unit=False)
    best = top_tags(F.col("vector"), names, k, 0.0)
    return means.select("track_id", F.transform(best, lambda t: F.struct(t["tag"].alias("style"), t["p"].alias("p"))).alias("styles"))


def identified(windows: DataFrame, tracks: DataFrame, k: int = 5) -> DataFrame:
    """query_id, item_id, score, rank: tracks (item_id, vector) nearest to clips given by their windows (query_id, vector), pooled by the mean."""
    clips = mean_vectors(windows, "query_id")
    return top_k(clips, tracks, k)
