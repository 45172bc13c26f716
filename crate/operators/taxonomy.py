"""Genre trees and graphs: ancestors, paths of a graph with many parents, relatives, merging of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crate.storage import discard, saved


def ancestors(genres: DataFrame) -> DataFrame:
    """genre_id, ancestor_id, name, depth (1: the parent) of genres (genre_id, name, parent_id), however deep; a cycle ends the chain.

    A round joins what is known up to some depth with the jump of that depth, so a chain of n takes log2(n) rounds. A parent that isn't
    there ends the chain, too. Each ancestor comes once, at its least depth, and no genre is its own.
    """
    there = genres.select(F.col("genre_id").alias("y")).distinct()
    jump = saved(genres.select(F.col("genre_id").alias("x"), F.col("parent_id").alias("y")).join(there, "y").select("x", "y").distinct(), "jump")
    known = saved(jump.filter("x <> y").select("x", F.col("y").alias("a"), F.lit(1).cast("long").alias("d")), "ancestors")
    reach, n = 1, known.count()
    while n:
        above = known.select(F.col("x").alias("y"), "a", (F.col("d") + reach).alias("d"))
        more = jump.join(above, "y").filter("x <> a").select("x", "a", "d")
        grown = saved(known.unionByName(more).groupBy("x", "a").agg(F.min("d").alias("d")), "ancestors")
        found = grown.count()
        discard(known)
        known, before, n = grown, n, found
        if found == before:
            break
        jump = saved(jump.join(jump.toDF("y", "z"), "y").select("x", F.col("z").alias("y")), "jump")
        reach *= 2
    names = genres.select(F.col("genre_id").alias("ancestor_id"), "name")
    return known.select(F.col("x").alias("genre_id"), F.col("a").alias("ancestor_id"), F.col("d").cast("int").alias("depth")).join(names, "ancestor_id").select("genre_id", "ancestor_id", "name", "depth")


def unfold(nodes: DataFrame, edges: DataFrame, max_depth: int = 16) -> DataFrame:
    """path (array of names), name, depth, level: a row for each way from a root, for nodes (name) and edges (parent, child).

    A node that is its own ancestor on a way ends it. Level is `genre` for roots, `subgenre` below.
    """
    edges = edges.filter(F.col("parent") != F.col("child")).select("parent", "child").distinct()
    roots = nodes.join(edges.select(F.col("child").alias("name")).distinct(), "name", "left_anti")
    at = saved(roots.select(F.array("name").alias("path"), "name", F.lit(0).alias("depth")), "tree")
    out = at
    for depth in range(1, max_depth + 1):
        step = at.join(edges, at["name"] == edges["parent"]).filter(~F.array_contains("path", F.col("child")))
        at = saved(step.select(F.concat("path", F.array("child")).alias("path"), F.col("child").alias("name"), F.lit(depth).alias("depth")), "tree")
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.withColumn("level", F.when(F.col("depth") == 0, "genre").otherwise("subgenre"))


#: Weight of a link by its kind; others count 0.4.
LINK_WEIGHT = {"subgenre": 1.0, "fusion": 0.7, "influence": 0.5}


def related(seeds: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    """seed, name, weight, rank: what is one or two links away from seeds (seed), links (src, dst, rel) taken both ways.

    A second link halves the weight; the strongest way counts. A node is expanded once, from its first-found depth.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LINK_WEIGHT.items() for x in kv]), F.col("rel")), F.lit(0.4))
    both = edges.select("src", "dst", weight.alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight.alias("w")))
    both = both.groupBy("src", "dst").agg(F.max("w").alias("w")).filter("src <> dst")
    one = seeds.join(both, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("name"), "w")
    onward = both.select(F.col("src").alias("name"), F.col("dst").alias("next"), (F.col("w") * 0.5).alias("w"))
    two = one.drop("w").join(onward, "name").filter("next <> seed").select("seed", F.col("next").alias("name"), "w")
    best = one.unionByName(two).groupBy("seed", "name").agg(F.max("w").alias("weight"))
    n = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("weight"), "name"))
    return best.withColumn("rank", n).filter(F.col("rank") <= limit)


def keepers(genres: DataFrame, weight: DataFrame) -> DataFrame:
    """drop, keep: of genres with one parent and one normalised name the one of level genre, then most used, then least id, stays."""
    w = genres.join(weight, "genre_id", "left").withColumn("name", F.lower(F.trim("name"))).withColumn("uses", F.coalesce("uses", F.lit(0)))
    order = Window.partitionBy("parent_id", "name").orderBy(F.desc(F.col("level") == "genre"), F.desc("uses"), "genre_id")
    ranked = w.withColumn("keep", F.first("genre_id").over(order))
    return ranked.filter("keep <> genre_id").select(F.col("genre_id").alias("drop"), "keep")


def merge_duplicates(genres: DataFrame, weight: DataFrame) -> DataFrame:
    """drop, keep for all genres that merge: merged parents make their children namesakes, so it goes on until nothing is left."""
    mapping, tree = None, genres
    while True:  # each round takes a genre away
        found = saved(keepers(tree, weight), "merge")
        if found.isEmpty():
            break
        gone = found.select(F.col("drop").alias("genre_id"))
        up = found.select(F.col("drop").alias("parent_id"), F.col("keep").alias("_to"))
        tree = saved(tree.join(gone, "genre_id", "left_anti").join(up, "parent_id", "left").withColumn("parent_id", F.coalesce("_to", "parent_id")).select(*genres.columns), "genres")
        if mapping is None:
            mapping = found
        else:  # earlier keepers may go in turn
            later = found.select(F.col("drop").alias("keep"), F.col("keep").alias("_to"))
            mapping = saved(mapping.join(later, "keep", "left").select("drop", F.coalesce("_to", "keep").alias("keep")).unionByName(found), "merge")
    return mapping if mapping is not None else genres.select(F.col("genre_id").alias("drop"), F.col("genre_id").alias("keep")).limit(0)


def moved(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (genre_id, ...) under the genres that a merge (drop, keep) left."""
    to = mapping.select(F.col("drop").alias("genre_id"), F.col("keep").alias("_to"))
    return rows.join(to.hint("merge"), "genre_id", "left").select(*[F.coalesce("_to", "genre_id").alias(c) if c == "genre_id" else F.col(c) for c in rows.columns])


def merge_all(genres: DataFrame, assignments: DataFrame, exemplars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The genres left (columns as given) and drop, keep of those merged: namesakes under one parent, then children named like their parent, then
    all other namesakes; moved() takes assignments and exemplars (genre_id, track_id) along.

    Names are compared without case and outer blanks. Of namesakes under one parent one that was there before the last merge stays rather than
    one that came with it, then one of level genre, then the one with most examples, then most tracks and children, then the least id; elsewhere
    examples, tracks and children, and the id decide. Each round merges at least one genre, all groups at once. Genres have one parent or null;
    one that would become its own parent gets none. Joins shuffle both sides: broadcasts of every round would all pass the driver.
    """
    held = saved(assignments.groupBy("genre_id").agg(F.count("*").alias("n")), "held")  # a row a genre
    examples = exemplars.select("genre_id", "track_id").distinct()
    tree = saved(genres.withColumn("_late", F.lit(False)), "genres")
    mapping = saved(genres.select(F.col("genre_id").alias("drop"), F.col("genre_id").alias("keep")).limit(0), "merge")
    for finder in (None, _like_parent, _same_name):
        while True:
            ranked = saved(_ranked(tree, moved(held, mapping), moved(examples, mapping).distinct()), "ranked")
            found = saved(_same_place(ranked), "found")
            if found.isEmpty() and finder is not None:
                found = saved(finder(ranked), "found")
            if found.isEmpty():
                break
            up = found.select(F.col("drop").alias("parent_id"), F.col("keep").alias("_to"))
            left = tree.join(found.select(F.col("drop").alias("genre_id")).hint("merge"), "genre_id", "left_anti").join(up.hint("merge"), "parent_id", "left")
            parent = F.coalesce("_to", "parent_id")
            left = left.withColumn("parent_id", F.when(parent != F.col("genre_id"), parent)).withColumn("_late", F.col("_to").isNotNull())
            tree = saved(left.select(*tree.columns), "genres")
            later = found.select(F.col("drop").alias("keep"), F.col("keep").alias("_to"))
            mapping = saved(mapping.join(later.hint("merge"), "keep", "left").select("drop", F.coalesce("_to", "keep").alias("keep")).unionByName(found), "merge")
    return tree.drop("_late"), mapping


def _ranked(tree: DataFrame, held: DataFrame, examples: DataFrame) -> DataFrame:
    """Genres with their folded name and what they hold: examples, tracks and children."""
    none = F.lit(0).cast("long")
    parts = held.select("genre_id", none.alias("examples"), "n").unionByName(examples.groupBy("genre_id").agg(F.count("*").alias("examples")).withColumn("n", none))
    parts = parts.unionByName(tree.filter("parent_id is not null").groupBy(F.col("parent_id").alias("genre_id")).agg(F.count("*").alias("n")).withColumn("examples", none))
    sums = parts.groupBy("genre_id").agg(F.sum("examples").alias("examples"), F.sum("n").alias("n"))
    named = tree.select("genre_id", "parent_id", "level", "_late", F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("name"))
    return named.join(sums.hint("merge"), "genre_id", "left").withColumns({c: F.coalesce(c, none) for c in ("examples", "n")})


def _same_place(g: DataFrame) -> DataFrame:
    order = F.struct("_late", (~F.coalesce(F.col("level") == "genre", F.lit(False))).alias("l"), -F.col("examples"), -F.col("n"), "genre_id")
    best = g.groupBy(F.col("parent_id").alias("_p"), F.col("name").alias("_n")).agg(F.min_by("genre_id", order).alias("keep"), F.count("*").alias("_k")).filter("_k > 1")
    rows = g.join(best.hint("merge"), F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("name") == F.col("_n"))).filter("keep <> genre_id")
    return rows.select(F.col("genre_id").alias("drop"), "keep")


def _like_parent(g: DataFrame) -> DataFrame:
    """Children named like their parent, the upper ones first: those whose parent goes itself wait."""
    p = g.select(F.col("genre_id").alias("parent_id"), F.col("name").alias("_n"))
    found = g.join(p.hint("merge"), "parent_id").filter("name = _n").select(F.col("genre_id").alias("drop"), F.col("parent_id").alias("keep"))
    return found.join(found.select(F.col("drop").alias("keep")).hint("merge"), "keep", "left_anti").select("drop", "keep")


def _same_name(g: DataFrame) -> DataFrame:
    best = g.groupBy("name").agg(F.min_by("genre_id", F.struct(-F.col("examples"), -F.col("n"), "genre_id")).alias("keep"), F.count("*").alias("_k")).filter("_k > 1")
    return g.join(best.hint("merge"), "name").filter("keep <> genre_id").select(F.col("genre_id").alias("drop"), "keep")


def neighbours(edges: DataFrame) -> DataFrame:
    """name, parents, children (sorted arrays) of the nodes of `subgenre` links (src below dst)."""
    sub = edges.filter("rel = 'subgenre'").select("src", "dst").distinct()
    up, down = sub.select(F.col("src").alias("name"), F.col("dst").alias("parent")), sub.select(F.col("dst").alias("name"), F.col("src").alias("child"))
    both = up.withColumn("child", F.lit(None).cast("string")).unionByName(down.withColumn("parent", F.lit(None).cast("string")))
    return both.groupBy("name").agg(F.array_sort(F.collect_set("parent")).alias("parents"), F.array_sort(F.collect_set("child")).alias("children"))


def named_like_parent(genres: DataFrame) -> DataFrame:
    """genre_id, parent_id of genres (genre_id, name, parent_id) that have their parent's name but for case."""
    p = genres.select(F.col("genre_id").alias("parent_id"), F.col("name").alias("_parent"))
    return genres.join(p, "parent_id").filter(F.lower("name") == F.lower("_parent")).select("genre_id", "parent_id")


def canonical_ids(uses: DataFrame) -> DataFrame:
    """name (normalised), genre_id: of the ids that rows (name, genre_id) give a name the most frequent one, then the smallest."""
    n = uses.groupBy(F.lower(F.trim("name")).alias("name"), "genre_id").agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "genre_id"))
    return n.withColumn("_k", order).filter("_k = 1").select("name", "genre_id")


def listing(genres: DataFrame, centroids: DataFrame, level: str | None = None, like: str | None = None) -> DataFrame:
    """genre_id, name, level, has_centroid; of one level and with a part of the name only, if asked for."""
    rows = genres.join(centroids.select("genre_id", F.lit(True).alias("has_centroid")).distinct(), "genre_id", "left")
    rows = rows.filter(F.col("level") == level) if level else rows
    rows = rows.filter(F.lower("name").contains(like.lower())) if like else rows
    return rows.select("genre_id", "name", "level", F.coalesce("has_centroid", F.lit(False)).alias("has_centroid"))
